"""Splitting a chunk of texts into distinct pre-tokens, shared by the two byte-level BPE operators."""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex

#: Unicode White_Space, which the tokenizer libraries mean by \\s (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The tokenizer's pattern with its \\s spelled out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))


class Distinct(NamedTuple):
    """The distinct pre-tokens of some texts as one ragged byte array, and each text's pre-tokens as indices."""

    data: np.ndarray  # bytes of all distinct pre-tokens
    starts: np.ndarray
    lengths: np.ndarray
    index: np.ndarray  # of every pre-token, text after text
    per_text: np.ndarray

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s : s + n] for s, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True)]

    def sum_by_text(self, value: np.ndarray) -> np.ndarray:
        """Sum over each text's pre-tokens of a value that each distinct pre-token has."""
        total = np.r_[0, np.cumsum(value[self.index], dtype=np.int64)]
        ends = np.cumsum(self.per_text)
        return total[ends] - total[ends - self.per_text]


def distinct(texts: list[str], split: regex.Pattern) -> Distinct:
    found = list(map(split.findall, texts))
    coded = pa.array(chain.from_iterable(found), pa.large_string()).dictionary_encode()
    words = coded.dictionary
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.zeros(0, np.uint8)
    return Distinct(data, offsets[:-1], np.diff(offsets), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.fromiter(map(len, found), np.int64, len(found)))


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i] : starts[i] + lengths[i]] for i in index, end to end."""
    n = lengths[index]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if n.size else 0)
    return flat[at + np.repeat(starts[index] - (ends - n), n)]
