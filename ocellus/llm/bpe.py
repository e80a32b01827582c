"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (hash and displace; as many slots as entries) resolves a
pre-token that is an entry as a whole, after comparing its bytes. Tier 2: any other pre-token is merged with a
heap of candidate pairs over a doubly linked list of its bytes, in O(n log n). Decoding joins the entries'
bytes. The rank file has a fixed size; the driver reads it, builds the hash and broadcasts both.

Nulls count as empty texts, which have no ids. Repeated rows and null or repeated ids give a row each. Other columns are
not read. Texts of any length are encoded whole; there are no special tokens. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import map_texts, ship
from .pretokens import compile_pattern, distinct, ragged_take


def load_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in order of rank, from lines of base64 entry and rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(entry)) for entry, rank in map(bytes.split, filter(bytes.strip, f)))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [entry for _, entry in pairs]


class PerfectHash:
    """Minimal perfect hash: slot of each of n keys in n slots. A bucket's displacement shifts its keys; a
    bucket of one key names its slot outright."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        parts: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            parts.setdefault(h % self.buckets, []).append((h, i))
        self.shift = [0] * self.buckets
        self.order = [-1] * n
        free = [True] * n
        singles = []
        for b, group in sorted(parts.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(group) == 1:
                singles.append((b, group[0][1]))
                continue
            for d in range(1000 * n):
                slots = {self.slot(h, d): i for h, i in group}
                if len(slots) == len(group) and all(free[s] for s in slots):
                    break
            else:
                raise ValueError("keys repeat, or hash alike")
            self.shift[b] = d
            for s, i in slots.items():
                self.order[s], free[s] = i, False
        for (b, i), s in zip(singles, (s for s in range(n) if free[s]), strict=True):
            self.shift[b], self.order[s] = -1 - s, i

    def slot(self, h: int, d: int) -> int:
        return ((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 32 & 0xFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """Index of the only key that can be equal to `key`."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.order[-1 - d if d < 0 else self.slot(h, d)]


#: Distinct merged pre-tokens that a worker remembers, in each of two generations.
REMEMBERED = 150_000


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, entries: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.entries, self.pattern, self.hash = entries, pattern, table or PerfectHash(entries)
        self._ready()

    def _ready(self) -> None:
        self.ranks, self.split = {e: i for i, e in enumerate(self.entries)}, compile_pattern(self.pattern)
        self.two = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.young, self.old = {}, {}
        self.data = np.frombuffer(b"".join(self.entries), np.uint8)
        self.lengths = np.fromiter(map(len, self.entries), np.int64, len(self.entries))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __getstate__(self) -> tuple:
        return self.entries, self.pattern, self.hash

    def __setstate__(self, state: tuple) -> None:
        self.entries, self.pattern, self.hash = state
        self._ready()

    def word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        found = self.hash.find(word)
        if self.entries[found] == word:
            return (found,)
        if (ids := self.young.get(word)) is None:
            ids = self.old.get(word) or self.merge(word)
            if len(word) <= 64:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[word] = ids
        return ids

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merge by a heap over linked bytes. A heap entry is rank << 32 | start; it is stale unless the pair
        that now begins there still has that rank, which names its bytes and so its end."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        two = self.two
        pair = [two[a << 8 | b] for a, b in zip(word, word[1:])]
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        get = ranks.get
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue
            j = end[i]
            end[i] = stop = end[j]
            pair[j] = -1
            if stop < n:
                before[stop] = i
                pair[i] = r = get(word[i : end[stop]], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                pair[i] = -1
            if (p := before[i]) >= 0:
                pair[p] = r = get(word[p:stop], -1)
                if r >= 0:
                    heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        found = distinct(texts, self.split)
        ids = list(map(self.word, found.words()))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        out = ragged_take(flat, np.cumsum(lengths) - lengths, lengths, found.index)
        return np.split(out, np.cumsum(found.sum_by_text(lengths))[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.data, self.starts, self.lengths, ids).tobytes()


def _shared(docs: DataFrame, path: str, pattern: str):
    return ship(docs.sparkSession).sparkContext.broadcast(Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers). `path`: the rank file, read on the driver."""
    shared = _shared(docs, path, pattern)

    def run(texts: list[bytes]) -> dict[str, object]:
        ids = [x.astype("<u4").tobytes() for x in shared.value.encode([t.decode() for t in texts])]
        return {"n_tokens": pa.array((len(x) // 4 for x in ids), pa.int64()), "ids": pa.array(ids, pa.binary())}

    return map_texts(docs, run, "n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of encoded ids."""
    shared = _shared(encoded, path, pattern)

    def run(coded: list[bytes]) -> dict[str, object]:
        return {"decoded": pa.array((shared.value.decode(np.frombuffer(x, "<u4")) for x in coded), pa.binary())}

    return map_texts(encoded, run, "decoded binary", text=ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 (lowercase hex)."""
    shared = _shared(docs, path, pattern)

    def run(texts: list[bytes]) -> dict[str, object]:
        codec = shared.value
        ids = codec.encode([t.decode() for t in texts])
        return {
            "n_tokens": pa.array(map(len, ids), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
        }

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), lossless (the ids decode to the text)."""
    shared = _shared(docs, path, pattern)

    def run(texts: list[bytes]) -> dict[str, object]:
        codec = shared.value
        ids = codec.encode([t.decode() for t in texts])
        return {
            "n_tokens": pa.array(map(len, ids), pa.int64()),
            "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
            "lossless": pa.array([codec.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
        }

    return map_texts(docs, run, "n_tokens long, ids binary, lossless boolean")
