"""Token counts by rank-synchronous array merging.

Pre-tokens that a chunk of texts needs are held once, as one flat symbol array with offsets. In each round
every sequence applies its own lowest-ranked pair wherever it occurs (left to right, without overlap), all
sequences at the same time; sequences without a mergeable pair leave the array and their surviving symbols
are counted. Memory is bounded by the chunk; the vocabulary is a file of fixed size, which the driver reads
and broadcasts.

Nulls count as empty texts, which have 0 bytes and 0 tokens. Texts of any length are counted whole. Repeated rows and
null or repeated ids give a row each. Other columns are not read. Special strings inside a text are one token each, as
the library does by default. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, ship
from .pretokens import compile_pattern, distinct

NONE = np.int64(1) << 40
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


@dataclass
class MergeTable:
    """Pair (left id, right id) -> rank and merged id, in an open-addressing hash table of numpy arrays."""

    first: np.ndarray  # id of each single byte
    merged: np.ndarray  # id by rank
    keys: np.ndarray
    ranks: np.ndarray
    probes: int
    pattern: str
    special: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str, pattern: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        first = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        pairs = np.array([[vocab[a], vocab[b]] for a, b in merges], np.uint64).reshape(-1, 2)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        size = 1 << max(4, (4 * len(merges)).bit_length())  # a quarter full at most
        keys, ranks = np.full(size, np.uint64(2**64 - 1)), np.full(size, NONE)
        packed = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        probes = 1
        for rank, (key, slot) in enumerate(zip(packed.tolist(), cls.slot(packed, size).tolist(), strict=True)):
            step = 0
            while ranks[(slot + step) % size] != NONE:
                step += 1
            keys[(slot + step) % size], ranks[(slot + step) % size] = key, rank
            probes = max(probes, step + 1)
        return cls(first, merged, keys, ranks, probes, pattern, [t["content"] for t in spec.get("added_tokens", ())])

    @staticmethod
    def slot(keys: np.ndarray, size: int) -> np.ndarray:
        """Place of each key in a table of `size`, a power of two."""
        return ((keys * GOLDEN) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        size = self.keys.size
        slot = self.slot(key, size)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.ranks[slot] != NONE))
        for step in range(1, self.probes):
            if not open_.size:
                break
            at = (slot[open_] + step) % size
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != NONE)]
        return out


def surviving_symbols(table: MergeTable, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of symbols left of each sequence of bytes (their lengths: counts) when no pair can merge."""
    flat = table.first[data]
    owner = np.repeat(np.arange(counts.size), counts)
    left = counts.copy()
    while flat.size > 1:
        ranks = table.pair_ranks(flat[:-1], flat[1:])
        ranks[owner[:-1] != owner[1:]] = NONE
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(np.r_[ranks, NONE], starts)
        sizes = np.diff(np.r_[starts, owner.size])
        alive = np.repeat(lowest != NONE, sizes)
        if not alive.any():
            break
        hits = np.flatnonzero((ranks == np.repeat(lowest, sizes)[:-1]) & (ranks != NONE))
        # neighbours hit together are runs of one repeated symbol: take every second of a run
        run_start = np.r_[True, np.diff(hits) != 1]
        place = np.arange(hits.size)
        hits = hits[(place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0]
        flat[hits] = table.merged[ranks[hits]]
        left -= np.bincount(owner[hits], minlength=left.size)
        alive[hits + 1] = False
        flat, owner = flat[alive], owner[alive]
    return left


class TokenCounter:
    """Counts the tokens of whole texts."""

    def __init__(self, table: MergeTable):
        self.table, self.split = table, compile_pattern(table.pattern)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(table.special, key=len, reverse=True))) if table.special else None

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [self.special.split(t) for t in texts] if self.special else [[t] for t in texts]
        found = distinct([p for x in parts for p in x], self.split)
        by_part = np.r_[0, np.cumsum(found.sum_by_text(surviving_symbols(self.table, found.data, found.lengths)))]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(n)
        return by_part[ends] - by_part[ends - n] + n - 1


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text. `path`: the tokenizer's .json, read on the driver."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(MergeTable.load(path, pattern))

    def count(texts: list[bytes]) -> dict[str, object]:
        table = shared.value
        counter = table.counter = getattr(table, "counter", None) or TokenCounter(table)
        n = counter([t.decode() for t in texts]).tolist()
        return {"n_bytes": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array((x > limit for x in n), pa.bool_())}

    return map_texts(docs, count, "n_bytes long, n_tokens long, over_limit boolean")
