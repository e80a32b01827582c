"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of 10 consecutive item words is a test string; an item of 1 to 9 words is one test string. Words of
the benchmark get numbers, all others are 0, and test strings of one length m are searched together: a block of
the last (up to) three words under the search position is hashed into a shift table, which says how far the
position can move because no test string has the block nearer to its end (m - 2 words for a block that is in
none, as is any block with a word outside the benchmark). Where the shift is 0, the same hash selects the bucket
of test strings that end with such a block, and word by word comparison confirms occurrences. All documents of a
chunk are searched in lock-step with numpy, long ones in segments, so one very long text is no slower.

The benchmark is collected on the driver only in parts of about PART_BYTES of text (an item is in one part, whole), each
broadcast as one matcher. PARTS_AT_ONCE of them are searched in one pass over the documents and then given up, so
neither the driver nor a worker holds more, however large the benchmark; a benchmark of more parts takes more passes, and
the passes' hits, which are few, meet by document. Nulls have no words; an item without words matches nothing. Items that
share a test string are all counted. Items with a null id hit words but are not counted or listed. Texts of any length are
searched whole. Other columns are not read. Every document row gives one row, also of repeated or null ids. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, keep_texts, ship, staged

WINDOW = 10
PART_BYTES, PARTS_AT_ONCE = 4 << 20, 2
BLOCK, SEGMENT, TABLE_BITS = 3, 512, 20
#: A-Z lower-cased; of the rest of ASCII all but 0-9 and a-z separates words.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Matcher:
    """Test strings of some items, with shift tables and suffix buckets for each length."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int = WINDOW):
        self.codes: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            coded = [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)]
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                owners = patterns.setdefault(tuple(coded[i : i + window]), set())
                if item is not None:
                    owners.add(str(item))
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for p in patterns:
            by_length.setdefault(len(p), []).append(p)
        self.groups = [self._group(m, ps, [sorted(patterns[p]) for p in ps]) for m, ps in sorted(by_length.items())]

    @staticmethod
    def block_hash(words: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
        """Hash of the `block` words that end at each position of `last`."""
        h = words[last].astype(np.uint64)
        for back in range(1, block):
            h = (h + np.uint64(back)) * np.uint64(0x9E3779B97F4A7C15) + words[last - back].astype(np.uint64)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _group(self, m: int, patterns: list[tuple[int, ...]], owners: list[list[str]]) -> dict[str, object]:
        block = min(BLOCK, m)
        grid = np.array(patterns, np.int32).reshape(len(patterns), m)
        flat = grid.ravel()
        shift = np.full(1 << TABLE_BITS, m - block + 1, np.int32)
        for last in range(block - 1, m):
            np.minimum.at(shift, self.block_hash(flat, np.arange(len(patterns)) * m + last, block), m - 1 - last)
        suffix = self.block_hash(flat, np.arange(len(patterns)) * m + m - 1, block)
        order = np.argsort(suffix, kind="stable")
        bucket = np.searchsorted(suffix[order], np.arange((1 << TABLE_BITS) + 1))
        return {"m": m, "block": block, "shift": shift, "bucket": bucket, "grid": grid[order], "owners": [owners[i] for i in order.tolist()]}

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts end to end, and each text's number of words."""
        get, out = self.codes.get, []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes[i] = len(words)
            out.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        return np.concatenate(out) if out else np.zeros(0, np.int32), sizes

    def search(self, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[str]]]]:
        """Per length m: m, last positions of occurrences, their test strings, and the owners of each test string."""
        stops = np.cumsum(sizes)
        for g in self.groups:
            m, block, shift = g["m"], g["block"], g["shift"]
            long_enough = sizes >= m
            begin, stop = (stops - sizes)[long_enough] + m - 1, stops[long_enough]
            cuts = -(-(stop - begin) // SEGMENT)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            at = np.repeat(begin, cuts) + nth * SEGMENT
            end = np.minimum(at + SEGMENT, np.repeat(stop, cuts))
            ready: list[np.ndarray] = []
            while at.size:
                step = shift[self.block_hash(words, at, block)]
                ready.append(at[step == 0])
                at = at + np.maximum(step, 1)
                live = at < end
                at, end = at[live], end[live]
            last = np.concatenate(ready) if ready else np.zeros(0, np.int64)
            h = self.block_hash(words, last, block)
            first, many = g["bucket"][h], g["bucket"][h + 1] - g["bucket"][h]
            found_at, found = [], []
            for lo in range(0, last.size, 200_000):  # bounds what is compared at once
                some = slice(lo, lo + 200_000)
                n = many[some]
                which = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                where = np.repeat(last[some], n)
                for back in range(m):
                    same = words[where - back] == g["grid"][which, m - 1 - back]
                    where, which = where[same], which[same]
                found_at.append(where)
                found.append(which)
            if found:
                yield m, np.concatenate(found_at), np.concatenate(found), g["owners"]

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Of the texts: which words are hit (all texts end to end), words per text, items per text."""
        words, sizes = self.encode(texts)
        edge = np.zeros(words.size + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        stops = np.cumsum(sizes)
        for m, last, which, owners in self.search(words, sizes):
            np.add.at(edge, last - m + 1, 1)
            np.add.at(edge, last + 1, -1)
            doc = np.searchsorted(stops, last, side="right")
            for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                items[d].update(owners[p])
        return np.cumsum(edge)[:-1] > 0, sizes, items


def passes(benchmark: DataFrame, key: str, text: str, window: int, part_bytes: int, at_once: int = PARTS_AT_ONCE) -> Iterator[list[Matcher]]:
    """Matchers of benchmark parts of bounded size, built on the driver for one pass at a time; at least one pass."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-2 * total // part_bytes)) if total > part_bytes else 1
    for first in range(0, parts, at_once):
        out = []
        for part in range(first, min(first + at_once, parts)):
            rows = benchmark.filter(F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(parts)) == part) if parts > 1 else benchmark
            out.append(Matcher(((r[0], (r[1] or "").encode()) for r in rows.select(key, text).toLocalIterator()), window))
        yield out


def _turns(hit: np.ndarray) -> list[int]:
    """Where runs of hit words begin and end, in turn."""
    return np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()


def _hits(matchers: list[Matcher], texts: list[bytes]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Of each text: its number of words, the ends of its hit intervals, and its items."""
    hit, sizes, items = matchers[0].hits(texts)
    for more in matchers[1:]:
        also, _, others = more.hits(texts)
        hit |= also
        items = [a | b for a, b in zip(items, others, strict=True)]
    return sizes.tolist(), [_turns(x) for x in np.split(hit, np.cumsum(sizes)[:-1])] if texts else [], [sorted(x) for x in items]


def _merged(turns: list[int]) -> list[int]:
    """The ends of the union of intervals, given as pairs of ends in any order."""
    out: list[int] = []
    for a, b in sorted(zip(turns[::2], turns[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with spans also items and the hit word intervals."""
    spark = ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    more = ", items array<string>, spans array<struct<start:long,end:long>>" if spans else ""
    result = f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean{more}"

    def columns(ids: pa.Array, sizes: list[int], turns: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
        n_hit = [sum(t[1::2]) - sum(t[::2]) for t in turns]
        out = [ids, pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
        if spans:
            out += [pa.array(items, pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in zip(t[::2], t[1::2], strict=True)] for t in turns], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return pa.RecordBatch.from_arrays(out, names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(("items", "spans") if spans else ())])

    every = passes(benchmark, item_key, item_text, window, part_bytes)
    first, second = next(every), next(every, None)
    if second is None:  # one pass: no intermediate table
        shared = spark.sparkContext.broadcast(first)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts in chunks(batches):
                yield columns(ids, *_hits(shared.value, texts))

        return docs.select(key, text).mapInArrow(whole, result)
    rows = staged(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = None
    for held in chain([first, second], every):
        now = spark.sparkContext.broadcast(held)

        def part(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for row, texts in chunks(batches):
                sizes, turns, items = _hits(now.value, texts)
                yield pa.RecordBatch.from_arrays([row, pa.array(sizes, pa.int64()), pa.array(turns, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["row", "n", "turns", "items"])

        one = staged(rows.select("row", "text").mapInArrow(part, "row long, n long, turns array<long>, items array<string>"), "pass-hits")
        now.unpersist()
        found = one if found is None else found.unionByName(one.filter("size(turns) > 0"))
    met = found.groupBy("row").agg(F.max("n").alias("n"), F.flatten(F.collect_list("turns")).alias("turns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, turns, items = (c.to_pylist() for c in batch.columns[1:])
            yield columns(batch.column(0), sizes, [_merged(t) for t in turns], [sorted(x) for x in items])

    keys = staged(rows.select("key", "row"), "row-keys")
    discard(rows)  # the texts
    return keys.join(met, "row").select("key", "n", "turns", "items").mapInArrow(union, result)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no test string occurs."""
    spark = ship(docs.sparkSession)
    every = passes(benchmark, item_key, item_text, window, part_bytes)
    now, later, before = next(every), next(every, None), []
    while True:
        shared = spark.sparkContext.broadcast(now)
        docs = keep_texts(docs, lambda texts, shared=shared: [not t for t in _hits(shared.value, texts)[1]], text)
        if later is None:
            return docs
        docs = staged(docs, "clean-rows")
        discard(*before)
        before = [docs]
        shared.unpersist()
        now, later = later, next(every, None)
