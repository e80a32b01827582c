"""Substring dedup by Rabin-Karp hashes of every window of 50 tokens, counted in Spark.

A window's hash is the polynomial of its words' codes in a random base, modulo the prime 2**61 - 1: prefix sums of code
times power, a difference, and one multiplication by an inverse power. Two such hashes, of independent word codes and
bases, name a window by 96 bits. Modulo a prime no text is bad for every base: two
different windows share a name with a chance of about 2**-96, so 1e13 windows (100 TB) have less than one false pair
in a thousand runs by calculation.

A map task collects about half a million windows at a time, keeps one entry per window content (that of the smallest
document; the other documents' entries are decided on the spot, as a smaller document is at hand), sorts the
entries by hash and packs each hash part into one binary row. Spark shuffles these rows by part, one part per
shuffle partition whatever the input's size; there they are split into the part's ranges, sorted by range on disk,
and taken a range at a time: the smallest document of every window is found, and any other document that has the
window gets it flagged. So a window that a third of all documents share costs an entry per map step, not per
document. Flags travel packed by group of documents, in the same two steps, and go back in a join by doc_id, one row
per document, where covered words are merged into maximal intervals and removed.

Null texts have no words. Rows of one doc_id count as one document; rows with a null doc_id keep all words and are no
source of removals. Texts of under 50 words keep all words; very long texts are hashed in overlapping pieces. Ids may
be of any type that sorts; those that aren't whole numbers are numbered in their order first, which takes a sort of
the ids and a join. Other columns are not read. Windows are judged on the input. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import byte_texts, chunks, labels, ship, staged

WINDOW = 50
#: Bytes hashed at once, windows packed at once, entries split at once, and bytes of text per hash range.
PIECE, FLUSH, SPLIT, RANGE_BYTES = 1 << 19, 500_000, 1_000_000, 24 << 20
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_U = [np.uint64(i) for i in range(64)]
_RNG = np.random.default_rng(20240501)
#: A random base for each of the two hashes, and the seed of the word codes.
_BASES = [int(x) for x in _RNG.integers(1 << 40, PRIME - 1, 2)]
_SEED = int(_RNG.integers(1 << 62))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U[61])
    x -= _P * (x >= _P)
    return x


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> _U[31], x & _LOW31


def times(a: np.ndarray, b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """a * b modulo 2**61 - 1, b given as its high 30 and low 31 bits."""
    (ah, al), (bh, bl) = _halves(a), b
    middle = ah * bl
    middle += al * bh
    ah *= bh
    ah <<= _U[1]
    ah += middle >> _U[30]
    middle &= _LOW30
    middle <<= _U[31]
    ah += middle
    al *= bl
    ah += al
    return _reduced(ah)


class Powers:
    """Powers of a base modulo the prime, and of its inverse, grown as they are needed."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, PRIME)
        self.tables = [_halves(np.ones(1, np.uint64))] * 2

    def __call__(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        for i, base in enumerate(self.bases):
            while self.tables[i][0].size < n:
                high, low = self.tables[i]
                whole = high << _U[31] | low
                step = np.uint64(pow(base, whole.size, PRIME))
                self.tables[i] = _halves(np.r_[whole, times(whole, _halves(step))])
        return [(high[:n], low[:n]) for high, low in self.tables]


_POWERS = [Powers(b) for b in _BASES]


def word_codes(words: list[bytes]) -> np.ndarray:
    """Two independent codes below the prime of each word: shape (2, words). Equal words are hashed once."""
    if not words:
        return np.zeros((2, 0), np.uint64)
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    raw = b"".join(xxhash.xxh3_128_digest(w, _SEED) for w in coded.dictionary.to_pylist())
    both = np.frombuffer(raw, "<u8").reshape(-1, 2).T & _P
    return both[:, coded.indices.to_numpy(zero_copy_only=False)]


def window_hashes(codes: np.ndarray, powers: Powers, window: int) -> np.ndarray:
    """The sum of code times base ** place over each window, from prefix sums modulo the prime. Windows that would pass the end
    are left out."""
    if codes.size < window:
        return codes[:0]
    up, down = powers(codes.size)
    high, low = _halves(times(codes, up))
    high, low = (np.cumsum(x, dtype=np.uint64) for x in (high, low))  # no overflow below 2**33 words
    sums = np.zeros(codes.size + 1, np.uint64)
    high = _reduced(high)
    sums[1:] = _reduced(_reduced((high >> _U[30]) + ((high & _LOW30) << _U[31])) + _reduced(low))
    gap = sums[window:] + (_P - sums[:-window])
    return times(_reduced(gap), tuple(x[: gap.size] for x in down))


def hashed(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: 64 bits and 32 more of its name, and the number of windows of each text."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.maximum(sizes - window + 1, 0)
    first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    codes = word_codes([w for x in words for w in x])
    h, g = (window_hashes(c, powers, window)[first] for c, powers in zip(codes, _POWERS, strict=True))
    return (h << _U[3]) | (g >> _U[58]), (g >> _U[26]).astype(np.uint32), counts


def pieces(text: bytes, window: int) -> list[bytes]:
    """A very long text in parts that overlap by window - 1 words."""
    if len(text) <= PIECE:
        return [text]
    words, step = text.split(), 100_000
    return [b" ".join(words[i : i + step + window - 1]) for i in range(0, max(1, len(words) - window + 1), step)]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all first ones first: what is alike in many numbers lies together."""
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(x.size, -1).T).tobytes()


def _from_planes(raw: bytes, n: int, kind: str, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(f">{kind}").ravel().astype(kind), at + size * n


def _rises(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def _pack(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> bytes:
    """Entries in order of hash: rises of the first 64 bits, the other bits, and each one's document, compressed."""
    if (h1[1:] < h1[:-1]).any():
        order = np.argsort(h1, kind="stable")
        h1, h2, doc = h1[order], h2[order], doc[order]
    used, ref = np.unique(doc, return_inverse=True)
    ref = ref.astype("u2" if used.size <= 1 << 16 else "u4")
    raw = np.array([h1.size, used.size], "<i8").tobytes() + _planes(_rises(used.view(np.uint64))) + _planes(_rises(h1)) + _planes(ref) + h2.astype("<u4").tobytes()
    return zstandard.compress(raw, 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, docs = np.frombuffer(raw, "<i8", 2).tolist()
    used, at = _from_planes(raw, docs, "u8", 16)
    rises, at = _from_planes(raw, n, "u8", at)
    ref, at = _from_planes(raw, n, "u2" if docs <= 1 << 16 else "u4", at)
    return np.cumsum(rises, dtype=np.uint64), np.frombuffer(raw, "<u4", n, at), np.cumsum(used, dtype=np.uint64).view(np.int64)[ref]


def _pack_flags(h1: np.ndarray, doc: np.ndarray) -> bytes:
    """Documents, the number of flagged hashes of each, and the hashes, each document's in order; compressed."""
    order = np.lexsort((h1, doc))
    used, many = np.unique(doc, return_counts=True)
    raw = np.array([h1.size, used.size], "<i8").tobytes() + _planes(_rises(used.view(np.uint64))) + many.astype("<u4").tobytes() + _planes(h1[order])
    return zstandard.compress(raw, 1)


def _unpack_flags(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, docs = np.frombuffer(raw, "<i8", 2).tolist()
    used, at = _from_planes(raw, docs, "u8", 16)
    many = np.frombuffer(raw, "<u4", docs, at)
    return _from_planes(raw, n, "u8", at + 4 * docs)[0], np.repeat(np.cumsum(used, dtype=np.uint64).view(np.int64), many)


def _parted(place: np.ndarray, columns: tuple[np.ndarray, ...], pack: Callable) -> tuple[list[int], list[bytes]]:
    """The places that occur, and what `pack` makes of the rows of each."""
    order = np.argsort(place, kind="stable")
    place, columns = place[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if place.size else np.zeros(0, np.int64)
    stops = np.r_[cuts[1:], place.size]
    return place[cuts].tolist(), [pack(*(c[a:b] for c in columns)) for a, b in zip(cuts, stops, strict=False)]


def _share(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal shares of the 32-bit numbers x is in."""
    return (x * np.uint64(parts) >> _U[32]).astype(np.int64)


def _mixed(doc: np.ndarray) -> np.ndarray:
    """32 scattered bits of a document's number."""
    h = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> _U[29]) * np.uint64(0xD6E8FEB86659FD93) >> _U[32]


def _first(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by (hash, document), which entries there are the first of their hash, and the document of that one."""
    order = np.lexsort((doc, h2, h1))
    a, b, doc = h1[order], h2[order], doc[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if a.size else np.zeros(0, bool)
    return order, first, doc[np.maximum.accumulate(np.where(first, np.arange(first.size), 0))]


ROW = "flag boolean, part int, packed binary"
SPLIT_ROW = "flag boolean, part int, range int, packed binary"


def _map_side(window: int, named: list[int]):
    """Entries by part of the hashes, and flags by part of the documents; parts by their labels."""
    parts, label = len(named), np.array(named, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h1, h2, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first, owner = _first(h1, h2, doc)
            h1, h2, doc = h1[order], h2[order], doc[order]
            late = ~first & (owner != doc)
            where, flags = _parted(_share(_mixed(doc[late]), parts), (h1[late], doc[late]), _pack_flags)
            at, blobs = _parted(_share(h1[first] >> _U[32], parts), (h1[first], h2[first], doc[first]), _pack)
            return pa.RecordBatch.from_arrays([pa.array([False] * len(at) + [True] * len(where)), pa.array(label[at + where], pa.int32()), pa.array(blobs + flags, pa.binary())], names=["flag", "part", "packed"])

        for ids, texts in chunks(batches, PIECE):
            split = [(i, p) for i, t in zip(ids.to_pylist(), texts, strict=True) if i is not None for p in pieces(t, window)]
            if not split:
                continue
            h1, h2, counts = hashed([p for _, p in split], window)
            held.append((h1, h2, np.repeat(np.array([i for i, _ in split], np.int64), counts)))
            size += h1.size
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _split(ranges: int, parts: int):
    """Rows by range of their part. Where a part is one range, rows pass as they are."""

    def place(h: np.ndarray) -> np.ndarray:  # the same share, finer: which of the part's ranges
        return _share(h, parts * ranges) % ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (flag, part), some in held.items():
                columns = tuple(np.concatenate(x) for x in zip(*some, strict=True))
                where = place(_mixed(columns[1]) if flag else columns[0] >> _U[32])
                at, blobs = _parted(where, columns, _pack_flags if flag else _pack)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([flag] * n), pa.array([part] * n, pa.int32()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["flag", "part", "range", "packed"])

        for batch in batches:
            if ranges == 1:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(batch), np.int32)), batch.column(2)], names=["flag", "part", "range", "packed"])
                continue
            for flag, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((flag, part), []).append(_unpack_flags(blob) if flag else _unpack(blob))
                size += held[flag, part][-1][0].size
                if size >= SPLIT:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def _by_range(one: Callable[[int, list[bytes], list[bytes]], pa.RecordBatch]):
    """Applies `one` to the part, entries and flags of each range, from rows sorted by part and range, one range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, flags = None, [], []
        for batch in batches:
            for flag, part, rng, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, rng) != now:
                    if now is not None:
                        yield one(now[0], entries, flags)
                    now, entries, flags = (part, rng), [], []
                (flags if flag else entries).append(blob)
        if now is not None:
            yield one(now[0], entries, flags)

    return run


def _late(named: list[int]) -> Callable[[int, list[bytes], list[bytes]], pa.RecordBatch]:
    """Flags, by part of the documents, of every document that has a window of a smaller one. Flags pass."""
    parts, label = len(named), np.array(named, np.int64)

    def one(part: int, entries: list[bytes], flags: list[bytes]) -> pa.RecordBatch:
        at, blobs = [part] * len(flags), list(flags)
        if entries:
            h1, h2, doc = (np.concatenate(x) for x in zip(*map(_unpack, entries), strict=True))
            order, _, owner = _first(h1, h2, doc)
            h1, doc = h1[order], doc[order]
            late = owner != doc
            where, more = _parted(_share(_mixed(doc[late]), parts), (h1[late], doc[late]), _pack_flags)
            at, blobs = at + label[where].tolist(), blobs + more
        return pa.RecordBatch.from_arrays([pa.array([True] * len(at), pa.bool_()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["flag", "part", "packed"])

    return one


def _per_document(part: int, entries: list[bytes], flags: list[bytes]) -> pa.RecordBatch:
    """One row per flagged document of a range: its number and all its flagged hashes."""
    h1, doc = (np.concatenate(x) for x in zip(*map(_unpack_flags, flags), strict=True))
    docs, blobs = _parted(doc, (h1,), lambda h: np.unique(h).astype("<u8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(blobs, pa.binary())], names=["doc", "flags"])


def _dealt(rows: DataFrame, parts: int, ranges: int) -> DataFrame:
    """Rows dealt by part, split into ranges, and sorted by them within their partition (on disk if need be)."""
    split = rows.repartition("part").mapInArrow(_split(ranges, parts), SPLIT_ROW)
    return split.sortWithinPartitions("part", "range")


def flagged_windows(numbered: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc and the packed 64-bit hashes of its windows that start in a document with a smaller number as well, from
    columns doc (a long) and text."""
    spark = ship(numbered.sparkSession)
    total = numbered.agg(F.sum(F.octet_length(text))).first()[0] or 0
    named = labels(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = max(1, -(-total // (RANGE_BYTES * len(named))))
    rows = numbered.select("doc", text).mapInArrow(_map_side(window, named), ROW)
    late = _dealt(rows, len(named), ranges).mapInArrow(_by_range(_late(named)), ROW)
    return _dealt(late, len(named), ranges).mapInArrow(_by_range(_per_document), "doc long, flags binary")


def _remove(window: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):  # bounds the texts held at once
                some = batch.slice(at, 256)
                out: list[tuple] = []
                for packed, flags in zip(byte_texts(some.column("packed")), some.column("flags").to_pylist(), strict=True):
                    text = unzip.decompress(packed)
                    words = text.split()
                    kept, removed, spans = words, 0, []
                    if flags:
                        hits = np.isin(np.concatenate([hashed([p], window)[0] for p in pieces(text, window)]), np.frombuffer(flags, "<u8"))
                        edge = np.zeros(len(words) + 1, np.int64)
                        where = np.flatnonzero(hits)
                        edge[where] += 1
                        edge[where + window] -= 1
                        gone = np.cumsum(edge)[:-1] > 0
                        removed = int(gone.sum())
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                        turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
                        spans = [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                    out.append((len(words), removed, b" ".join(kept), spans))
                n, removed, kept, spans = zip(*out, strict=True)
                columns = [some.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array((hashlib.sha256(k).hexdigest() for k in kept), pa.string())]
                names = ["doc", "n_words", "n_removed", "kept_sha256"]
                if texts_too:
                    columns += [pa.array([k.decode() for k in kept], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                    names += ["kept_text", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way through the shuffle."""
    tool = zstandard.ZstdCompressor(level=3)
    for ids, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(map(tool.compress, texts), pa.binary())], names=["doc", "packed"])


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts_too: bool = False) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256; with texts_too also kept_text and spans (removed word intervals)."""
    whole = isinstance(docs.schema[key].dataType, IntegralType)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if whole:
        numbered = rows.select(F.col("key").cast("long").alias("doc"), "text")
    else:
        ids = staged(rows.select("key").filter("key IS NOT NULL").distinct().orderBy("key").select("key", F.monotonically_increasing_id().alias("doc")), "ids")
        numbered = rows.join(ids, "key", "left").select("doc", "text")
    flags = flagged_windows(numbered, "text", window)
    packed = numbered.mapInArrow(_zip, "doc long, packed binary")
    more = ", kept_text string, spans array<struct<start:long,end:long>>" if texts_too else ""
    out = packed.join(flags, "doc", "left").select("doc", "packed", "flags").mapInArrow(_remove(window, texts_too), f"doc long, n_words long, n_removed long, kept_sha256 string{more}")
    if whole:
        return out.withColumnRenamed("doc", "doc_id")
    return out.join(ids, "doc", "left").drop("doc").withColumnRenamed("key", "doc_id").select("doc_id", *out.columns[1:])
