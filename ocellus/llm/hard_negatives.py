"""Hard negatives by blocked dense matrix products: blocks of anchors, broadcast, against every block of vectors.

Scores are inner products of integer components in float64, exact as long as dimensions * (largest component)^2 is below
2^53; beyond that the operator raises. Higher scores come first, equal ones by smaller vec_id.

Anchors are the rows whose vec_id is divisible by `every`. They are numbered and taken BLOCK at a time, which bounds what is
broadcast and what comes to the driver (BLOCK vectors, then BLOCK * `positives` ids and scores); more anchors take more
passes over the vectors, which stay where they are: no vector is shuffled. In a pass every task multiplies its blocks with
the anchors and merges the best so far of each anchor with those of the next block, so it holds one tile of scores and
`positives` rows an anchor; Spark merges the tasks' lists. The second product of a pass knows the anchors' positives:
of each (anchor, positive) it keeps the first `negatives` rows of another label with low * positive_score <= 100 *
negative_score <= high * positive_score, merged in the same way. Every row is compared with every anchor; labels are never
dealt out, so it doesn't matter how many rows share one.

Rows with a null vec_id, label or vector, or any null or non-finite component, take no part. A row with the anchor's own
vec_id is never its positive or negative; rows that repeat a vec_id count each, anchors too. Vectors shorter than the longest
count as zero from their end on, empty ones as zero throughout. Other columns are not read. An empty table, or one without
anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, ship, staged

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
#: Anchors of a pass; anchors and vectors of a tile of scores.
BLOCK, SIDE, ROWS = 16_384, 256, 2048
PACKED = "ids binary, labels binary, vectors binary, width int, largest double"




def _pack(scale: float | None):
    """Batches of (vec_id, label, vector) to packed blocks of at most ROWS rows, without rows that have a non-finite component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, labels, lists = batch.slice(at, ROWS).columns
                n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                x = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
                ends = np.cumsum(n)
                wrong = np.r_[0, np.cumsum(~np.isfinite(x))]
                good = wrong[ends] == wrong[ends - n]
                if not good.any():
                    continue
                x, n = x[np.repeat(good, n)], n[good]
                if scale is not None:
                    x = np.floor(scale * x)
                full = np.zeros((n.size, int(n.max())))
                full[np.repeat(np.arange(n.size), n), np.arange(x.size) - np.repeat(np.cumsum(n) - n, n)] = x
                columns = [x.to_numpy(zero_copy_only=False).astype(np.int64)[good].tobytes() for x in (ids, labels)] + [full.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*columns, full.shape[1], float(np.abs(full).max(initial=0)))], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("largest", pa.float64())])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors of the common width) of every packed block."""
    for batch in batches:
        for row in batch.select(["ids", "labels", "vectors", "width"]).to_pylist():
            ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            x = np.frombuffer(row["vectors"], np.float64).reshape(ids.size, row["width"])
            yield ids, labels, x if row["width"] == width else np.pad(x, ((0, 0), (0, width - row["width"])))


class Best:
    """The first `k` of every slot by (score descending, id), merged batch by batch."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        #: Score and id of the k-th, from slots that have k.
        self.least, self.last = np.full(slots, -np.inf), np.full(slots, np.iinfo(np.int64).max)

    def sift(self, scores: np.ndarray, may: np.ndarray, slots: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a tile (slots by ids), what may still enter: slot, score, id."""
        may = may & (scores >= self.least[slots][:, None])
        if np.count_nonzero(may) > 4 * self.k * slots.size and ids.size > self.k:
            level = np.partition(np.where(may, scores, -np.inf), ids.size - self.k, axis=1)[:, ids.size - self.k]
            may &= scores >= level[:, None]
        i, j = np.nonzero(may)
        slot, score, which = slots[i], scores[i, j], ids[j]
        new = (score > self.least[slot]) | (which < self.last[slot])
        return slot[new], score[new], which[new]

    def merge(self, found: list[tuple[np.ndarray, ...]]) -> None:
        if not sum(x[0].size for x in found):
            return
        slot, score, which = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *found, strict=True))
        order = np.lexsort((which, -score, slot))
        slot, score, which = slot[order], score[order], which[order]
        first = np.r_[True, slot[1:] != slot[:-1]]
        place = np.arange(slot.size) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], which[keep]
        full = place == self.k - 1
        self.least[slot[full]], self.last[slot[full]] = score[full], which[full]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, self.slot.size, 65_536):
            part = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(x[part].astype(np.int64)) for x in (self.slot, self.score, self.id)], names=["slot", "score", "id"])


def _search(anchors, k: int, windows=None):
    """One pass over blocks: the best k of the anchor's label, or of each window (low, high per anchor and positive) of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, own = anchors.value
        low, high = (None, None) if windows is None else windows.value
        each = 1 if windows is None else low.shape[1]
        best = Best(own_ids.size * each, k)
        for ids, labels, x in _blocks(batches, own.shape[1]):
            for at in range(0, ids.size, ROWS):
                ids_, labels_, right = ids[at : at + ROWS], labels[at : at + ROWS], x[at : at + ROWS].T
                found = []
                for start in range(0, own_ids.size, SIDE):
                    some = np.arange(start, min(start + SIDE, own_ids.size))
                    scores, other = own[some] @ right, own_ids[some][:, None] != ids_
                    same = own_labels[some][:, None] == labels_
                    if windows is None:
                        found.append(best.sift(scores, same & other, some, ids_))
                        continue
                    for j in range(each):
                        found.append(best.sift(scores, (scores >= low[some, j][:, None]) & (scores <= high[some, j][:, None]) & other & ~same, some * each + j, ids_))
                best.merge(found)
        yield from best.batches()

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The tasks' lists merged: the first k rows of each slot, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _passes(anchors: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges of the anchors' numbers with `block` of them at most; one row for each partition and full block comes to the driver."""
    place = F.floor(F.col("number").bitwiseAND((1 << 33) - 1) / block)
    parts = anchors.groupBy(F.shiftright("number", 33), place).agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n")).select("lo", "hi", "n").collect()
    out: list[list[int]] = []
    for lo, hi, n in sorted(map(tuple, parts)):
        if out and out[-1][2] + n <= block:
            out[-1][1:] = hi, out[-1][2] + n
        else:
            out.append([lo, hi, n])
    return [(lo, hi) for lo, hi, _ in out]


def hard_negatives(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: float | None = None, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Components become floor(scale * x) if a
    scale is given, else they must be whole numbers."""
    spark = ship(embeddings.sparkSession)
    rows = embeddings.select(column(key).cast("long").alias("id"), column(label).cast("long").alias("label"), column(vector).cast("array<double>").alias("vector")).dropna()
    packed = staged(rows.mapInArrow(_pack(scale), PACKED), "vectors")
    width, largest = packed.agg(F.coalesce(F.max("width"), F.lit(0)), F.coalesce(F.max("largest"), F.lit(0.0))).first()
    if width * largest * largest >= 2**53:
        raise ValueError(f"scores of {width} components up to {largest:g} may leave the range of exact float64 integers; give a smaller scale")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x in _blocks(batches, width):
            at = np.flatnonzero(ids % every == 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(labels[at]), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["id", "label", "vector"])

    anchors = staged(packed.mapInArrow(chosen, "id long, label long, vector binary").withColumn("number", F.monotonically_increasing_id()), "anchors")
    out = [_pass(spark, packed, anchors.filter(F.col("number").between(*x)), width, positives, negatives, low, high) for x in _passes(anchors, block)]
    discard(packed, anchors)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(out[0].schema).parquet(*(x.staged_at for x in out))


def _pass(spark, packed: DataFrame, anchors: DataFrame, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Positives and negatives of one block of anchors, written to the shared folder."""
    got = anchors.select("id", "label", "vector").collect()
    ids, labels = (np.array([r[k] for r in got], np.int64) for k in ("id", "label"))
    matrix = np.frombuffer(b"".join(r["vector"] for r in got), np.float64).reshape(ids.size, width)
    held = [spark.sparkContext.broadcast((ids, labels, matrix))]
    kind = "slot long, score long, id long"
    first = _first(packed.mapInArrow(_search(held[0], positives), kind), positives).collect()
    best, score = np.full((ids.size, positives), -1), np.zeros((ids.size, positives), np.int64)
    bounds = np.full((ids.size, positives), np.inf), np.full((ids.size, positives), -np.inf)
    for r in first:
        at = r["slot"], r["rank"] - 1
        best[at], score[at] = r["id"], r["score"]
        bounds[0][at], bounds[1][at] = -(-low * r["score"] // 100), high * r["score"] // 100
    held.append(spark.sparkContext.broadcast(bounds))
    found = _first(packed.mapInArrow(_search(held[0], negatives, held[1]), kind), negatives)
    held.append(spark.sparkContext.broadcast((ids, best, score)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, positive, value = held[2].value
        for batch in batches:
            slot = batch.column(0).to_numpy()
            i, j = slot // positive.shape[1], slot % positive.shape[1]
            own = [anchor[i], positive[i, j], batch.column("rank"), batch.column("id"), value[i, j], batch.column("score")]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in own], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    out = staged(found.mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "hard-negatives")
    for x in held:
        x.unpersist()
    return out
