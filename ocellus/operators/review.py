"""Selections for review, fingerprints, gates and the upload queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(name: Column) -> list[Column]:
    """Numeric stems first, by number, then the others by text."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    number = stem.try_cast("bigint")
    return [number.isNull(), number, stem]


def spaced_samples(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """n evenly spaced rows of the ordered table: positions round(i (N - 1) / (n - 1)), half to even.

    Positions come from a range-partitioned sort and the partitions' row counts, not from one global window.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    counts = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, c in counts:
        starts.append((p, total))
        total += c
    if not total:
        return df.limit(0).withColumn("sample", F.lit(0))
    wanted = [(i, round(i * (total - 1) / (n - 1)) if n > 1 else 0) for i in range(n)]
    first = spark.createDataFrame(starts, "_part int, _start long")
    placed = parts.join(F.broadcast(first), "_part").withColumn("_row", F.col("_at") + F.col("_start"))  # one row per partition
    return placed.join(F.broadcast(spark.createDataFrame(wanted, "sample int, _row long")), "_row").drop("_row", "_part", "_at", "_start")  # n rows


def priority_union(lists: Sequence[tuple[DataFrame, Sequence[Column]]], key: str, most: int) -> DataFrame:
    """Rows of several lists, each in its order: a key counts in the first list that has it; the first `most` stay.

    Each list is cut to `most` before it is ranked, as no more of it can matter.
    """
    ranked = None
    for priority, (df, order) in enumerate(lists):
        top = df.orderBy(*order).limit(most).select(F.col(key), F.lit(priority).alias("priority"), F.row_number().over(Window.orderBy(*order)).alias("place"))
        ranked = top if ranked is None else ranked.unionByName(top)
    best = ranked.groupBy(key).agg(F.min(F.struct("priority", "place")).alias("b")).select(key, "b.priority", "b.place")
    return best.orderBy("priority", "place", key).limit(most)


def table_fingerprint(df: DataFrame, key: str, *columns: str, digits: int = 2) -> DataFrame:
    """SHA-256 over the rows' own digests in order: rows are digested where they are, gathered per group of keys, then over groups.
    There are 16 ** digits groups, so a larger table takes more digits (and then has another fingerprint)."""
    row = F.sha2(F.concat_ws("|", F.col(key).cast("string"), *(F.col(c).cast("string") for c in columns)), 256)
    part = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits)
    groups = df.groupBy(part.alias("part")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(row))), 256).alias("d"))
    return groups.agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda s: s["d"])), 256).alias("fingerprint"))


def acceptance(old: dict[str, float], new: dict[str, float]) -> dict[str, bool]:
    """Six checks that a corrected model must pass against the one before. Keys: auc, sensitivity, specificity, box_lift
    and peaks_in_box of positives, corner_attention of negatives."""
    return {
        "auc_kept": new["auc"] >= old["auc"] - 0.01,
        "sensitivity": new["sensitivity"] >= 0.95,
        "specificity": new["specificity"] >= 0.90,
        "box_lift_kept": new["box_lift"] >= old["box_lift"],
        "peaks_in_box_kept": new["peaks_in_box"] >= old["peaks_in_box"],
        "corner_attention_lower": new["corner_attention"] < old["corner_attention"],
    }


def parity_gate(parity: DataFrame, most: float) -> DataFrame:
    return parity.withColumn("accepted", (F.col("max_difference") <= most) & (F.col("agreement") == 1.0))


def changed_decisions(df: DataFrame, key: str, old: str, new: str, threshold: float) -> DataFrame:
    a, b = F.col(old) >= threshold, F.col(new) >= threshold
    return df.filter(a != b).select(key, old, new, a.cast("int").alias("old_decision"), b.cast("int").alias("new_decision"))


def pending(queue: DataFrame) -> DataFrame:
    return queue.filter("NOT uploaded")


def mark_uploaded(queue: DataFrame, done: DataFrame) -> DataFrame:
    hit = done.select("uri").distinct().withColumn("_done", F.lit(True))
    return queue.join(hit, "uri", "left").withColumn("uploaded", F.col("uploaded") | F.coalesce("_done", F.lit(False))).select(*queue.columns)


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Insert if absent; the uri is the key."""
    fresh = new.dropDuplicates(["uri"]).join(queue.select("uri"), "uri", "left_anti").withColumn("uploaded", F.lit(False))
    return queue.unionByName(fresh.select(*queue.columns))
