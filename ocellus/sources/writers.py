"""Sinks: fixed-order CSV, JSON summaries, per-frame partitions, append-only results, fingerprint-locked results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, fields: Sequence[str], mode: str = "overwrite") -> None:
    """Header CSV with exactly these fields in order; a missing field or null is empty, another column is an error."""
    if extra := [c for c in df.columns if c not in fields]:
        raise ValueError(f"unexpected columns: {', '.join(extra)}")
    out = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields))
    out.write.mode(mode).csv(path, header=True, emptyValue="", escape='"')


def json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def frames(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sidecar rows by video and frame; rows of a frame are brought together first, so it is one file."""
    df.repartition("video_id", "frame").write.mode(mode).partitionBy("video_id", "frame").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True, escape='"')


def locked(spark, path: str, fingerprint: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of this fingerprint, computed and stored only if there is none.

    It is written beside its place and renamed when it is whole, so a reader never sees a part; of two writers at once the
    first to rename stays, and both read its result.
    """
    place = f"{path.rstrip('/')}/fingerprint={fingerprint}"
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(place).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(paths(f"{place}/_SUCCESS")):
        made = f"{path.rstrip('/')}/_made-{uuid.uuid4().hex}"
        compute().write.parquet(made)
        if files.exists(paths(place)) or not files.rename(paths(made), paths(place)):
            files.delete(paths(made), True)
    return spark.read.parquet(place)


def markdown(row: dict[str, object], title: str) -> str:
    """A one-row result as a report."""
    return "\n".join([f"# {title}", "", "| Field | Value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in row.items()), ""])


def coefficients(df: DataFrame, path: str, degree: int) -> None:
    """Surface coefficients (key, coefficients) with the degree of their basis, as Parquet."""
    size = (degree + 1) * (degree + 2) // 2
    whole = F.when(F.size("coefficients") == size, F.col("coefficients")).otherwise(F.raise_error(F.lit(f"degree {degree} has {size} coefficients")).cast("array<double>"))
    df.withColumn("coefficients", whole).withColumn("degree", F.lit(degree)).write.parquet(path)
