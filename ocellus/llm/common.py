"""Helpers shared by the corpus operators: shipping code, Arrow batches, checkpoints, small model tables."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step holds at a time; a single longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(range(65)) + LOWER.encode() + bytes(range(91, 256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Session setting that bounds the bytes of a batch on its way to a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by sys.path; on a cluster use --py-files. Batches
    on their way to the workers are bounded to CHUNK_BYTES (one row at least), unless the session has a smaller bound."""
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(BATCH_BYTES))
    if held is None or int(held[1]) > CHUNK_BYTES:
        spark.conf.set(BATCH_BYTES, str(CHUNK_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    return spark


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc_id array, texts) pieces of the batches, each of about `limit` text bytes at most.

    The pieces are cut by the texts' lengths first; only one piece at a time becomes Python objects.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield ids.slice(start, stop - start), byte_texts(texts.slice(start, stop - start))
            start = stop


def map_texts(docs: DataFrame, func: Callable[[list[bytes]], dict[str, object]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key and what `func` returns for each chunk's texts.

    Only the two named columns are read, so other columns may have any names.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            found = func(texts)
            yield pa.RecordBatch.from_arrays([ids, *(x if isinstance(x, pa.Array) else pa.array(x) for x in found.values())], names=[key, *found])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {schema}")


def keep_texts(docs: DataFrame, test: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text passes; no shuffle. Columns go through by place, whatever their names."""
    ship(docs.sparkSession)
    at_text, placed = docs.columns.index(text), docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in chunks(iter([pa.RecordBatch.from_arrays([batch.column(at_text)] * 2, names=["key", "text"])])):
                yield batch.slice(at, len(texts)).filter(pa.array(test(texts), pa.bool_()))
                at += len(texts)

    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_fold(doc_id: object, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else (local runs and tests only) a folder in /tmp."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write as a Parquet table in the shared folder and read it again: compact, pruned by column, free of lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        if path := getattr(table, "staged_at", None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that Spark's hash puts there, so that parts and partitions are one to one."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(0, 40 * n + 200, 1, 1).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
    first = {r["place"]: r["id"] for r in found}
    free = iter(range(40 * n + 200, 42 * n + 200))
    return [first[p] if p in first else next(free) for p in range(n)]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of docs, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
