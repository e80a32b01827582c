"""Corpus preparation in five stages, each written as Parquet and read again by the next.

Toxic documents go; of exact copies the one with the largest doc_id stays; of near copies (five-word shingles,
similarity 0.8 or more) the one with the smallest; documents that hold a benchmark window go; the rest is encoded.

Defined cases, the same in every stage: a null text counts as empty and is kept once; empty texts are copies of each
other; texts of any length are taken whole; rows are known by doc_id and text, so rows that share an id or have none are
judged each by its text, and of rows that repeat both one stays; of equal texts a null id counts as the smallest in the
second stage, of near copies as the largest in the third; extra columns of any name pass through the stages before the
last; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm import bpe, decontaminate, exact_dedup, simhash_dedup, toxicity
from ocellus.llm.common import discard, read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, known by its id and the digest of its text; a null id counts as the largest. Linked SimHash
    fingerprints give the first candidates, buckets of minimum hashes those that are further apart; each is decided exactly."""
    return simhash_dedup.without_similar(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: SQL can't express the toxicity model, the near copies or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's result, read back. A stage's table is deleted when the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(docs)
        docs = spark.read.parquet(path)
        docs.staged_at = path
    return docs
