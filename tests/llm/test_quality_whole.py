"""The quality dictionaries take every block of the sampled texts, in shards of bounded size."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ocellus.llm import quality


def test_every_block_reaches_the_dictionaries(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    told = " ".join(word() for _ in range(12))  # stands once a document, deep in each long text
    rows, labels = [], []
    for i in range(400):
        filler = " ".join(word() for _ in range(2000))  # about ten blocks of 2 KB
        rows.append((i, filler[:9000] + told + filler[9000:] if i % 2 else filler))
        labels.append((i, i % 2))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks)
    assert told[10:60].encode() in model.good and told[10:60].encode() not in model.bad
    assert quality.fit(docs.repartition(13), marks).good == model.good  # however the rows lie


def test_shards_meet_in_levels(spark):
    where = spark.conf.get("spark.checkpoint.dir", "/tmp/checkpoints")
    have = set(os.listdir(where)) if os.path.isdir(where) else set()
    blocks = spark.range(6000).select((F.col("id") % 2).cast("int").alias("y"), F.xxhash64("id").alias("place"), F.encode(F.concat_ws(" ", F.lit("common words of the class"), F.col("id") % 2, F.sha2(F.col("id").cast("string"), 512), F.lit("and its end")), "UTF-8").alias("block"))
    found = quality.dictionaries(blocks, 4 * quality.DICTIONARY_BYTES)
    assert found.keys() == {0, 1} and all(b"common words of the class" in x for x in found.values())
    assert not any(x.startswith("dictionaries") for x in set(os.listdir(where)) - have)  # what the levels wrote is gone
    assert quality.dictionaries(blocks.limit(0)) == {}
    with pytest.raises(ValueError):
        quality.dictionaries(blocks, 1000)
