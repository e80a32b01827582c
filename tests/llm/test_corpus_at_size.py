"""Plans that failed only on larger corpora."""

import random

import numpy as np
from pyspark.sql import functions as F

from ocellus.llm import exact_dedup, simhash_dedup
from ocellus.llm.components import components
from tests.llm.test_llm import frame, prose


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_and_components_broadcast_nothing(spark):
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    assert "BroadcastHashJoin" not in plan(simhash_dedup.linked(fps))
    docs = frame(spark, [prose(40) for _ in range(5)])
    assert "BroadcastHashJoin" not in plan(simhash_dedup.simhash_components(docs))
    assert "BroadcastHashJoin" not in plan(components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")))


def test_near_copies_are_first_looked_up_by_fingerprints(spark):
    """Documents with equal or linked fingerprints of five-word shingles are candidates without a common bucket."""
    rng = random.Random(3)
    texts = [prose(400, rng) for _ in range(6)]
    texts += [" ".join([*t.split()[:-1], "zz"]) for t in texts] + [texts[0]]
    found = simhash_dedup.map_texts(frame(spark, texts), simhash_dedup._signatures(5), "sha binary, keys array<long>, sketch binary, fp long").withColumnRenamed("doc_id", "node")
    rows = {r["node"]: r["fp"] for r in found.collect()}
    want = simhash_dedup.majority([simhash_dedup.shingle_hashes(t.encode(), 5) for t in texts]).astype(np.int64)
    assert all(rows[i] == fp for i, fp in zip(sorted(rows), want.tolist(), strict=True))
    near = {(a, b) for a in rows for b in rows if a < b and ((rows[a] ^ rows[b]) & (1 << 64) - 1).bit_count() <= 3}
    got = {(r["a"], r["b"]) for r in simhash_dedup._near_fingerprints(found).collect()}
    assert got <= near and got and simhash_dedup.components(spark.createDataFrame(sorted(got), "a long, b long")).count() == len({x for p in near for x in p})


def test_texts_are_dealt_once_where_no_row_repeats(spark):
    texts = [prose(30), prose(30), prose(20), prose(25)]
    once = frame(spark, [*texts, texts[0].upper()], [1, 2, 3, None, 9])
    kept = exact_dedup.without_copies(once)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "9", "None"]
    assert "HashAggregate" not in plan(kept) and "SortAggregate" not in plan(kept)
    twice = once.unionByName(once)
    assert sorted(str(r["doc_id"]) for r in exact_dedup.without_copies(twice).collect()) == ["2", "3", "9", "None"]


def shuffled(spark):
    """Bytes that each stage so far, of those that Spark still knows, has written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_only_texts_of_candidates_are_moved(spark):
    """Also where the table of candidates is too large for Spark to broadcast it."""
    rng = random.Random(5)
    texts = [" ".join(rng.randbytes(6).hex() for _ in range(4000)) for _ in range(120)]
    docs = frame(spark, [*texts, texts[7] + " tail"])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = max(shuffled(spark), default=-1)
        assert {tuple(r) for r in simhash_dedup.similar_groups(docs).collect()} == {(7, 7), (120, 7)}
        assert 0 < sum(n for stage, n in shuffled(spark).items() if stage > last) < 0.3 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_bitmap_of_digests_loses_none(spark):
    rows = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("sha"), "id")
    got = {r["id"] for r in simhash_dedup._likely(rows, rows.filter("id % 3 = 0").select("sha")).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1100
    assert simhash_dedup._likely(rows, rows.filter("id < 0").select("sha")).count() == 0
