"""Driver queries of the library's own operators, with DuckDB SQL for each.

The shared test tables hold no pictures or videos, so each operator runs on a table with the same algebra: hourly
event values stand for a frame signal, embeddings for 8 x 8 heat-maps, line items for ring points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, events, grid, metrics, neardup, polar, review, signal, split, surface

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- audit


@query("""
    SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN bool_or(event_type = 'error') THEN 1 WHEN bool_and(event_type IN ('view', 'click')) THEN 0 END AS label, count(*) AS n_rows
    FROM events GROUP BY ALL""")
def q01_label_rule(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return audit.label_rule(e, ["user_id", "day"], "event_type", "error", ["view", "click"])


@query("""
    SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_linenumber) AS n_distinct,
        min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS consistent
    FROM lineitem GROUP BY l_orderkey""")
def q02_consistency(spark, sf_dir):
    return audit.numbering(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 1)


@query("""
    SELECT o_orderkey, count(l_orderkey) AS matches, CASE count(l_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'single' ELSE 'ambiguous' END AS status
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q03_match_status(spark, sf_dir):
    return audit.match_status(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q04_unannotated(spark, sf_dir):
    return audit.unmatched(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


_SHA = "sha256(coalesce(text, ''))"


@query(f"""
    SELECT {_SHA} AS digest, count(*) AS n, 'group_' || substr(sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)), 1, 12) AS duplicate_group,
        count(DISTINCT source) > 1 AS conflict, min(doc_id) AS first_id
    FROM documents GROUP BY 1 HAVING count(*) > 1""")
def q05_exact_duplicates(spark, sf_dir):
    return audit.duplicates(table(spark, sf_dir, "documents"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), "source")


@query("""
    SELECT issue, count(*) AS n FROM (SELECT unnest([CASE WHEN o_totalprice < 1000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END]) AS issue FROM orders)
    WHERE issue IS NOT NULL GROUP BY issue""")
def q06_issue_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rules = [("cheap", F.col("o_totalprice") < 1000), ("pending", F.col("o_orderstatus") == "P"), ("urgent", F.col("o_orderpriority") == "1-URGENT")]
    return audit.issue_counts(o.withColumn("issues", audit.issue_list(rules)))


@query("SELECT CAST(floor(CAST(props ->> '$.k' AS INTEGER) / 10.0) AS INTEGER) AS bucket, count(*) AS n, sum(CAST(props ->> '$.k' AS INTEGER))::BIGINT AS total FROM events GROUP BY 1")
def q07_json_attributes(spark, sf_dir):
    k = F.from_json("props", "k INT", {"mode": "FAILFAST"})["k"]
    return table(spark, sf_dir, "events").select(k.alias("k")).groupBy(F.floor(F.col("k") / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT doc_id, lang, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND n_chars >= 100 AND lang <> 'xx'")
def q08_selected(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    rules = [("short", F.col("n_chars") < 100), ("language", F.col("lang") == "xx")]
    return audit.selected(d.withColumn("issues", audit.issue_list(rules)).withColumn("label", F.when(F.col("quality").isin(0, 1), F.col("quality")))).select("doc_id", "lang", "n_chars")


# ---------------------------------------------------------------- metrics

_SCORED = "s AS (SELECT doc_id, lang, quality AS label, least(1000, n_chars // 4)::DOUBLE / 1000 AS score FROM documents JOIN labels USING (doc_id))"
_COUNTS = "count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score < t) AS tn, count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 1 AND score < t) AS fn"
_RATES = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0.0 END AS specificity"
_CANDIDATES = "c AS (SELECT DISTINCT t FROM (SELECT (score + lag(score) OVER (ORDER BY score)) / 2 AS t FROM (SELECT DISTINCT score FROM s) UNION ALL SELECT unnest([0.0, 0.5, 1.0])) WHERE t IS NOT NULL)"


def scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").alias("label"), (F.least(F.lit(1000), F.floor(F.col("n_chars") / 4)).cast("double") / 1000).alias("score"))


@query(f"WITH {_SCORED}, k AS (SELECT {_COUNTS.replace('>= t', '>= 0.5').replace('< t', '< 0.5')} FROM s), r AS (SELECT *, {_RATES} FROM k) SELECT tp, tn, fp, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round((sensitivity + specificity) / 2, 6) AS balanced_accuracy FROM r")
def q09_confusion(spark, sf_dir):
    return rounded(metrics.confusion(scored(spark, sf_dir), "label", "score", 0.5))


def _wilson(name: str, hits: str, n: str) -> str:
    z = scalars.Z95
    mid, reach = f"({hits} / ({n})::DOUBLE + {z * z} / (2 * ({n})))", f"{z} * sqrt({hits} / ({n})::DOUBLE * (1 - {hits} / ({n})::DOUBLE) / ({n}) + {z * z} / (4 * ({n}) * ({n})))"
    return f"round(greatest(0, ({mid} - {reach}) / (1 + {z * z} / ({n}))), 6) AS {name}_low, round(least(1, ({mid} + {reach}) / (1 + {z * z} / ({n}))), 6) AS {name}_high"


@query(f"""
    WITH {_SCORED}, k AS (SELECT {_COUNTS.replace('>= t', '>= 0.5').replace('< t', '< 0.5')} FROM s), r AS (SELECT *, {_RATES}, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS "precision" FROM k)
    SELECT tp, tn, fp, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round((sensitivity + specificity) / 2, 6) AS balanced_accuracy, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
        round(2 * "precision" * sensitivity / ("precision" + sensitivity), 6) AS f1, {_wilson('sensitivity', 'tp', 'tp + fn')}, {_wilson('specificity', 'tn', 'tn + fp')}, {_wilson('accuracy', '(tp + tn)', 'tp + tn + fp + fn')}
    FROM r""")
def q10_full_metrics(spark, sf_dir):
    return rounded(metrics.full_metrics(scored(spark, sf_dir), "label", "score", 0.5))


_CURVE = f"WITH {_SCORED}, {_CANDIDATES}, k AS (SELECT t, {_COUNTS} FROM c, s GROUP BY t), curve AS (SELECT *, (sensitivity + specificity) / 2 AS balanced_accuracy FROM (SELECT *, {_RATES} FROM k))"
_CURVE_OUT = "SELECT round(t, 6) AS threshold, tp, tn, fp, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(balanced_accuracy, 6) AS balanced_accuracy FROM curve"


@query(f"{_CURVE} {_CURVE_OUT}")
def q11_threshold_curve(spark, sf_dir):
    return rounded(metrics.threshold_curve(scored(spark, sf_dir), "label", "score"))


@query(f"{_CURVE} {_CURVE_OUT} ORDER BY round(curve.balanced_accuracy, 12) DESC, round(curve.sensitivity, 12) DESC, round(curve.specificity, 12) DESC, abs(t - 0.5), t LIMIT 1")
def q12_best_threshold(spark, sf_dir):
    return rounded(metrics.best_threshold(metrics.threshold_curve(scored(spark, sf_dir), "label", "score")))


@query(f"""
    WITH {_SCORED.replace('JOIN labels USING (doc_id)', "JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr')")}, {_CANDIDATES}, k AS (SELECT t, lang, {_COUNTS} FROM c, s GROUP BY t, lang), r AS (SELECT *, {_RATES} FROM k),
    m AS (SELECT t, min(sensitivity) AS a, min(specificity) AS b, min((sensitivity + specificity) / 2) AS d, sum(sensitivity) AS e FROM r GROUP BY t)
    SELECT round(t, 6) AS threshold, round(a, 6) AS least_sensitivity, round(b, 6) AS least_specificity, round(d, 6) AS least_balanced, round(e, 6) AS sum_sensitivity
    FROM m ORDER BY a >= 0.9 DESC, round(b, 12) DESC, round(d, 12) DESC, round(e, 12) DESC, t LIMIT 1""")
def q13_two_domain_threshold(spark, sf_dir):
    return rounded(metrics.two_domain_threshold(scored(spark, sf_dir).filter(F.col("lang").isin("en", "fr")), "label", "score", "lang", "en", "fr"))


@query(f"""
    WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY score)
    SELECT round((SELECT sum(a.p * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM g a, g b) / sum(p) / sum(n), 6)::DOUBLE AS auc, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM g""")
def q14_roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir), "label", "score"))


@query(f"""
    WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY score)
    SELECT score::DOUBLE AS score, round(sum(p) OVER w / (SELECT sum(p) FROM g)::DOUBLE, 6) AS tpr, round(sum(n) OVER w / (SELECT sum(n) FROM g)::DOUBLE, 6) AS fpr FROM g WINDOW w AS (ORDER BY score DESC)""")
def q15_roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(scored(spark, sf_dir), "label", "score"))


@query("SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM labels GROUP BY quality")
def q16_class_weights(spark, sf_dir):
    return rounded(metrics.class_weights(table(spark, sf_dir, "labels"), "quality"))


@query("""
    WITH x AS (SELECT p_retailprice / 10000 AS a, CAST(p_retailprice / 10000 AS FLOAT)::DOUBLE AS b FROM part)
    SELECT count(*) AS n, round(max(abs(a - b)), 12) AS max_difference, round(avg(abs(a - b)), 12) AS mean_difference, avg(CASE WHEN (a >= 0.15) = (b >= 0.15) THEN 1.0 ELSE 0.0 END)::DOUBLE AS agreement, max(abs(a - b)) <= 1e-5 AND bool_and((a >= 0.15) = (b >= 0.15)) AS accepted FROM x""")
def q17_parity_gate(spark, sf_dir):
    x = table(spark, sf_dir, "part").select((F.col("p_retailprice") / 10000).alias("a")).withColumn("b", F.col("a").cast("float").cast("double"))
    return rounded(review.parity_gate(metrics.parity(x, "a", "b", 0.15), 1e-5), 12)


# ---------------------------------------------------------------- near duplicates, groups, splits

_HASH = "h AS (SELECT vec_id, label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 2] > embedding[i + 1] THEN 1::HUGEINT << i ELSE 0 END))::BIGINT AS code FROM embeddings)"
_PAIRS = f"{_HASH}, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.code, b.code))::INTEGER AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.code, b.code)) <= 18)"


def hashed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", neardup.sign_hash(F.col("embedding")).alias("code"))


def near_pairs(spark, sf_dir):
    return neardup.hamming_pairs(hashed(spark, sf_dir), "vec_id", "code", 18, 63)


@query(f"WITH {_PAIRS} SELECT a, b, distance FROM pairs")
def q18_hamming_pairs(spark, sf_dir):
    return near_pairs(spark, sf_dir)


@query(f"""
    WITH {_HASH}, t AS (SELECT label, i, sum(floor(256 * embedding[i]::DOUBLE))::BIGINT AS x FROM embeddings, unnest(range(1, 65)) u(i) GROUP BY ALL), l AS (SELECT label, list(x ORDER BY i) AS x FROM t GROUP BY label),
    c AS (SELECT label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN x[i + 2] > x[i + 1] THEN 1::HUGEINT << i ELSE 0 END))::BIGINT AS code FROM l)
    SELECT vec_id, r.reference, r.distance FROM (SELECT h.vec_id, min({{'distance': bit_count(xor(h.code, c.code))::INTEGER, 'reference': c.label}}) AS r FROM h, c GROUP BY h.vec_id)""")
def q19_nearest_reference(spark, sf_dir):
    """The label whose summed vector's hash is nearest to each row's."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.floor(256 * F.col("x").cast("double"))).alias("x"))
    sums = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # one entry a component
    return neardup.nearest_reference(hashed(spark, sf_dir), "vec_id", "code", sums.select("label", neardup.sign_hash(F.col("v.x")).alias("code")), "label", "code")


@query(f"""
    WITH {_PAIRS} SELECT a, b, distance, CASE WHEN distance <= 14 THEN 'exact' WHEN (a + b) % 5 = 0 THEN 'confirmed' WHEN (a + b) % 7 = 0 THEN 'rejected' ELSE 'review_required' END AS status FROM pairs""")
def q20_pair_status(spark, sf_dir):
    pairs = near_pairs(spark, sf_dir)
    total = F.col("a") + F.col("b")
    decided = pairs.filter((total % 5 == 0) | (total % 7 == 0)).select(F.col("b").alias("a"), F.col("a").alias("b"), F.when(total % 5 == 0, "confirmed").otherwise("rejected").alias("decision"))
    return neardup.pair_status(pairs, decided, F.col("distance") <= 14)


@query(f"""
    WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(node, other) AS (SELECT vec_id, vec_id FROM h UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
    roots AS (SELECT node, min(other) AS root FROM r GROUP BY node)
    SELECT root, 'group_' || substr(sha256(string_agg(node::VARCHAR, chr(10) ORDER BY node::VARCHAR)), 1, 12) AS similarity_group, count(*) AS size FROM roots GROUP BY root""")
def q21_components(spark, sf_dir):
    return neardup.named_groups(neardup.connected(near_pairs(spark, sf_dir), hashed(spark, sf_dir), "vec_id"), "vec_id")


@query(f"SELECT {_SHA} AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def q22_first_seen(spark, sf_dir):
    return audit.first_seen(table(spark, sf_dir, "documents"), F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id", "source")


_SPLIT = "s AS (SELECT *, CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(sha256('20260916|' || c_nationkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS place FROM customer))"


@query(f"WITH {_SPLIT} SELECT split, count(*) FILTER (c_mktsegment = 'BUILDING') AS positive, count(*) FILTER (c_mktsegment <> 'BUILDING') AS negative, count(*) AS total FROM s GROUP BY split")
def q23_group_split(spark, sf_dir):
    c = split.split_by_fraction(table(spark, sf_dir, "customer"), "c_nationkey").withColumn("y", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    return split.split_counts(c, "y")


@query(f"WITH {_SPLIT.replace('c_nationkey', 'c_custkey')} SELECT c_nationkey, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def q24_split_violations(spark, sf_dir):
    return split.split_violations(split.split_by_fraction(table(spark, sf_dir, "customer"), "c_custkey"), "c_nationkey")


@query()
def q25_stratified_split(spark, sf_dir):
    """Whole nations to exact targets, by segment group; checked in tests against its own rules."""
    c = table(spark, sf_dir, "customer").withColumn("y", (F.col("c_nationkey") % 2).cast("int"))
    n = {r["y"]: r["n"] for r in c.groupBy("y").agg(F.count("*").alias("n")).collect()}
    done = split.stratified_split(c, "c_nationkey", "y", {y: (n.get(y, 0) * 7 // 10, n.get(y, 0) * 15 // 100) for y in (0, 1)})
    return split.split_counts(done, "y")


# ---------------------------------------------------------------- signals: hourly sums of event values, one series per type

_HOURLY = "hourly AS (SELECT event_type AS series, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS hour, sum(value) AS v FROM events GROUP BY 1, 2), num AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM hourly)"


def hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.sum("value").alias("v"))


def _mirror(pad: int) -> str:
    return f"ext AS (SELECT series, i, n, v FROM num UNION ALL SELECT series, -i, n, v FROM num WHERE i BETWEEN 1 AND {pad} UNION ALL SELECT series, 2 * (n - 1) - i, n, v FROM num WHERE i <= n - 2 AND i >= n - 1 - {pad})"


_SMOOTH = f"{_HOURLY}, {_mirror(2)}, smooth AS (SELECT * FROM (SELECT series, i, n, avg(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM ext) WHERE i BETWEEN 0 AND n - 1)"
_GRADED = f"{_SMOOTH}, zed AS (SELECT series, i, (s - avg(s) OVER p) / stddev_pop(s) OVER p AS z FROM smooth WINDOW p AS (PARTITION BY series)), graded AS (SELECT series, i, z, z - lag(z, 2) OVER (PARTITION BY series ORDER BY i) AS g FROM zed)"


@query(f"WITH {_SMOOTH} SELECT series, hour, round(s, 6) AS smooth FROM smooth JOIN num USING (series, i)")
def q26_reflect_mean(spark, sf_dir):
    return rounded(signal.reflect_mean(hourly(spark, sf_dir), "series", "hour", "v", 5).select("series", "hour", "smooth"))


def graded(spark, sf_dir):
    z = signal.z_score(signal.reflect_mean(hourly(spark, sf_dir), "series", "hour", "v", 5), "series", "smooth")
    return signal.central_difference(z, "series", "hour", "z")


@query(f"WITH {_GRADED} SELECT series, hour, round(g, 6) AS gradient FROM graded JOIN num USING (series, i) WHERE g IS NOT NULL")
def q27_z_gradient(spark, sf_dir):
    return rounded(graded(spark, sf_dir).filter("gradient IS NOT NULL").select("series", "hour", "gradient"))


@query(f"""
    WITH {_GRADED}, near AS (SELECT *, lag(g) OVER w AS b, lead(g) OVER w AS a FROM graded WINDOW w AS (PARTITION BY series ORDER BY i))
    SELECT series, hour, round(g, 6) AS gradient FROM near JOIN num USING (series, i) WHERE g >= 0.5 AND g > b AND g > a""")
def q28_local_peaks(spark, sf_dir):
    return rounded(signal.local_peaks(graded(spark, sf_dir), "series", "hour", "gradient", 0.5).select("series", "hour", "gradient"))


@query(f"""
    WITH {_HOURLY}, {_mirror(25)}, wide AS (SELECT * FROM (SELECT series, i, n, avg(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS s FROM ext) WHERE i BETWEEN 0 AND n - 1),
    slim AS (SELECT series, i, hour, sum(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS l FROM num)
    SELECT series, hour, round(s - l, 6) AS signal FROM wide JOIN slim USING (series, i)""")
def q30_background_difference(spark, sf_dir):
    return rounded(signal.background_difference(hourly(spark, sf_dir), "series", "hour", "v").select("series", "hour", "signal"))


@query(f"""
    WITH {_HOURLY}, ext AS (SELECT series, i, n, v FROM num UNION ALL SELECT series, i - n, n, v FROM num WHERE i >= n - 25 UNION ALL SELECT series, i + n, n, v FROM num WHERE i < 25),
    m AS (SELECT series, i, n, median(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS a, median(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS b FROM ext)
    SELECT series, hour, round(CASE WHEN abs(a - b) / (b + 1e-9) > 0.05 THEN b ELSE a END, 6) AS median FROM m JOIN num USING (series, i)""")
def q31_dual_median(spark, sf_dir):
    return rounded(signal.dual_median(hourly(spark, sf_dir), "series", "hour", "v").select("series", "hour", "median"))


@query(f"""
    WITH {_HOURLY}, f AS (SELECT *, i - row_number() OVER (PARTITION BY series ORDER BY i) AS g FROM num WHERE v >= 40)
    SELECT series, min(hour) AS first, max(hour) AS last, count(*) AS length FROM f GROUP BY series, g HAVING count(*) >= 2""")
def q32_runs(spark, sf_dir):
    return signal.runs(hourly(spark, sf_dir), "series", "hour", F.col("v") >= 40, 2)


@query(f"""
    WITH {_HOURLY}, st AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY series ORDER BY i)) AS step FROM num), j AS (SELECT series, i AS jump FROM st WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY step DESC, i) = 1),
    af AS (SELECT num.*, jump FROM num JOIN j USING (series) WHERE i >= jump + 2), lv AS (SELECT series, avg(v) AS level FROM af WHERE i < jump + 7 GROUP BY series HAVING count(v) >= 3),
    lo AS (SELECT series, i, hour, i - row_number() OVER (PARTITION BY series ORDER BY i) AS g FROM af JOIN lv USING (series) WHERE v < 0.78 * level),
    dr AS (SELECT series, min(h) AS drop_at FROM (SELECT series, g, min(hour) AS h FROM lo GROUP BY series, g HAVING count(*) >= 3) GROUP BY series)
    SELECT series, jump, round(level, 6) AS level, drop_at FROM j LEFT JOIN lv USING (series) LEFT JOIN dr USING (series)""")
def q33_sustained_drop(spark, sf_dir):
    return rounded(signal.sustained_drop(hourly(spark, sf_dir), "series", "hour", "v"))


@query(f"""
    WITH {_HOURLY}, h AS (SELECT series, hour, CASE WHEN hour % 7 <> 0 THEN v END AS v FROM hourly)
    SELECT series, hour, round(coalesce(v, avg(v) OVER (PARTITION BY series ORDER BY hour ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), avg(v) OVER (PARTITION BY series)), 6) AS filled FROM h""")
def q34_local_fill(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("v", F.when(F.col("hour") % 7 != 0, F.col("v")))
    return rounded(signal.local_fill(h, "series", "hour", "v").select("series", "hour", "filled"))


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) / 86400.0 AS day FROM orders), g AS (SELECT *, day - lag(day) OVER w AS gap FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)),
    k AS (SELECT *, row_number() OVER w - 1 AS k, avg(gap) OVER p AS m, stddev_pop(gap) OVER p AS d FROM g WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o_custkey, o_orderkey, round(gap, 6) AS gap, round(m, 6) AS inner_mean, coalesce(k >= 5 AND gap > m + 2 * d, false) AS outlier FROM k""")
def q35_gap_outliers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0).alias("day"))
    o = o.withColumn("at", F.struct("day", "o_orderkey"))
    return rounded(signal.gap_outliers(o, "o_custkey", "at", "day", 5, 2.0).select("o_custkey", "o_orderkey", "gap", "inner_mean", "outlier"))


@query(f"""
    WITH {_HOURLY}, f AS (SELECT *, v >= 30 AS ok, sum(CASE WHEN v >= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY i) AS g FROM num)
    SELECT series, hour, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY series, g ORDER BY i)::BIGINT AS streak FROM f""")
def q36_consecutive(spark, sf_dir):
    return events.consecutive(hourly(spark, sf_dir), "series", "hour", F.col("v") >= 30).select("series", "hour", "streak")


# ---------------------------------------------------------------- events

_EV = "e AS (SELECT event_id, user_id, event_type, value, epoch(ts) AS t, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS hour FROM events)"


def timed(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t.alias("t"), F.floor(t / 3600).alias("hour"))


@query("""
    WITH e AS (SELECT event_id, user_id, event_type, value, date_trunc('hour', ts) AS h FROM events)
    SELECT a.event_id, count(DISTINCT b.user_id) AS n_near FROM e a JOIN e b ON a.event_type = b.event_type AND a.h = b.h AND abs(a.value - b.value) <= 5 GROUP BY a.event_id""")
def q37_persistence(spark, sf_dir):
    return events.neighbour_count(timed(spark, sf_dir), "event_id", ["event_type", "hour"], "value", 5.0, "user_id")


@query(f"""
    WITH {_EV} SELECT event_id, event_type, hour, round(value, 6) AS value FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.hour = b.hour AND a.event_id <> b.event_id AND a.event_type <> b.event_type AND abs(a.value - b.value) <= 6)
        AND NOT (value >= 10 AND EXISTS (SELECT 1 FROM e b WHERE a.hour = b.hour AND a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(a.value - b.value) BETWEEN 2 AND 20))""")
def q38_anti_bands(spark, sf_dir):
    e = timed(spark, sf_dir)
    first = events.without_neighbours(e, "event_id", ["hour"], "value", 6.0, unlike="event_type")
    near = events.near_rows(e.filter("value >= 10"), e, "event_id", ["hour", "event_type"], "value", 20.0, 2.0)
    return rounded(first.join(near, "event_id", "left_anti").select("event_id", "event_type", "hour", "value"))


@query(f"""
    WITH {_EV}, d AS (SELECT a.event_id, a.user_id, a.t, count(DISTINCT b.event_id) AS n_ahead FROM e a JOIN e b ON a.user_id = b.user_id AND b.t - a.t BETWEEN 0 AND 3600 GROUP BY ALL HAVING count(DISTINCT b.event_id) >= 3)
    SELECT user_id, event_id, round(t, 3) AS t, n_ahead FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1""")
def q39_first_dense(spark, sf_dir):
    return rounded(events.first_dense(timed(spark, sf_dir), "event_id", ["user_id"], "t", 3600.0, "event_id", 3), 3)


# ---------------------------------------------------------------- rings

@query("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber) - 1 AS mire_num FROM lineitem QUALIFY mire_num < 4")
def q41_ordinals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_extendedprice", "l_partkey", "l_linenumber"))
    return polar.ordinals(li, ["l_orderkey"], "o", 4).select("l_orderkey", "l_partkey", "l_linenumber", F.col("mire_num").cast("long"))


@query("""
    WITH b AS (SELECT l_returnflag, l_linestatus, month(l_shipdate)::INTEGER - 1 AS bin, avg(l_extendedprice) AS r FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, count(*) AS covered, round(avg(r), 6) AS mean_radius, round(stddev_pop(r) / avg(r), 6) AS cv FROM b GROUP BY ALL HAVING count(*) >= 6""")
def q42_ring_irregularity(spark, sf_dir):
    return rounded(polar.ring_irregularity(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", F.month("l_shipdate") - 1, "l_extendedprice", 12, 6))


@query("SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_suppkey) = 1")
def q43_unique_only(spark, sf_dir):
    return polar.unique_only(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"])


@query("WITH c AS (SELECT p_partkey, unnest(range(0, 26)) AS i, p_retailprice FROM part) SELECT p_partkey, arg_min(i, {'d': abs(p_retailprice - (900 + 40 * i)), 'i': i})::INTEGER AS entry FROM c GROUP BY p_partkey")
def q44_palette(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", polar.nearest_entry(F.col("p_retailprice"), [900 + 40 * i for i in range(26)]).alias("entry"))


@query("""
    WITH d AS (SELECT o_orderstatus, dayofyear(o_orderdate)::INTEGER % 360 AS day, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT a.o_orderstatus, a.day, round(coalesce((a.v + b.v) / 2, a.v), 4) AS balanced FROM d a LEFT JOIN d b ON a.o_orderstatus = b.o_orderstatus AND b.day = (a.day + 180) % 360""")
def q45_opposite(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_orderstatus", (F.dayofyear("o_orderdate") % 360).alias("day")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(polar.opposite(d, ["o_orderstatus"], "day", "v").select("o_orderstatus", "day", "balanced"), 4)


@query("""
    WITH m AS (SELECT event_type, hour(ts)::INTEGER AS a, avg(value) * 337.5 AS k FROM events GROUP BY ALL), f AS (SELECT event_type, a, k FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY k, a) = 1)
    SELECT f.event_type, f.a AS flat_angle, round(f.k, 6) AS flat_k, (f.a + 12) % 24 AS steep_angle, round(m.k, 6) AS steep_k FROM f LEFT JOIN m ON m.event_type = f.event_type AND m.a = (f.a + 12) % 24""")
def q46_simk(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.hour(F.col("ts").cast("timestamp")).alias("h"), "value")
    return rounded(surface.simk(e, "event_type", "h", "value", 24))


# ---------------------------------------------------------------- grids: an embedding as an 8 x 8 picture

_GRID = "g AS (SELECT vec_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings))"


def pictures(spark, sf_dir):
    return grid.from_array(table(spark, sf_dir, "embeddings").withColumn("p", F.transform("embedding", F.abs)), "vec_id", "p", 8)


@query("""
    SELECT event_type, level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type)::DOUBLE, 6) AS share
    FROM (SELECT event_type, greatest(0, least(255, floor(value)))::INTEGER AS level FROM events) GROUP BY event_type, level""")
def q47_histogram(spark, sf_dir):
    return rounded(grid.histogram(table(spark, sf_dir, "events"), "event_type", F.col("value")))


@query(f"""
    WITH {_GRID}, s AS (SELECT vec_id, quantile_cont(v, 0.9) AS cut, first(x ORDER BY v DESC, y, x) AS px, first(y ORDER BY v DESC, y, x) AS py, CASE WHEN sum(v) > 0 THEN sum(v) ELSE 1.0 END AS total FROM g GROUP BY vec_id),
    m AS (SELECT g.*, cut, total, x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 5 AS box, v >= cut AS top, px BETWEEN 2 AND 4 AND py BETWEEN 1 AND 5 AS pin FROM g JOIN s USING (vec_id))
    SELECT vec_id, round(sum(CASE WHEN x < 2 AND y < 2 THEN v ELSE 0 END) / max(total), 6) AS corner_fraction, round(sum(CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN v ELSE 0 END) / max(total), 6) AS border_fraction,
        round(avg(box::INTEGER), 6) AS box_area, round(sum(CASE WHEN box THEN v ELSE 0 END) / max(total), 6) AS box_fraction, bool_and(pin) AS peak_in_box,
        round(count(*) FILTER (box AND top) / count(*) FILTER (box OR top)::DOUBLE, 6) AS top_box_iou, round(sum(CASE WHEN box THEN v ELSE 0 END) / max(total) / avg(box::INTEGER), 6) AS box_lift
    FROM m GROUP BY vec_id""")
def q48_attention(spark, sf_dir):
    return rounded(grid.attention(pictures(spark, sf_dir), "vec_id", (2.2, 1.5, 2.5, 4.5)))


@query(f"""
    WITH {_GRID}, n AS (SELECT vec_id, v, lag(v) OVER r AS l, lead(v) OVER r AS t, lag(v) OVER c AS u, lead(v) OVER c AS d FROM g WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
    SELECT vec_id, round(var_pop(coalesce(l, t) + coalesce(t, l) + coalesce(u, d) + coalesce(d, u) - 4 * v), 6) AS sharpness FROM n GROUP BY vec_id""")
def q49_laplacian(spark, sf_dir):
    return rounded(grid.laplacian(pictures(spark, sf_dir), "vec_id"))


@query(f"""
    WITH {_GRID}, n AS (SELECT vec_id, v, lead(v) OVER r - v AS dx, lead(v) OVER c - v AS dy FROM g WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
    SELECT vec_id, round(avg(v), 6) AS brightness_mean, round(stddev_pop(v), 6) AS contrast_std, round(var_pop(dx) + var_pop(dy), 6) AS edge_energy FROM n GROUP BY vec_id""")
def q50_moments(spark, sf_dir):
    return rounded(grid.moments(pictures(spark, sf_dir), "vec_id"))


@query("""
    WITH f AS (SELECT vec_id, i // 8 AS position, i % 8 AS channel, v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)), p AS (SELECT channel, 1.0 + channel / 10.0 AS gamma, 0.01 * channel AS beta, 0.0 AS mean, 0.02 AS variance, 0.5 - channel / 8.0 AS weight, 0.001 AS epsilon FROM range(0, 8) t(channel)),
    a AS (SELECT vec_id, channel, avg(((v - mean) / sqrt(variance + epsilon) * gamma + beta > 0 AND (v - mean) / sqrt(variance + epsilon) * gamma + beta < 6)::INTEGER) * any_value(weight) * any_value(gamma / sqrt(variance + epsilon)) AS alpha FROM f JOIN p USING (channel) GROUP BY vec_id, channel),
    c AS (SELECT vec_id, position, greatest(0.0, sum(alpha * v)) AS cam FROM f JOIN a USING (vec_id, channel) GROUP BY vec_id, position)
    SELECT vec_id, position, round(CASE WHEN max(cam) OVER (PARTITION BY vec_id) > 0 THEN cam / max(cam) OVER (PARTITION BY vec_id) ELSE 0.0 END, 6) AS cam FROM c""")
def q51_activation_map(spark, sf_dir):
    f = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    f = f.select("vec_id", F.floor(F.col("i") / 8).alias("position"), (F.col("i") % 8).cast("long").alias("channel"), F.col("e").cast("double").alias("v"))
    c = F.col("channel")
    p = spark.range(8).withColumnRenamed("id", "channel").select("channel", (1.0 + c / 10.0).alias("gamma"), (0.01 * c).alias("beta"), F.lit(0.0).alias("mean"), F.lit(0.02).alias("variance"), (0.5 - c / 8.0).alias("weight"), F.lit(0.001).alias("epsilon"))
    return rounded(grid.activation_map(f, "vec_id", "position", "channel", "v", p))


@query("""
    WITH d AS (SELECT doc_id, lang, n_chars, list_filter([CASE WHEN n_chars < 300 THEN 'too_small' END, CASE WHEN n_chars / 1000.0 < 0.75 OR n_chars / 1000.0 > 2 THEN 'aspect' END, CASE WHEN length(source) < 5 THEN 'source' END], lambda x: x IS NOT NULL) AS issues FROM documents)
    SELECT doc_id, array_to_string(issues, ';') AS issues, len(issues) = 0 AS accepted FROM d""")
def q52_quality_issues(spark, sf_dir):
    n = F.col("n_chars")
    rules = [("too_small", n < 300), ("aspect", (n / 1000.0 < 0.75) | (n / 1000.0 > 2)), ("source", F.length("source") < 5)]
    d = table(spark, sf_dir, "documents").select("doc_id", audit.issue_list(rules).alias("issues"))
    return d.select("doc_id", F.array_join("issues", ";").alias("issues"), (F.size("issues") == 0).alias("accepted"))


@query("""
    SELECT vec_id, array_to_string(list_filter([CASE WHEN least(w, h) < 200 THEN 'too_small' END, CASE WHEN w / h < 0.75 OR w / h > 1.25 THEN 'aspect' END, CASE WHEN b < 0.08 THEN 'too_dark' WHEN b > 0.11 THEN 'too_bright' END, CASE WHEN c < 0.07 THEN 'low_contrast' END, CASE WHEN s < 20 THEN 'blurred' END], lambda x: x IS NOT NULL), ';') AS issues
    FROM (SELECT vec_id, 180 + vec_id % 90 AS w, 180 + vec_id * 7 % 210 AS h, 10 + vec_id % 37 AS s, avg(v) AS b, stddev_pop(v) AS c FROM (SELECT vec_id, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings) GROUP BY vec_id)""")
def q53_quality_gate(spark, sf_dir):
    i = F.col("vec_id")
    sides = (180 + i % 90).alias("width"), (180 + i * 7 % 210).alias("height"), (10 + i % 37).alias("sharpness")
    m = grid.moments(pictures(spark, sf_dir), "vec_id").select(i, *sides, F.col("brightness_mean").alias("brightness"), F.col("contrast_std").alias("contrast"))
    limits = {"min_side": 200, "max_aspect": 1.25, "min_brightness": 0.08, "max_brightness": 0.11, "min_contrast": 0.07}
    return grid.quality_gate(m, limits).select("vec_id", F.array_join("issues", ";").alias("issues"))


# ---------------------------------------------------------------- fits, decisions, review, queue

@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_returnflag")
def q54_linear_fit(spark, sf_dir):
    sums = surface.normal_equations(table(spark, sf_dir, "lineitem"), "l_returnflag", {"slope": F.col("l_quantity"), "intercept": F.lit(1.0)}, F.col("l_extendedprice"))
    return rounded(surface.solve(sums, "l_returnflag", ["slope", "intercept"]), 4)


@query("""
    SELECT l_linestatus, count(*) AS n, round(sum(l_quantity ** 4), 2) AS a__a, round(sum(l_quantity ** 3), 2) AS a__b, round(sum(l_quantity ** 2 * l_extendedprice), 2) AS a__target, round(sum(l_quantity ** 2), 2) AS b__b, round(sum(l_quantity * l_extendedprice), 2) AS b__target FROM lineitem GROUP BY 1""")
def q55_normal_equations(spark, sf_dir):
    q = F.col("l_quantity")
    return rounded(surface.normal_equations(table(spark, sf_dir, "lineitem"), "l_linestatus", {"a": q * q, "b": q}, F.col("l_extendedprice")), 2)


@query(f"""
    WITH {_SCORED} SELECT doc_id, score::DOUBLE AS score, CASE WHEN score < 0.2 THEN 'none' WHEN score < 0.45 THEN 'possible' ELSE 'suspected' END AS band, (score >= 0.5)::INTEGER AS decision,
        CASE WHEN (score >= 0.5) <> (score * 0.8 >= 0.5) THEN 'inconclusive' WHEN score >= 0.5 THEN 'suspected' ELSE 'not_suspected' END AS outcome FROM s""")
def q56_bands(spark, sf_dir):
    s = F.col("score")
    return scored(spark, sf_dir).select("doc_id", "score", scalars.bands(s, [(0.2, "none"), (0.45, "possible")], "suspected").alias("band"), scalars.decision(s, 0.5).alias("decision"), scalars.abstain(s, s * 0.8, 0.5).alias("outcome"))


@query(f"""
    WITH {_SCORED}, l AS (SELECT doc_id, 0 AS priority, row_number() OVER (ORDER BY doc_id) AS place FROM s WHERE (score >= 0.5) <> (label = 1) UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY abs(score - 0.5), doc_id) FROM s UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY score, doc_id) FROM s WHERE label = 1)
    SELECT doc_id, (min({{'p': priority, 'r': place}})).p AS priority, (min({{'p': priority, 'r': place}})).r::INTEGER AS place FROM l WHERE place <= 16 GROUP BY doc_id ORDER BY priority, place, doc_id LIMIT 16""")
def q57_priority_review(spark, sf_dir):
    """A report of 16 rows to look at; the limit is the feature."""
    s = scored(spark, sf_dir)
    wrong = s.filter((F.col("score") >= 0.5) != (F.col("label") == 1))
    return review.priority_union([(wrong, [F.col("doc_id")]), (s, [F.abs(F.col("score") - 0.5), F.col("doc_id")]), (s.filter("label = 1"), [F.col("score"), F.col("doc_id")])], "doc_id", 16)


@query("""
    WITH o AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), w AS (SELECT k::INTEGER AS sample, round_even(k * (SELECT max(n) - 1 FROM o) / 7.0, 0)::BIGINT AS i FROM range(0, 8) t(k))
    SELECT sample, p_partkey, p_retailprice FROM o JOIN w USING (i)""")
def q58_spaced_samples(spark, sf_dir):
    return review.spaced_samples(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], 8).select("sample", "p_partkey", "p_retailprice")


@query(f"WITH {_SCORED} SELECT doc_id, score::DOUBLE AS old, round(score * 1.1, 6)::DOUBLE AS new, (score >= 0.5)::INTEGER AS old_decision, (round(score * 1.1, 6) >= 0.5)::INTEGER AS new_decision FROM s WHERE (score >= 0.5) <> (round(score * 1.1, 6) >= 0.5)")
def q59_changed_decisions(spark, sf_dir):
    s = scored(spark, sf_dir).select("doc_id", F.col("score").alias("old"), F.round(F.col("score") * 1.1, 6).alias("new"))
    return review.changed_decisions(s, "doc_id", "old", "new", 0.5)


@query("""
    WITH k AS (SELECT conv_id, turn, sha256(conv_id::VARCHAR || '|' || turn::VARCHAR || '|' || role) AS d, sha256(conv_id::VARCHAR) AS h FROM conversations)
    SELECT sha256(string_agg(d2, '' ORDER BY p)) AS fingerprint FROM (SELECT substr(h, 1, 2) AS p, sha256(string_agg(d, '' ORDER BY d)) AS d2 FROM k GROUP BY 1)""")
def q60_fingerprint(spark, sf_dir):
    return review.table_fingerprint(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


_QUEUE = "q AS (SELECT DISTINCT conv_id::VARCHAR AS uri, conv_id % 3 = 0 AS uploaded FROM conversations WHERE conv_id % 2 = 0), marked AS (SELECT uri, uploaded OR uri::BIGINT % 5 = 0 AS uploaded FROM q)"


@query(f"WITH {_QUEUE}, full_queue AS (SELECT * FROM marked UNION ALL SELECT DISTINCT conv_id::VARCHAR, false FROM conversations WHERE conv_id::VARCHAR NOT IN (SELECT uri FROM marked)) SELECT uri, uploaded FROM full_queue WHERE NOT uploaded")
def q61_upload_queue(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("uri"), "conv_id").distinct()
    queue = ids.filter("conv_id % 2 = 0").select("uri", (F.col("conv_id") % 3 == 0).alias("uploaded"))
    marked = review.mark_uploaded(queue, ids.filter("conv_id % 5 = 0"))
    return review.pending(review.enqueue(marked, ids.select("uri")))


@query()
def q63_zernike_fit(spark, sf_dir):
    """Degree-3 surface per picture by distributed normal equations; checked against a direct fit in the tests."""
    g = pictures(spark, sf_dir)
    dx, dy = (F.col("x") - 3.5) / 5, (F.col("y") - 3.5) / 5
    return surface.zernike_fit(g.select("vec_id", F.hypot(dx, dy).alias("rho"), F.atan2(dy, dx).alias("theta"), F.col("v").alias("z")), "vec_id", 3)
