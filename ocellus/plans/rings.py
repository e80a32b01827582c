"""Queries over break candidates, supports and review order, made from events and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import breaks, review
from .catalogue import query, rounded, table

#: Rings of signals: frame k, ring m (1 to 8, the inner ones fuller), angle a in half degrees, signal v, height y.
_RINGS = """e AS (SELECT event_type || '-' || event_id % 3 AS k, (8 - floor(sqrt((event_id % 64)::DOUBLE)))::INTEGER AS m, (event_id // 64 * 37 + event_id % 64 * 11 + user_id * 5) % 720 / 2.0::DOUBLE AS a, value, event_id FROM events),
    s AS (SELECT k, m, a, max(value + event_id * 0.000001::DOUBLE) AS v, min(value) AS y FROM e GROUP BY ALL)"""

#: The supports: peaks of odd rings near 180 and 0 degrees, those with more than three within five degrees, their means.
_SUPPORTS = f"""{_RINGS},
    h AS (SELECT *, CASE WHEN a > 150 AND a < 210 THEN 'left' WHEN a > 330 OR a < 30 THEN 'right' END AS side FROM s WHERE m % 2 = 1),
    i AS (SELECT *, lag(v) OVER z AS b, lead(v) OVER z AS f FROM h WHERE side IS NOT NULL WINDOW z AS (PARTITION BY k, m, side ORDER BY a)),
    q AS (SELECT k, m, side, CASE WHEN a > 330 THEN a - 360 ELSE a END AS a FROM i WHERE v > b AND v > f AND v >= 20),
    n AS (SELECT x.k, x.side, x.a FROM q x JOIN q w ON x.k = w.k AND abs(x.a - w.a) < 5 GROUP BY x.k, x.side, x.m, x.a HAVING count(*) > 3),
    u AS (SELECT k, avg(a) FILTER (side = 'left') AS l, avg(a) FILTER (side = 'right') AS r FROM n GROUP BY k),
    held AS (SELECT k, coalesce(l, 180.0)::DOUBLE AS l, coalesce(r, 0.0)::DOUBLE AS r FROM (SELECT DISTINCT k FROM s) LEFT JOIN u USING (k))"""


def ringed(spark, sf_dir):
    i = F.col("event_id")
    turn = (F.floor(i / 64) * 37 + i % 64 * 11 + F.col("user_id") * 5) % 720 / 2.0
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), (i % 3).cast("string")).alias("frame"), (8 - F.floor(F.sqrt((i % 64).cast("double")))).cast("int").alias("mire_num"), turn.alias("angle"), "value", i)
    rows = e.groupBy("frame", "mire_num", "angle").agg(F.max(F.col("value") + i * F.lit(0.000001)).alias("signal"), F.min("value").alias("y"))
    return rows.withColumn("x", F.col("angle")).withColumn("threshold", F.lit(20.0))


@query(f"WITH {_SUPPORTS} SELECT k AS frame, round(l, 6) AS left_support, round(r, 6) AS right_support FROM held")
def q137_supports(spark, sf_dir):
    return rounded(breaks.supports(ringed(spark, sf_dir), "frame"))


@query(f"""
    WITH {_SUPPORTS}, o AS (SELECT s.*, l, r FROM s JOIN held USING (k) WHERE CASE WHEN r + 4.5 < 0 THEN a > r + 364.5 OR a < l - 4.5 ELSE a > r + 4.5 AND a < l - 4.5 END),
    full_rings AS (SELECT k, m, count(*) AS n, any_value(floor((l - 9 - r) / 10)) AS points FROM o WHERE m % 2 = 1 GROUP BY k, m), c AS (SELECT k, max(m) AS complete FROM full_rings WHERE n > 0.99::DOUBLE * points GROUP BY k),
    g AS (SELECT *, a - lag(a) OVER z AS a0, y - lag(y) OVER z AS y0, lead(a) OVER z - a AS a1, lead(y) OVER z - y AS y1, lag(v) OVER z AS b, lead(v) OVER z AS f FROM o WINDOW z AS (PARTITION BY k, m ORDER BY a)),
    t AS (SELECT k, m, a FROM g WHERE m % 2 = 1 AND (coalesce(sqrt(a0 * a0 + y0 * y0) > 60, false) OR coalesce(sqrt(a1 * a1 + y1 * y1) > 60, false))),
    d AS (SELECT * FROM t UNION SELECT k, m - 2, a FROM t)
    SELECT k AS frame, m AS mire_num, a AS angle FROM g JOIN c USING (k) WHERE v > b AND v > f AND v >= 20
        AND NOT (m % 2 = 1 AND m >= complete AND EXISTS (SELECT 1 FROM d WHERE d.k = g.k AND d.m = g.m AND abs(d.a - g.a) <= 5))""")
def q138_break_candidates(spark, sf_dir):
    return breaks.break_candidates(ringed(spark, sf_dir), "frame", 10.0, 60.0, 5.0)


@query("""
    WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.' || p_partkey ELSE p_partkey * 7919 % 1000 || '.png' END AS name FROM part),
    t AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM n)
    SELECT p_partkey, name, row_number() OVER (PARTITION BY p_brand ORDER BY TRY_CAST(stem AS BIGINT) IS NULL, TRY_CAST(stem AS BIGINT), stem, p_partkey)::INTEGER AS place FROM t""")
def q139_natural_order(spark, sf_dir):
    i = F.col("p_partkey")
    name = F.when(i % 3 == 0, F.concat("p_name", F.lit("."), i.cast("string"))).otherwise(F.concat((i * 7919 % 1000).cast("string"), F.lit(".png")))
    named = table(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("name"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(*review.natural_key(F.col("name")), "p_partkey"))
    return named.select("p_partkey", "name", place.alias("place"))
