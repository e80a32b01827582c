"""Cases that showed only on larger tables, cut down to a size that a test can hold."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.operators import edges, grid, neardup, polar, surface


@pytest.fixture
def uncoalesced(spark):
    """Shuffles keep all their partitions, as they do when they are large."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def test_blocks_of_rows_and_references_meet_in_any_partition(uncoalesced):
    rng = random.Random(1)
    data = [(i, rng.getrandbits(62), rng.getrandbits(30)) for i in range(200)]
    df = uncoalesced.createDataFrame(data, "id long, p long, d long")
    got = {r["id"]: (r["d0"], r["d1"], r["reference"]) for r in neardup.nearest_of_table(df, "id", ["p", "d"], df, "id", ["p", "d"], True, block=20).collect()}
    assert got == {i: min(((p ^ q).bit_count(), (d ^ e).bit_count(), j) for j, q, e in data if j != i) for i, p, d in data}


@pytest.mark.parametrize("cost", [0, 256, 10**9])
def test_pairs_by_words_and_by_blocks(uncoalesced, monkeypatch, cost):
    """Both ways find the same pairs, copies too, and broadcast no side."""
    monkeypatch.setattr(neardup, "PROBE_COST", cost)
    rng = random.Random(7)
    codes = [rng.getrandbits(63) for _ in range(150)] + [5] * 40
    codes += [c ^ sum(1 << b for b in rng.sample(range(63), 6)) for c in codes[:60]]
    df = uncoalesced.createDataFrame([*enumerate(codes), (999, None)], "id long, code long")
    want = [(i, j, d) for i, j in itertools.combinations(range(len(codes)), 2) if (d := (codes[i] ^ codes[j]).bit_count()) <= 7]
    found = neardup.hamming_pairs(df, "id", "code", 7, 63)
    assert sorted(map(tuple, found.collect())) == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    if cost:
        small = neardup._pairs_in_blocks(df, "id", "code", 7, df.count(), block=30)
        assert sorted(map(tuple, small.collect())) == want


def test_labels_and_status_of_pairs_broadcast_nothing(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    status = neardup.pair_status(pairs, pairs.withColumn("decision", F.lit("confirmed")), F.lit(False))
    groups = neardup.connected(pairs, spark.range(1, 5), "id")
    for df in (status, groups):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, groups.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_neighbours_at_the_limit_of_their_rule(spark):
    """Radius 8 at 30 degrees is 4 across from the ray of 0, radii 18 and 8 at 60 degrees are 1 along: by the rays given, whichever they are."""
    kind = "k int, id long, angle double, radius double, x double, y double, c double, s double"
    points = [(1, i, a, r, r * math.cos(math.radians(a)), r * math.sin(math.radians(a)), math.cos(math.radians(a)), math.sin(math.radians(a))) for i, (a, r) in enumerate((float(a), r / 2) for a in range(0, 360, 15) for r in range(12, 40))]
    got = polar.neighbour_graph(spark.createDataFrame(points, kind), "k", 1.0, 4.0, ray=(F.col("c"), F.col("s")))
    want = {}
    for _, i, a, r, x, y, c, s in points:
        for _, j, b, _, u, v, _, _ in points:
            if a != b and abs((u - x) * c + (v - y) * s) <= 1 and abs((v - y) * c - (u - x) * s) <= max(math.radians(2.0) * r, 4.0):
                ahead, behind = want.get((min(i, j), max(i, j)), (False, False))
                want[min(i, j), max(i, j)] = ahead or i < j, behind or i > j
    assert {(r["a"], r["b"]): (r["ahead"], r["behind"]) for r in got.collect()} == want


def test_meridians_of_many_pictures_are_solved_together(spark, monkeypatch):
    """One call of the solver for all meridians of a partition, each at its picture's camera distance; the same as one by one."""
    rng, sphere = np.random.default_rng(4), []
    for k in range(40):
        radius, p = 7.4 + 0.02 * k, 74.0 + k % 3
        for angle in (0, 90, 180, 270):
            for ring in range(int(rng.integers(3, 8))):
                y = 0.3 + 0.25 * ring
                z = radius - math.sqrt(radius**2 - y**2)
                normal = np.array([-1.0, y / (radius - z)]) / math.hypot(1.0, y / (radius - z))
                ray = np.array([p - z, -y]) / math.hypot(p - z, y)
                out = 2 * (ray @ normal) * normal - ray
                sphere.append((k, angle, ring, p, y / (z - p), float(z + 40 * out[0]), float(y + 40 * out[1])))
    df = spark.createDataFrame(sphere, "id int, angle int, mire_num int, p double, slope double, object_z double, object_y double").repartition(7)
    got = {(r["id"], r["angle"], r["mire_num"]): (r["z"], r["y"], r["roc"]) for r in surface.arc_step(df, "id", block=50).collect()}
    assert len(got) == len(sphere)
    for (k, angle), rings in itertools.groupby(sphere, lambda r: r[:2]):
        rings = list(rings)
        one = surface.reflections(rings[0][3], *(np.array([[r[c] for r in rings]]) for c in (4, 5, 6)))
        assert [got[k, angle, r[2]] for r in rings] == list(zip(*(x[0].tolist() for x in one), strict=True))
    assert "FlatMapGroupsInPandas" not in surface.arc_step(df, "id")._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Shuffles in the plan that runs, before any is coalesced."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_rays_and_scans_are_dealt_few_times(spark):
    centres = spark.createDataFrame([(1, 3.37, 3.61)], "k int, cx double, cy double")
    pixels = spark.createDataFrame([(1, y, x, float((3 * x + 5 * y) % 7) - 3) for y in range(8) for x in range(8)], "k int, y int, x int, v double")
    rayed = polar.rays(centres, "k", 6)
    want = []
    for a in range(360):
        seen = []
        for s in range(1, 7):
            at = (math.floor(3.37 + s * math.cos(math.radians(a))), math.floor(3.61 + s * math.sin(math.radians(a))))
            if at not in seen:
                seen.append(at)
                want.append((1, a, *at, s, len(seen)))
    assert sorted(map(tuple, rayed.select("k", "angle", "x", "y", "step", "nth").collect())) == sorted(want)
    assert exchanges(rayed) == 0
    assert exchanges(polar.radial_scan(pixels, centres, "k", 6, 3, 0.0)) <= 3


def test_votes_are_counted_where_their_points_are_dealt(spark):
    """Points are dealt by picture and radius, and only the best of each radius by band: no shuffle of votes."""
    data = [(k, y, x, (7 * x * k + 3 * y) % 5 - 2, (x * y + k) % 5 - 2) for k in range(3) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(data, "k int, y int, x int, gx int, gy int")
    assert "cx" not in "".join(x for x in edges.circles(df, "k", 1, 4, 1, 2)._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)


def test_partitions_follow_the_rows(spark):
    assert grid.tasks_for(spark.range(1000), 10) == 100 and grid.tasks_for(spark.range(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_hits(pixels, centres, angles, length, level):
    """Runs of pixels above the level along the rays of centres, step by step: key, angle, radius, intensity, n."""
    out = []
    for k, cx, cy in centres:
        for a in angles:
            seen, run = [], []
            for s in range(1, length + 1):
                at = (math.floor(cx + s * math.cos(math.radians(a))), math.floor(cy + s * math.sin(math.radians(a))))
                if at in seen:
                    continue
                seen.append(at)
                v = pixels.get((k, *at))
                if v is not None and v > level:
                    run.append((s, v))
                elif run:
                    out.append((k, a, run))
                    run = []
            if run:
                out.append((k, a, run))
    return [(k, a, sum(s * v for s, v in run) / sum(v for _, v in run), sum(v for _, v in run) / len(run), len(run)) for k, a, run in out]


@pytest.fixture
def scanned(spark):
    """Pictures away from the origin, with holes, nulls, one without a centre, one centre without a picture and one of no place."""
    rng = random.Random(3)
    pixels = {(f"p{k}", x, y): rng.choice((None, -1.0, 0.5, 1.0, 2.5)) for k in range(30) for x in range(-4, 6) for y in range(90, 100) if rng.random() < 0.9}
    centres = [(f"p{k}", rng.uniform(-2, 4), rng.uniform(92, 98)) for k in range(1, 32)]
    frames = spark.createDataFrame([(k, y, x, v) for (k, x, y), v in pixels.items()], "k string, y int, x int, v double"), spark.createDataFrame([*centres, ("p0", None, 1.0)], "k string, cx double, cy double")
    return *frames, pixels, centres


def test_rays_are_met_where_their_picture_is(spark, scanned, monkeypatch):
    """The rays of centres are neither broadcast nor dealt: only pixels and centres are, by picture."""
    df, centres, pixels, places = scanned
    monkeypatch.setattr(polar, "BLOCK", 360 * 9 * 4)
    for angles in (None, (0, 45, 90, 200)):
        got = sorted(tuple(r) for r in polar.centre_hits(df, centres, "k", 9, angles, 0.5).collect())
        want = sorted(plain_hits(pixels, places, angles or range(360), 9, 0.5))
        assert [(k, a, n) for k, a, _, _, n in got] == [(k, a, n) for k, a, _, _, n in want] and np.allclose([r[2:4] for r in got], [r[2:4] for r in want])
    plan = polar.centre_hits(df, centres, "k", 9)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and not [x for x in plan.splitlines() if "Exchange" in x and "angle" in x]
    assert polar.centre_hits(df.limit(0), centres, "k", 9).count() == 0
    assert "Broadcast" not in polar.ray_hits(df, polar.rays(centres, "k", 9), "k")._jdf.queryExecution().executedPlan().toString()


def test_query_of_ray_hits_broadcasts_nothing(spark):
    from ocellus.plans import further

    assert "Broadcast" not in further.q79_ray_hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_scans_and_walks_are_made_where_their_picture_is(spark, scanned):
    df, centres, pixels, places = scanned
    got = {}
    for r in polar.radial_scan(df, centres, "k", 9, 3, 2.0).collect():
        got.setdefault((r["k"], r["angle"]), {})[r["mire_num"]] = (r["radius"], r["intensity"], r["n"])
    want = {}
    negative = {at: None if v is None else 2.0 - v for at, v in pixels.items()}
    for k, a, radius, intensity, n in (*plain_hits(pixels, places, range(360), 9, 0), *plain_hits(negative, places, range(360), 9, 0)):
        want.setdefault((k, a), []).append((radius, intensity, n))
    assert got.keys() == want.keys()
    for at, hits in want.items():
        assert list(sorted(got[at])) == list(range(min(3, len(hits))))
        assert np.allclose([got[at][m][0] for m in range(len(got[at]))], sorted(h[0] for h in hits)[:3])
    mask = df.filter("v > 0").withColumn("label", F.when(F.col("v") > 1, 2).otherwise(1))
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (polar.radial_scan(df, centres, "k", 9, 3, 2.0), polar.ring_walk(mask, centres, "k", 9, 2))):
        assert "Broadcast" not in plan and not [x for x in plan.splitlines() if "Exchange" in x and "angle" in x]


def test_query_of_radial_scan_broadcasts_nothing(spark):
    from ocellus.plans import further

    assert "Broadcast" not in further.q80_radial_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_edges_of_neighbours_are_not_dealt_again(spark):
    """Each pair is met once, with both ends' rules; only points are dealt, and none broadcast."""
    rng = random.Random(5)
    points = [(k, i, float(rng.randrange(0, 360, 5)), rng.uniform(5, 12)) for k in range(3) for i in rng.sample(range(1000), 90)]
    points = [(k, i, a, r, r * math.cos(math.radians(a)), r * math.sin(math.radians(a))) for k, i, a, r in points] + [(1, 2000, 7.0, 0.0, 0.0, 0.0)]
    got = polar.neighbour_graph(spark.createDataFrame(points, "k int, id long, angle double, radius double, x double, y double"), "k", 1.0, 4.0)
    want = {}
    for k, i, a, r, x, y in points:
        for m, j, b, _, u, v in points:
            d = math.hypot(x, y)
            if k == m and a != b and d and abs((u - x) * x / d + (v - y) * y / d) <= 1 and abs((v - y) * x / d - (u - x) * y / d) <= max(math.radians(2.0) * r, 4.0):
                ahead, behind = want.get((k, min(i, j), max(i, j)), (False, False))
                want[k, min(i, j), max(i, j)] = ahead or i < j, behind or i > j
    rows = got.collect()
    assert len(rows) == len(want) and {(r["k"], r["a"], r["b"]): (r["ahead"], r["behind"]) for r in rows} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "HashAggregate" not in plan and exchanges(got) == 2
