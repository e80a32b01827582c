"""Literal cases, numpy oracles and properties of the library's own operators."""

import itertools
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.functions import scalars
from ocellus.operators import audit, events, grid, metrics, neardup, polar, review, signal, split, surface


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(df):
    return df.collect()[0]


# ---------------------------------------------------------------- audit


def test_label_rule(spark):
    df = spark.createDataFrame([("a", ""), ("a", "P"), ("a", "P "), ("a", "Cataract"), ("b", ""), ("b", ""), ("c", ""), ("c", "Pinguecula")], "f string, lesion string")
    assert {r["f"]: r["label"] for r in audit.label_rule(df, ["f"], "lesion", "P").collect()} == {"a": 1, "b": 0, "c": None}


def test_match_and_numbering(spark):
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "n string")
    found = spark.createDataFrame([("x",), ("z",), ("z",)], "m string")
    assert rows(audit.match_status(names, found, "n", "m")) == [("x", 1, "single"), ("y", 0, "missing"), ("z", 2, "ambiguous")]
    df = spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("b", 0, 2), ("c", 1, 1)], "k string, i int, declared int")
    assert {r["k"]: r["consistent"] for r in audit.numbering(df, "k", "i", 0, "declared").collect()} == {"a": True, "b": False, "c": False}


def test_valid_box_and_issues(spark):
    df = spark.sql("SELECT named_struct('x', 19.0, 'y', 0.0, 'width', 5.0, 'height', 4.0) AS b UNION ALL SELECT named_struct('x', 1.0, 'y', 0.0, 'width', 5.0, 'height', 4.0) UNION ALL SELECT NULL")
    assert [r[0] for r in df.select(audit.valid_box(F.col("b"), F.lit(20), F.lit(20))).collect()] == [False, True, False]
    made = df.select(audit.issue_list([("none", F.col("b").isNull()), ("far", F.col("b.x") > 10)]).alias("issues"))
    assert rows(audit.issue_counts(made)) == [("far", 1), ("none", 1)]
    with pytest.raises(Exception, match="no good"):
        audit.raise_unless(df, F.col("b").isNotNull(), "no good").collect()


# ---------------------------------------------------------------- metrics


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def test_threshold_literals(spark):
    df = scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    best = one(metrics.best_threshold(metrics.threshold_curve(df, "label", "score")))
    assert (round(best["threshold"], 6), best["sensitivity"], best["specificity"]) == (0.225, 1.0, 0.5)
    c = one(metrics.confusion(scored(spark, [(0, 0.49), (1, 0.5)]), "label", "score", 0.5))
    assert (c["tp"], c["tn"], c["fp"], c["fn"]) == (1, 1, 0, 0)
    m = one(metrics.full_metrics(scored(spark, [(0, 0.1), (0, 0.8), (1, 0.7), (1, 0.9)]), "label", "score", 0.5))
    assert (m["tp"], m["fp"], m["sensitivity"], m["specificity"]) == (2, 1, 1.0, 0.5)
    w = {r["label"]: r["weight"] for r in metrics.class_weights(scored(spark, [(0, 0.0)] * 3 + [(1, 0.0)]), "label").collect()}
    assert w == {0: 4 / 6, 1: 2.0}


def test_curve_and_auc_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)] + [(1, 1.0), (0, 0.0)]
    df = scored(spark, pairs).repartition(5)
    distinct = sorted({s for _, s in pairs})
    want = {0.0, 0.5, 1.0} | {(a + b) / 2 for a, b in itertools.pairwise(distinct)}
    curve = {round(r["threshold"], 9): r for r in metrics.threshold_curve(df, "label", "score").collect()}
    assert set(curve) == {round(t, 9) for t in want}
    for t in want:
        r = curve[round(t, 9)]
        assert (r["tp"], r["fp"]) == (sum(y == 1 and s >= t for y, s in pairs), sum(y == 0 and s >= t for y, s in pairs))
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    assert one(metrics.roc_auc(df, "label", "score"))["auc"] == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_wilson_bounds(spark):
    low, high = scalars.wilson(F.col("h"), F.col("n"))
    out = spark.createDataFrame([(8, 10), (0, 5), (5, 5), (0, 0)], "h int, n int").select("h", "n", low.alias("l"), high.alias("u")).collect()
    assert out[0]["l"] < 0.8 < out[0]["u"] and out[3]["l"] is None and all(0 <= r["l"] <= r["u"] <= 1 for r in out[:3])


# ---------------------------------------------------------------- near duplicates, splits


def test_hamming_pairs_are_complete(spark):
    rng = random.Random(8)
    codes = [rng.getrandbits(64) for _ in range(60)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in codes for k in (1, 5, 8, 9)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, code long")
    got = {(r["a"], r["b"]): r["distance"] for r in neardup.hamming_pairs(df, "id", "code", 8).collect()}
    want = {(i, j): (codes[i] ^ codes[j]).bit_count() for i, j in itertools.combinations(range(len(codes)), 2) if (codes[i] ^ codes[j]).bit_count() <= 8}
    assert got == want


def test_nearest_of_table_against_brute_force(spark):
    rng = random.Random(4)
    rows_ = [(i, rng.getrandbits(62), rng.getrandbits(62)) for i in range(90)]
    rows_ += [(100 + i, c, d ^ rng.getrandbits(3)) for i, c, d in rows_[:20]]
    df = spark.createDataFrame(rows_, "id long, p long, d long")
    got = {r["id"]: (r["d0"], r["d1"], r["reference"]) for r in neardup.nearest_of_table(df, "id", ["p", "d"], df, "id", ["p", "d"], True, block=40).collect()}
    assert got == {i: min(((p ^ q).bit_count(), (d ^ e).bit_count(), j) for j, q, e in rows_ if j != i) for i, p, d in rows_}


def test_grouping_and_status(spark):
    pairs = spark.createDataFrame([(1, 2, True), (2, 3, False), (5, 6, False)], "a int, b int, same boolean")
    status = neardup.pair_status(pairs, spark.createDataFrame([(3, 2, "confirmed")], "a int, b int, decision string"), F.col("same"))
    assert {(r["a"], r["b"]): r["status"] for r in status.collect()} == {(1, 2): "exact", (2, 3): "confirmed", (5, 6): "review_required"}
    linked = status.filter("status IN ('exact', 'confirmed')")
    got = rows(neardup.connected(linked, spark.createDataFrame([(i,) for i in range(1, 7)], "id int"), "id"))
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]


def test_shifted_correlation_finds_the_shift(spark):
    rng = np.random.default_rng(0)
    big = rng.random((20, 20))
    a, b = big[2:14, 2:14], big[4:16, 1:13]
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "p array<double>, q array<double>")
    assert one(neardup.shifted_correlation(df, "p", "q", 12, 4))["correlation"] == pytest.approx(1.0)


def test_stratified_split(spark):
    for n, targets in ((163, (114, 24, 25)), (245, (172, 37, 36))):
        df = spark.createDataFrame([(f"g{max(1, i)}", 1) for i in range(n)], "g string, y int")
        done = split.stratified_split(df, "g", "y", {1: targets[:2]})
        got = {r["split"]: r["total"] for r in split.split_counts(done, "y").collect()}
        assert got == dict(zip(("train", "validation", "test"), targets, strict=True)) and split.split_violations(done, "g").isEmpty()
        assert rows(done) == rows(split.stratified_split(df.repartition(3), "g", "y", {1: targets[:2]}))
    rng = random.Random(4)
    for _ in range(100):
        groups, target = [(f"g{i}", rng.randint(1, 9)) for i in range(rng.randint(0, 8))], rng.randint(0, 30)
        best = max(n for k in range(len(groups) + 1) for c in itertools.combinations(groups, k) if (n := sum(x[1] for x in c)) <= target)
        assert sum(n for g, n in groups if g in split.choose_groups(groups, target)) == best
    assert split.choose_groups([("a", 3), ("b", 3)], 5) in ({"a"}, {"b"}) and split.choose_groups([], 4) == set()
    with pytest.raises(ValueError, match="more than one label"):
        split.stratified_split(spark.createDataFrame([("g", 0), ("g", 1)], "g string, y int"), "g", "y", {0: (1, 0)})


# ---------------------------------------------------------------- signals and events


def series(spark, values):
    return spark.createDataFrame([("s", i, float(v) if v is not None else None) for i, v in enumerate(values)], "s string, t long, v double")


def test_zero_padded_dual_median_against_numpy(spark):
    x = np.random.default_rng(2).random(80) + 3
    holes = [None if k % 7 == 0 or 30 <= k < 45 else v for k, v in enumerate(x)]
    filled = np.array([v or 0.0 for v in holes])
    med = lambda k: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(filled, k // 2), k), axis=1)
    m1, m2 = med(25), med(51)
    got = signal.dual_median(series(spark, holes), "s", "t", "v", zero_padded=True).orderBy("t").collect()
    assert np.allclose([r["median"] for r in got], np.where(np.abs(m1 - m2) / (m2 + 1e-9) > 0.05, m2, m1))


def test_windows_against_numpy(spark):
    x = np.random.default_rng(1).random(120)
    df = series(spark, x)
    got = np.array([r["smooth"] for r in signal.reflect_mean(df, "s", "t", "v", 5).orderBy("t").collect()])
    assert np.allclose(got, np.convolve(np.pad(x, 2, mode="reflect"), np.ones(5) / 5, mode="valid"))
    both = signal.background_difference(df, "s", "t", "v").orderBy("t").collect()
    want = np.convolve(np.pad(x, 25, mode="reflect"), np.ones(51) / 51, mode="valid") - np.convolve(x, np.ones(5) / 5, mode="same")
    assert np.allclose([r["signal"] for r in both], want)
    med = lambda k: np.median(np.lib.stride_tricks.sliding_window_view(np.r_[x[-(k // 2) :], x, x[: k // 2]], k), axis=1)
    m1, m2 = med(25), med(51)
    assert np.allclose([r["median"] for r in signal.dual_median(df, "s", "t", "v").orderBy("t").collect()], np.where(np.abs(m1 - m2) / (m2 + 1e-9) > 0.05, m2, m1))


def test_blinks_find_two_pulses(spark):
    x = np.zeros(200)
    x[50:54], x[130:134] = 10, 10
    found = signal.blinks(series(spark, x), "s", "t", "v", 10.0, height=2.0).orderBy("t").collect()
    assert len(found) == 2 and all(abs(r["t"] - at) <= 4 for r, at in zip(found, (50, 130), strict=True))


def test_find_peaks():
    x = np.array([0, 2, 0, 3, 3, 0, 1, 0, 5, 0, 0.5, 0])
    assert signal.find_peaks(x)[0].tolist() == [1, 3, 6, 8, 10]
    assert signal.find_peaks(x, height=1, distance=3)[0].tolist() == [3, 8]
    assert signal.find_peaks(x, prominence=2.5)[0].tolist() == [3, 8]


def test_runs_drop_fill_and_gaps(spark):
    df = series(spark, [0, 1, 1, 0, 1, 1, 1])
    assert rows(signal.runs(df, "s", "t", F.col("v") > 0, 2)) == [("s", 1, 2, 2), ("s", 4, 6, 3)]
    assert rows(signal.runs(df, "s", "t", F.col("v") > 0, 2, closed_only=True)) == [("s", 1, 2, 2)]
    drop = one(signal.sustained_drop(series(spark, [0, 0, 20, 10, 10, 10, 10, 10, 10, 10, 7, 7, 10, 7, 7, 7, 7]), "s", "t", "v"))
    assert (drop["jump"], drop["drop_at"]) == (2, 13)
    assert [r["filled"] for r in signal.local_fill(series(spark, [1, None, 3]), "s", "t", "v").orderBy("t").collect()] == [1, 2, 3]
    values = [0, 10, 20.5, 30, 40.2, 50, 60, 170, 280, 290]
    out = signal.gap_outliers(series(spark, values), "s", "t", "v", 5, 10.0)
    assert [r["t"] for r in out.filter("outlier").orderBy("t").collect()] == [7]
    fixed = {r["t"]: r["repaired"] for r in signal.repaired(out.select("s", "t", "v", "outlier", "inner_mean"), "s", "t", "v").collect()}
    assert fixed[7] == pytest.approx(60 + 10.0)


def brute_breaks(data, sampling):
    data = sorted({(m, a - 360 if a > 270 else a, f, t) for m, a, f, t in data})
    out = []
    for m, a, f, t in data:
        near = [d for d in data if d != (m, a, f, t)]
        if m % 2 == 0:
            continue
        if (m >= 13 or a >= 150 or a <= 30) and len({d[2] for d in data if d[0] == m and abs(d[1] - a) <= 5}) > 5 * sampling:
            continue
        if (m >= 15 or a < 20 or a > 160) and any(abs(d[0] - m) == 2 and abs(d[1] - a) <= 6 and d[3] == t for d in near):
            continue
        if m >= 13 and any(d[0] == m and d[3] == t and 2 <= abs(d[1] - a) <= 20 for d in near):
            continue
        if any(abs(d[0] - m) == 1 and d[3] == t and abs(d[1] - a) <= 2 for d in near):
            continue
        if (m >= 19 and 60 <= a <= 120) or (m >= 15 and 60 <= a < 119) or (m == 11 and abs(a - 105) <= 6) or (m == 13 and abs(a - 106) <= 6):
            continue
        out.append((m, a, f, t))
    return out


def test_break_cascade(spark):
    rng = random.Random(6)
    data = [(rng.randint(1, 21), float(rng.randint(0, 359)), f, f / 30.0) for f in (rng.randint(0, 14) for _ in range(900))]
    df = spark.createDataFrame([("v", *d) for d in data], "video_id string, mire_num int, angle double, frame long, time double")
    got = sorted((r["mire_num"], r["angle"], r["frame"], r["time"]) for r in events.filter_breaks(df, 1.0).collect())
    assert got == sorted(brute_breaks(data, 1.0)) and got
    assert events.filter_breaks(df.limit(0), 1.0).count() == 0


def test_break_up_time(spark):
    dense = [("v", 5, 40.0 + i % 3, 60 + i, 2.0 + i / 30) for i in range(10)] + [("v", 7, 90.0, 10, 0.3)]
    df = spark.createDataFrame(dense, "video_id string, mire_num int, angle double, frame long, time double")
    blink = spark.createDataFrame([("v", 0.2), ("v", 0.5), ("w", 1.0)], "video_id string, time double")
    got = {r["video_id"]: r["nibut"] for r in events.break_up_time(df, blink, True).collect()}
    assert got == {"v": pytest.approx(1.5), "w": None}


# ---------------------------------------------------------------- rings, grids, surfaces


def picture(spark, a, key="p"):
    h, w = a.shape
    return spark.createDataFrame([(key, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "id string, y int, x int, v double")


def test_radial_scan_recovers_rings(spark):
    yy, xx = np.mgrid[:121, :121]
    r = np.hypot(xx - 60, yy - 60)
    a = np.where((np.abs(r - 15) < 2) | (np.abs(r - 30) < 2) | (np.abs(r - 45) < 2), 255.0, 0.0)
    centre = spark.createDataFrame([("p", 60.0, 60.0)], "id string, cx double, cy double")
    hits = polar.ray_hits(picture(spark, a), polar.rays(centre, "id", 58, range(0, 360, 15)), "id")
    got = polar.ordinals(hits, ["id", "angle"], "radius", 3).groupBy("mire_num").agg(F.avg("radius").alias("r"), F.count("*").alias("n")).orderBy("mire_num").collect()
    assert [x["n"] for x in got] == [24, 24, 24] and np.allclose([x["r"] for x in got], [15, 30, 45], atol=1.0)
    labels = np.where(a > 0, np.round(r / 15), 0).astype(int)
    mask = spark.createDataFrame([("p", y, x, int(labels[y, x])) for y in range(121) for x in range(121) if labels[y, x]], "id string, y int, x int, label int")
    med = polar.mask_radii(mask, centre, "id").groupBy("mire_num").agg(F.avg("radius").alias("r"), F.count("*").alias("n")).orderBy("mire_num").collect()
    assert np.allclose([x["r"] for x in med], [15, 30, 45], atol=0.7) and all(x["n"] > 300 for x in med)
    walk = polar.ring_walk(mask, centre, "id", 58, 3).groupBy("mire_num").agg(F.avg("radius").alias("r")).orderBy("mire_num").collect()
    assert np.allclose([x["r"] for x in walk], [15, 30, 45], atol=1.0)


def test_ring_components_and_shift(spark):
    pts = [(i, float(i * 2), 20.0, 20 * np.cos(np.radians(i * 2)), 20 * np.sin(np.radians(i * 2))) for i in range(30)] + [(100 + i, float(i * 2), 26.0, 26 * np.cos(np.radians(i * 2)), 26 * np.sin(np.radians(i * 2))) for i in range(30)] + [(200, 300.0, 5.0, 2.5, -4.3)]
    df = spark.createDataFrame([("p", p[0], *map(float, p[1:])) for p in pts], "k string, id long, angle double, radius double, x double, y double")
    comp = polar.ring_components(df, polar.neighbour_graph(df, "k"), "k")
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("radius").alias("r")).collect()
    assert sorted((r["n"], r["r"]) for r in sizes) == [(30, 1), (30, 1)]
    numbered = comp.withColumn("mire_num", F.when(F.col("radius") > 25, 1).otherwise(0) + F.when((F.col("id") == 5) | (F.col("id") == 105), 1).otherwise(0))
    fixed = polar.shift_corrected(numbered, "k")
    assert fixed.filter((F.col("radius") < 25) & (F.col("mire_num") != 0)).isEmpty() and fixed.filter((F.col("radius") > 25) & (F.col("mire_num") != 1)).isEmpty()
    assert {r["ring"] for r in polar.majority_ring(numbered, ["k"]).collect()} == {0, 1}


def test_shift_moves_rings_of_larger_number(spark):
    # ring 1 is missed at angle 10, so ring 2 has number 1 there and ring 3 number 2; a lone larger radius of number 0 stays
    points = [(a, 10.0 * (m + 1), m - (a == 10.0 and m > 1), m) for a in (0.0, 10.0, 20.0, 30.0) for m in range(4) if not (a == 10.0 and m == 1)] + [(10.0, 99.0, 0, 9)]
    df = spark.createDataFrame([("p", *p) for p in points], "k string, angle double, radius double, mire_num int, component long")
    got = {(r["angle"], r["radius"]): r["mire_num"] for r in polar.shift_corrected(df, "k").collect()}
    assert got == {(a, r): 0 if r == 99.0 else c for a, r, _, c in points}


def test_grid_operators(spark):
    rng = np.random.default_rng(2)
    a = rng.random((10, 12))
    p = picture(spark, a)
    m = one(grid.moments(p, "id"))
    assert m["edge_energy"] == pytest.approx(np.diff(a, axis=1).var() + np.diff(a, axis=0).var()) and m["contrast_std"] == pytest.approx(a.std())
    pad = np.pad(a, 1, mode="reflect")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * a
    assert one(grid.laplacian(p, "id"))["sharpness"] == pytest.approx(lap.var())
    corner = np.zeros((10, 10))
    corner[:2, :2] = 1
    r = one(grid.attention(picture(spark, corner), "id", (0, 0, 2, 2)))
    assert (r["corner_fraction"], r["box_fraction"], r["peak_in_box"]) == (1.0, 1.0, True) and r["box_lift"] > 1
    assert one(grid.attention(picture(spark, np.ones((10, 10))), "id", (0, 0, 2, 2)))["corner_fraction"] == pytest.approx(0.04)
    white = np.full((80, 100), 255.0)
    black = white.copy()
    black[:15, :20] = 0
    dot = white.copy()
    dot[0, 0] = 0
    assert [tuple(one(grid.black_box(picture(spark, x), "id")))[1:] for x in (black, dot)] == [(20, 15), (0, 0)]
    mask = spark.createDataFrame([("m", y, x, int((y, x) in {(1, 2), (3, 4)})) for y in range(5) for x in range(5)], "id string, y int, x int, label int")
    assert tuple(one(grid.centroid(mask, "id")))[1:] == (3.0, 2.0)


def test_quality_gate(spark):
    df = spark.createDataFrame([(400, 300, 115.0, 40.0, 500.0), (300, 100, 4.0, 0.0, 0.0)], "width int, height int, brightness double, contrast double, sharpness double")
    out = grid.quality_gate(df).collect()
    assert out[0]["accepted"] and len(out[1]["issues"]) >= 4


def test_bottom_crop(spark):
    yy, xx = np.mgrid[:128, :128]
    grey = np.where((yy // 4 + xx // 4) % 2, 155, 75)
    rgb = np.stack([grey] * 3, axis=2)
    rgb[96:] = (180, 120, 80)
    make = lambda a: spark.createDataFrame([("p", int(y), int(x), *map(float, a[y, x])) for y in range(128) for x in range(128)], "id string, y int, x int, r double, g double, b double")
    assert 0.75 <= one(grid.bottom_crop(make(rgb), "id"))["bottom"] < 0.9
    assert one(grid.bottom_crop(make(np.stack([grey] * 3, axis=2)), "id"))["bottom"] == 1.0


def test_activation_map(spark):
    rowsf = [("a", pos, c, v) for pos, (v1, v2) in enumerate([(2.0, 0.0), (1.0, 0.0), (0.0, 0.0)]) for c, v in enumerate((v1, v2))]
    f = spark.createDataFrame(rowsf, "id string, pos int, channel int, v double")
    p = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "channel int, gamma double, beta double, mean double, variance double, weight double, epsilon double")
    assert [r["cam"] for r in grid.activation_map(f, "id", "pos", "channel", "v", p).orderBy("pos").collect()] == [1.0, 0.5, 0.0]


def test_arc_step_on_a_sphere(spark):
    radius, p = 7.8, 75.0
    points = []
    for ring in range(12):
        y = 0.3 + 0.25 * ring
        z = radius - np.sqrt(radius**2 - y**2)
        tangent = y / np.sqrt(radius**2 - y**2)
        slope = y / (z - p)
        # the mirrored ray leaves at the angle whose cosine with the tangent equals the image ray's
        normal = np.array([-1.0, tangent]) / np.hypot(1.0, tangent)
        ray = np.array([p - z, -y]) / np.hypot(p - z, y)
        out = 2 * (ray @ normal) * normal - ray
        t = 40.0
        points.append(("e", 0, ring, p, float(slope), float(z + t * out[0]), float(y + t * out[1])))
    df = spark.createDataFrame(points, "id string, angle int, mire_num int, p double, slope double, object_z double, object_y double")
    got = surface.arc_step(df, "id").orderBy("mire_num").collect()
    assert len(got) == 12 and all(np.isfinite(r["roc"]) for r in got)
    for r, (*_, ring, _, slope, _, _) in zip(got, points, strict=True):
        y = 0.3 + 0.25 * ring
        assert r["y"] == pytest.approx(y, abs=1e-4) and r["z"] == pytest.approx(radius - np.sqrt(radius**2 - y**2), abs=1e-4) and r["roc"] == pytest.approx(radius, rel=0.02)
    blind = df.withColumn("object_y", F.when(F.col("mire_num") < 3, F.col("object_y")).otherwise(F.lit(1e9))).withColumn("slope", F.when(F.col("mire_num") < 3, F.col("slope")).otherwise(F.lit(0.0)))
    lost = surface.arc_step(blind.unionByName(df.withColumn("angle", F.lit(7))), "id").collect()
    assert len(lost) == 24 and sum(r["angle"] == 7 and np.isfinite(r["z"]) for r in lost) == 12


def test_zernike(spark):
    rng = np.random.default_rng(3)
    rho, theta = np.sqrt(rng.random(4000)), rng.random(4000) * 2 * np.pi
    basis = surface.zernike(rho, theta, 4)
    assert np.allclose(basis.T @ basis / len(rho), np.eye(15), atol=0.25)
    assert np.isnan(surface.zernike(np.array([1.1]), np.array([0.0]), 2)).all()
    assert [surface.noll(j) for j in range(1, 7)] == [(0, 0), (1, 1), (1, -1), (2, 0), (2, -2), (2, 2)]
    h = 1e-6
    assert np.allclose(surface.zernike(rho[:50] * 0.9, theta[:50], 4, 1), (surface.zernike(rho[:50] * 0.9 + h, theta[:50], 4) - surface.zernike(rho[:50] * 0.9 - h, theta[:50], 4)) / (2 * h), atol=1e-4)
    c = rng.normal(size=15)
    pts = spark.createDataFrame([("e", float(r), float(t), float(z)) for r, t, z in zip(rho[:600], theta[:600], basis[:600] @ c, strict=True)], "id string, rho double, theta double, z double")
    assert np.allclose(one(surface.zernike_fit(pts.repartition(4), "id", 4))["coefficients"], c)


def test_cone_location(spark):
    yy, xx = np.mgrid[:41, :41]
    a = 0.13 + 0.02 * np.exp(-((xx - 24) ** 2 + (yy - 18) ** 2) / 20)
    r = one(surface.cone_location(picture(spark, a), "id", 20, 20, 4, 16))
    assert abs(r["cone_x"] - 24) <= 1 and abs(r["cone_y"] - 18) <= 1 and r["clmi"] > 1 and 0 < r["ppk"] <= 1


# ---------------------------------------------------------------- decisions, review, queue


def test_scalars(spark):
    df = spark.createDataFrame([(0.1, 0.9), (0.45, 0.5), (0.2, 0.3)], "a double, b double")
    assert [r[0] for r in df.select(scalars.bands(F.col("a"), [(0.2, "none"), (0.45, "possible")], "suspected")).collect()] == ["none", "suspected", "possible"]
    assert [r[0] for r in df.select(scalars.abstain(F.col("a"), F.col("b"), 0.4)).collect()] == ["inconclusive", "suspected", "not_suspected"]
    with pytest.raises(Exception, match="outside"):
        df.select(scalars.decision(F.col("a") + 1, 0.5)).collect()
    box = F.expr("named_struct('x', 10.0, 'y', 30.0, 'width', 20.0, 'height', 40.0)")
    got = one(spark.range(1).select(scalars.map_box(box, F.lit(0), F.lit(20), F.lit(100), F.lit(100), 200).alias("m")))["m"]
    assert (got["x"], got["y"], got["width"], got["height"], got["cut"]) == (20, 25, 40, 100, False)
    zones = spark.createDataFrame([(a,) for a in (0.0, 40.0, 90.0, 180.0, 270.0, 350.0)], "a double").select(scalars.angle_zone(F.col("a"), (330, 30), (150, 210)))
    assert [r[0] for r in zones.collect()] == [1, 2, 2, 3, 4, 1]


def test_review_and_queue(spark):
    df = spark.createDataFrame([(f"{i}.png",) for i in (10, 9, 2)] + [("b.png",)], "n string")
    assert [r["n"] for r in df.orderBy(*review.natural_key(F.col("n"))).collect()] == ["2.png", "9.png", "10.png", "b.png"]
    got = review.spaced_samples(spark.range(100).repartition(7), ["id"], 8).orderBy("sample").collect()
    assert [r["id"] for r in got] == [round(i * 99 / 7) for i in range(8)]
    old = {"auc": 0.9, "box_lift": 1.5, "peaks_in_box": 20, "corner_attention": 0.03}
    assert all(review.acceptance(old, {"auc": 0.895, "sensitivity": 0.96, "specificity": 1.0, "box_lift": 1.5, "peaks_in_box": 21, "corner_attention": 0.02}).values())
    queue = spark.createDataFrame([("a", True), ("b", False)], "uri string, uploaded boolean")
    done = review.mark_uploaded(queue, spark.createDataFrame([("b",)], "uri string"))
    full = review.enqueue(done, spark.createDataFrame([("a",), ("c",), ("c",)], "uri string"))
    assert rows(full) == [("a", True), ("b", True), ("c", False)] and rows(review.pending(full)) == [("c", False)]


# ---------------------------------------------------------------- sources, sinks, streams, entry


def png(a):
    h, w, c = a.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines, up = b"", np.zeros(w * c, np.uint8)
    for y in range(h):
        flat = a[y].ravel()
        lines += bytes([2]) + (flat - up).astype(np.uint8).tobytes() if y % 2 else bytes([1]) + (flat - np.r_[np.zeros(c, np.uint8), flat[:-c]]).astype(np.uint8).tobytes()
        up = flat
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_picture_source(spark, tmp_path):
    from ocellus.sources import readers

    a = np.random.default_rng(5).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    (tmp_path / "normal").mkdir()
    (tmp_path / "normal/a.png").write_bytes(png(a))
    (tmp_path / "normal/._a.png").write_bytes(b"\x00\x05\x16\x07")
    (tmp_path / "normal/b.png").write_bytes(b"junk")
    df = readers.class_folders(spark, str(tmp_path), ["normal", "lesion"])
    got = {r["name"]: r for r in readers.decoded(df.select("name", "label", "content")).collect()}
    assert set(got) == {"a.png", "b.png"} and bytes(got["a.png"]["image"]["data"]) == a.tobytes() and got["a.png"]["label"] == 0 and got["b.png"]["error"] == "not a PNG"
    cells = readers.pixels(readers.decoded(df.select("name", "content")), "name")
    assert cells.count() == 30 and cells.filter("y = 2 AND x = 3").first()["g"] == a[2, 3, 1]


def test_tabular_sources_and_sinks(spark, tmp_path):
    from ocellus.sources import readers, writers

    head = "﻿filename,file_size,annotation_count,annotation_ID,attributes,shape_coordinates\n"
    line = 'a.png,10,1,0,"{""region"":""Cornea""%s}","{""name"":""rect"",""x"":1,""y"":2,""width"":3,""height"":4}"\n'
    (tmp_path / "ok.csv").write_text(head + line % ',""lesion"":""P""')
    (tmp_path / "bad.csv").write_text(head + line % "")
    assert readers.annotations(spark, str(tmp_path / "ok.csv")).first()["box"]["width"] == 3
    with pytest.raises(Exception, match="Missing lesion"):
        readers.annotations(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError, match="missing columns"):
        readers.csv(spark, str(tmp_path / "ok.csv"), ["nothing"])
    (tmp_path / "rings.txt").write_text("9 9\n1 10\n2 11\n4 13\n")
    assert [tuple(r) for r in readers.ring_geometry(spark, str(tmp_path / "rings.txt")).orderBy("mire_num").collect()] == [(0, 1.0, 10.0), (1, 2.0, 11.0), (2, 4.0, 13.0)]
    assert readers.ring_geometry(spark, str(tmp_path / "rings.txt"), True).count() == 5
    (tmp_path / "m.json").write_text(json.dumps({"3": {"10.5": 7}, "4": {"1": 2, "2": 3}}))
    assert readers.polar_sidecars(spark, str(tmp_path / "m.json")).count() == 3
    (tmp_path / "d.json").write_text(json.dumps({"confirmed_pairs": [["b", "a"]], "rejected_pairs": [["c", "d"]]}))
    assert rows(readers.review_decisions(spark, str(tmp_path / "d.json"))) == [("a", "b", "confirmed"), ("c", "d", "rejected")]
    df = spark.createDataFrame([(1, None)], "a int, b string")
    writers.csv(df.coalesce(1), str(tmp_path / "out"), ["b", "a", "c"])
    assert next((tmp_path / "out").glob("part*")).read_text().splitlines() == ["b,a,c", ",1,"]
    calls = []
    run = lambda: calls.append(1) or df.select("a")
    assert writers.locked(spark, str(tmp_path / "lock"), "f1", run).count() == writers.locked(spark, str(tmp_path / "lock"), "f1", run).count() == 1 and calls == [1]


def test_frame_grid(spark):
    from ocellus.sources import readers

    df = spark.createDataFrame([("v", i, i * 0.1) for i in range(10)], "video string, n int, t double")
    got = {round(r["grid_time"], 2): r["n"] for r in readers.frame_grid(df, "video", "t").collect()}
    assert got[0.0] == 0 and got[0.25] in (2, 3) and got[0.5] == 5


def test_streams(spark, tmp_path):
    from ocellus.streaming import live

    src = str(tmp_path / "in")
    spark.sql("SELECT 'v' AS video_id, id AS frame_no, timestamp_seconds(id) AS ts, id NOT IN (2, 9) AS good, CASE WHEN id < 8 THEN 10D ELSE 5D END AS value FROM range(14)").coalesce(1).write.parquet(src)
    for make, want in ((lambda s: live.good_streaks(s, 3), [("v", 5, 3), ("v", 8, 3), ("v", 12, 3)]), (live.sustained_drops, [("v", 8, 10.0)])):
        stream = make(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
        q = stream.writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert rows(spark.table("seen")) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
