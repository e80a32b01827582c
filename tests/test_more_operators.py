"""Ridge kernels, frame breaks, masks, heads and cascades."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.operators import breaks, enhance, masks, polar
from ocellus.operators.signal import find_peaks


def one(df):
    return df.collect()[0]


def stripes(size=152, period=8, degrees=0.0):
    y, x = np.mgrid[:size, :size]
    t = np.radians(degrees)
    return 100 + 50 * np.cos(2 * np.pi * (x * np.cos(t) + y * np.sin(t)) / period)


@pytest.mark.parametrize("degrees", [0.0, 30.0, 90.0])
def test_ridge_orientation_and_frequency(degrees):
    a, mask = enhance.block_mask(stripes(degrees=degrees))
    assert mask.all() and abs(a.mean()) < 1e-9
    inner = enhance.orientation(a)[40:-40, 40:-40]
    want = np.radians(180 - degrees) - np.pi / 2 if degrees <= 90 else 0
    gap = np.abs((inner - np.median(inner) + np.pi / 2) % np.pi - np.pi / 2)
    assert gap.max() < 0.1
    assert min(abs(np.median(inner) % np.pi - w % np.pi) for w in (want, np.pi / 2 + np.radians(degrees), np.pi / 2 - np.radians(degrees), want + np.pi)) < 0.1
    _, mean = enhance.frequency(a * 10, mask, enhance.orientation(a))
    assert mean == pytest.approx(1 / 8, rel=0.15)


@pytest.mark.parametrize(("period", "within"), [(6, True), (14, True), (4, False), (20, False)])
def test_ridge_frequency_range(period, within):
    a, mask = enhance.block_mask(stripes(period=period, degrees=30.0))
    freq, mean = enhance.frequency(a, mask, enhance.orientation(a))
    assert mean == (pytest.approx(1 / period, rel=0.02) if within else 0.0) and freq.shape == a.shape
    assert enhance.frequency(a[:20, :20], mask[:20, :20], a[:20, :20])[1] == 0.0


def test_oriented_filter_is_the_gabor_sum():
    a, _ = enhance.block_mask(stripes(120, 9, 30.0))
    direction, f = enhance.orientation(a), 0.11
    got = enhance.oriented_filter(a, direction, np.full(a.shape, f))
    s = 0.65 / f
    n = int(round(3 * s))
    y, x = np.mgrid[-n : n + 1, -n : n + 1]
    for r, c in ((60, 60), (40, 77), (n, n)):
        t = np.radians(3 * round(np.degrees(direction[r, c]) / 3)) - np.pi / 2
        wave = np.exp(-((x**2 + y**2) / s**2)) * np.cos(2 * np.pi * f * (x * np.cos(t) + y * np.sin(t)))
        assert got[r, c] == pytest.approx((a[r - n : r + n + 1, c - n : c + n + 1] * wave).sum(), rel=1e-3, abs=1e-2)
    assert not got[: n - 1].any() and not enhance.oriented_filter(a, direction, np.zeros(a.shape)).any()


def test_ridges_per_picture(spark):
    a = stripes(114)
    df = spark.createDataFrame([("p", 114, 114, a.ravel().tolist())], "id string, width int, height int, data array<double>")
    r = one(enhance.per_picture(df, "id", lambda x: (enhance.block_mask(x)[0], 0.0), "normal"))
    assert np.allclose(r["normal"], enhance.block_mask(a)[0].ravel()) and r["mean"] == 0.0


def frame_rows(rng):
    out = []
    for ring in range(1, 10):
        for k in range(720):
            angle = k / 2
            signal = rng.random() * 0.5 + (3.0 if rng.random() < 0.01 else 0.0) + (5.0 if abs(angle - 172) < 0.3 and ring % 2 else 0.0)
            r = 20.0 + 5 * ring + (30.0 if ring == 5 and 60 <= angle < 62 else 0.0)
            if not (ring == 9 and 80 < angle < 140):
                out.append(("f", ring, angle, float(r * np.cos(np.radians(angle))), float(r * np.sin(np.radians(angle))), float(signal), 1.0))
    return out


def brute_candidates(rows):
    rings = {}
    for _, m, a, x, y, s, t in sorted(rows, key=lambda r: (r[1], r[2])):
        rings.setdefault(m, []).append((a, x, y, s, t))
    rings = {m: np.array(v) for m, v in rings.items()}

    def peaks(v):
        return v[find_peaks(v[:, 3] - v[:, 4], height=0.0)[0], 0] if len(v) else np.zeros(0)

    found = []
    for m, v in rings.items():
        if m <= 15 and m % 2:
            found += [("l", a) for a in peaks(v[(v[:, 0] > 150) & (v[:, 0] < 210)])]
            found += [("r", a - 360 if a > 330 else a) for a in peaks(v[(v[:, 0] > 330) | (v[:, 0] < 30)])]
    agreed = [(s, a) for s, a in found if sum(abs(a - b) < 5 for _, b in found) > 3]
    left = np.mean([a for s, a in agreed if s == "l"]) if any(s == "l" for s, _ in agreed) else 180.0
    right = np.mean([a for s, a in agreed if s == "r"]) if any(s == "r" for s, _ in agreed) else 0.0

    def arc(v):
        a = v[:, 0]
        return v[(a > right + 364.5) | (a < left - 4.5)] if right + 4.5 < 0 else v[(a > right + 4.5) & (a < left - 4.5)]

    points = int((left - 9 - right) / 0.5)
    full = max([m for m, v in rings.items() if m % 2 and len(arc(v)) > 0.99 * points], default=0)
    if not full:
        return left, right, set()
    edges = {}
    for m, v in rings.items():
        v = arc(v)
        far = np.flatnonzero(np.hypot(*np.diff(v[:, 1:3], axis=0).T) > 10)
        edges[m] = {v[i, 0] for k in far for i in (k, k + 1)} if m % 2 else set()
    out = set()
    for m, v in rings.items():
        for a in peaks(arc(v)):
            if m % 2 and m >= full and any(abs(e - a) <= 5 for e in edges[m] | edges.get(m + 2, set())):
                continue
            out.add((m, a))
    return left, right, out


@pytest.mark.parametrize("seed", [1, 2])
def test_break_candidates(spark, seed):
    rows = frame_rows(random.Random(seed))
    df = spark.createDataFrame(rows, "frame string, mire_num int, angle double, x double, y double, signal double, threshold double")
    left, right, want = brute_candidates(rows)
    s = one(breaks.supports(df, "frame"))
    assert (s["left_support"], s["right_support"]) == (pytest.approx(left), pytest.approx(right))
    got = {(r["mire_num"], r["angle"]) for r in breaks.break_candidates(df, "frame").collect()}
    assert got == want and want


def test_temporal_validity(spark):
    rows = []
    for ring, dark in ((5, True), (7, False)):
        for frame in range(120):
            dip = 60.0 * np.exp(-(((frame - 60) / 8.0) ** 2)) if dark else 0.0
            rows += [("v", ring, a, frame, float(150 - dip)) for a in (0.0, 0.5, 360.0, 10.0, 10.5, 9.5)]
    intensities = spark.createDataFrame(rows, "video string, mire_num int, angle double, frame int, intensity double")
    df = spark.createDataFrame([(1, "v", 5, 0.0, 62), (2, "v", 5, 10.0, 5), (3, "v", 7, 10.0, 62), (4, "v", 8, 10.0, 62), (5, "v", 5, 200.0, 62)], "break_id int, video string, mire_num int, angle double, frame int")
    assert sorted(r["break_id"] for r in breaks.temporally_valid(intensities, df, "video", 60.0).collect()) == [1, 4]


def test_masks(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("a", 0, 0)], "id string, output int, label int")
    r = one(masks.mask_scores(df, "id"))
    assert (r["accuracy"], r["iou"], r["precision"]) == (0.5, pytest.approx(1 / 3), 0.5)
    coded = spark.createDataFrame([(0, 0), (100, 200), (200, 0), (200, 200)], "g int, r int").select(masks.coded_label(F.col("g"), F.col("r")))
    assert [x[0] for x in coded.collect()] == [0, 0, 255, 254]
    line = [("a", i, 0, float(i == 5) * 6) for i in range(12)]
    d = one(masks.line_discs(spark.createDataFrame(line, "id string, x int, y int, v double"), "id", 2.0))
    assert (d["max_steep"], d["min_steep"]) == (pytest.approx(6 / 5), 0.0)
    g = one(masks.working_gap(spark.createDataFrame([("a", 20, 90.0), ("a", 20, 99.0), ("a", 19, 500.0)], "id string, mire_num int, radius double"), "id", 20, 576.0, 1.0))
    assert (g["diameter"], g["gap"]) == (192.0, 4.0)


def test_head_and_cascade(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [1, 5] + [0, 3]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=300) * 0.3 > 0.3).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t), 1.0) for (a, b), t in zip(x, y, strict=True)], "a double, b double, y double, w double")
    c, b0 = masks.refit_head(df, ["a", "b"], "y", "w", 1.0)
    assert (((x @ c + b0) > 0) == (y > 0)).mean() > 0.9
    items = spark.createDataFrame([(i,) for i in range(6)], "id int")
    stage = lambda k: lambda df: df.withColumn("status", F.when(F.col("id") % k == 0, "ok").otherwise("failed"))
    assert sorted((r["id"], r["stage"], r["status"]) for r in masks.cascade(items, "id", [stage(3), stage(2)]).collect()) == [(0, 0, "ok"), (1, 1, "failed"), (2, 1, "ok"), (3, 0, "ok"), (4, 1, "ok"), (5, 1, "failed")]




# ---------------------------------------------------------------- ring neighbours and components


def plain_graph(points, radial=1.0, least=1.5):
    """Pairs by either end's rule, in the order in which going through the points finds them."""
    near = {i: [] for i, *_ in points}
    for i, angle, radius, x, y in points:
        ux, uy = x / math.hypot(x, y), y / math.hypot(x, y)
        for j, other, _, u, v in points:
            dx, dy = u - x, v - y
            if other != angle and abs(dx * ux + dy * uy) <= radial and abs(dy * ux - dx * uy) <= max(2 * radius * math.pi / 180, least):
                near[i] += [] if j in near[i] else [j]
                near[j] += [] if i in near[j] else [i]
    return near


def plain_components(points, near):
    angle, found, n = {p[0]: p[1] for p in points}, {}, 0
    for i, *_ in points:
        if i in found:
            continue
        todo, angles, n = [i], [angle[i]], n + 1
        while todo:
            at = todo.pop()
            found[at] = n
            fresh = [j for j in near[at] if j not in found and j not in todo and angle[j] not in angles]
            todo += fresh
            angles += [angle[j] for j in fresh]
    return {frozenset(i for i in found if found[i] == c) for c in found.values()}


def test_ring_neighbours_along_and_across(spark):
    kind = "k int, id long, angle double, radius double, x double, y double"
    two = [(1, 1, 0.0, 10.0, 10.0, 0.0), (1, 2, 7.3, math.hypot(10.9, 1.4), 10.9, 1.4)]  # 1.4 across, 0.9 along, 1.66 apart
    assert [tuple(r)[1:] for r in polar.neighbour_graph(spark.createDataFrame(two, kind), "k").collect()] == [(1, 2, True, False)]
    step = [(1, 1, 0.0, 10.0, 10.0, 0.0), (1, 2, 2.0, 10.0, 10.0, 0.35), (1, 3, 2.0, 10.6, 10.6, 0.37)]  # two of one angle enter together
    points = spark.createDataFrame(step, kind)
    assert len({r["component"] for r in polar.ring_components(points, polar.neighbour_graph(points, "k"), "k", 1).collect()}) == 1


@pytest.mark.parametrize("seed", range(3))
def test_ring_components_of_pictures(spark, seed):
    """Four rings of a picture, wobbling, broken and touching, away from the origin."""
    rnd = random.Random(seed)
    points = []
    for ring in range(4):
        for angle in range(0, 360, rnd.choice((1, 2, 3))):
            if rnd.random() < 0.93:
                r = 6.0 + 5 * ring + rnd.choice((0, 0, 0, 0.7, -0.8)) + (2.5 * math.sin(angle / 9) if ring == 2 else 0)
                points.append((angle * 4 + ring, float(angle), r, r * math.cos(math.radians(angle)), r * math.sin(math.radians(angle))))
    points.sort()
    near = plain_graph(points)
    df = spark.createDataFrame([(7, *p[:3], p[3] + 50, p[4] + 80, 50.0, 80.0) for p in points], "k int, id long, angle double, radius double, x double, y double, cx double, cy double")
    edges = polar.neighbour_graph(df, "k", centre=("cx", "cy"))
    assert {(r["a"], r["b"]) for r in edges.collect()} == {(min(i, j), max(i, j)) for i in near for j in near[i]}
    got = {}
    for r in polar.ring_components(df, edges, "k", 1).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(x) for x in got.values()} == plain_components(points, near)
