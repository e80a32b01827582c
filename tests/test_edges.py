"""Edges, thresholds, morphology, circles and the map index against loops over small pictures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.operators import edges, surface

R = np.random.default_rng(9)


def table(spark, pictures, key="k"):
    return spark.createDataFrame([(k, y, x, int(v)) for k, p in pictures.items() for (y, x), v in np.ndenumerate(p)], f"{key} int, y int, x int, v long").repartition(3)


def plain_canny(p, sigma=0.33):
    h, w = p.shape
    q = np.pad(p.astype(int), 1, mode="edge")
    gx, gy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            n = q[y : y + 3, x : x + 3]
            gx[y, x] = (n[:, 2] - n[:, 0]) @ [1, 2, 1]
            gy[y, x] = (n[2] - n[0]) @ [1, 2, 1]
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    v = np.median(p)
    low, high = int(max(0, (1 - sigma) * v)), int(min(255, (1 + sigma) * v))
    thin = {}
    for y in range(h):
        for x in range(w):
            c, a, b = m[y + 1, x + 1], abs(gx[y, x]) * 13573, abs(gy[y, x]) << 15
            if b < a:
                ok = c > m[y + 1, x] and c >= m[y + 1, x + 2]
            elif b > a + (abs(gx[y, x]) << 16):
                ok = c > m[y, x + 1] and c >= m[y + 2, x + 1]
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                ok = c > m[y, x + 1 - s] and c > m[y + 2, x + 1 + s]
            if ok and c > low:
                thin[y, x] = c > high
    todo = [p for p, strong in thin.items() if strong]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for near in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if near in thin and near not in found:
                found.add(near)
                todo.append(near)
    return found


def test_canny(spark):
    pictures = {0: R.integers(0, 256, (12, 15)), 1: np.full((6, 6), 80), 2: np.repeat([[20, 200]], 8, 0).repeat(5, 1), 3: R.integers(60, 120, (20, 9)), 4: np.array([[7]])}
    y, x = np.mgrid[:24, :24]
    pictures[5] = np.where(np.hypot(y - 12, x - 11) < 7, 40, 180)
    got = {k: set() for k in pictures}
    for r in edges.canny(table(spark, pictures), "k").collect():
        got[r["k"]].add((r["y"], r["x"]))
    assert got == {k: plain_canny(p) for k, p in pictures.items()} and got[5]
    assert edges.canny(table(spark, pictures).limit(0), "k").count() == 0


def test_otsu(spark):
    pictures = {0: R.integers(0, 256, (9, 9)), 1: np.array([[10] * 5, [200] * 5]), 2: np.full((3, 3), 5), 3: np.r_[R.normal(60, 8, (20, 5)), R.normal(160, 9, (20, 5))].round()}
    got = {r["k"]: r["threshold"] for r in edges.otsu(table(spark, pictures), "k").collect()}
    want = {}
    for k, p in pictures.items():
        flat = np.sort(p.ravel())
        scores = [(-(flat <= t).sum() * (flat > t).sum() * (flat[flat <= t].mean() - flat[flat > t].mean()) ** 2, t) for t in np.unique(flat)[:-1]]
        if scores:
            want[k] = min((round(s, 6), t) for s, t in scores)[1]
    assert got == want and 2 not in got and 70 < got[3] < 140


@pytest.mark.parametrize("size", [3, 5])
def test_morphology(spark, size):
    masks = {k: R.random((9, 11)) < share for k, share in enumerate((0.05, 0.6, 0.97, 1.0))}
    points = table(spark, masks).filter("v = 1").select("k", "y", "x")
    half = size // 2
    for f, test in ((edges.dilated, np.any), (edges.eroded, np.all)):
        want = {(k, y, x) for k, m in masks.items() for y in range(9) for x in range(11) if test(m[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1])}
        assert {tuple(r) for r in f(points, "k", F.lit(11), F.lit(9), size).collect()} == want


def test_planted_circles(spark):
    y, x = np.mgrid[:70, :80]
    planted = {1: (38, 33, 20), 2: (30, 40, 12), 3: (50, 30, 27)}
    noisy = {k: np.where(np.hypot(y - cy, x - cx) < r, 60, 170) + R.integers(-6, 7, y.shape) for k, (cx, cy, r) in planted.items()}
    found = edges.circles(edges.canny(table(spark, noisy), "k"), "k", 8, 30).collect()
    assert len(found) == 3
    for r in found:
        assert np.abs(np.array([r["cx"], r["cy"], r["r"]]) - planted[r["k"]]).max() <= 1
    ringed = edges.outside(spark.createDataFrame([(1, 10, 10), (1, 10, 21), (2, 0, 0)], "k int, y int, x int"), spark.createDataFrame([(1, 10.0, 10.0)], "k int, cx double, cy double"), "k", 10)
    assert [tuple(r)[1:] for r in ringed.collect()] == [(10, 21)]


def test_kisa_of_map(spark):
    h, w = 40, 44
    maps, eyes, want = {1: 0.12 + 0.05 * R.random((h, w)), 2: np.full((h, w), 0.05), 3: 0.15 + 0.02 * R.random((h, w))}, [(1, 22, 20, 9.5, 2.0), (2, 21, 19, 5.0, 1.0), (3, 20, 21, 12.0, 0.5)], {}
    ring = {(m, a): ((2 + m) * math.cos(math.radians(a)), (2 + m) * math.sin(math.radians(a))) for m in (0, 1, 2, 7, 15) for a in range(0, 360, 2)}
    for k, cx, cy, r, ast in eyes:
        p = maps[k]
        at = lambda m, a, p=p, cx=cx, cy=cy: p[int(ring[m, a][1] + cy), int(ring[m, a][0] + cx)]
        central = max(1, 337.5 * np.mean([at(m, a) for m in (0, 1, 2) for a in range(0, 360, 2)]) - 47.2)
        top = [max((at(m, a), -a, -m) for a in range(lo, hi + 1, 2) for m in (2, 15)) for lo, hi in ((10, 170), (190, 350))]
        apart = -top[1][1] + top[0][1]
        skew = max(180 - min(apart, 360 - apart), 1)
        mean = lambda angles, p=p, cx=cx, cy=cy, r=r: np.mean([p[int(cy + r * math.sin(math.radians(a))), int(cx + r * math.cos(math.radians(a)))] for a in angles])
        i_s = max(1, 337.5 * abs(mean((210, 240, 270, 300, 300)) - mean((30, 60, 90, 120, 150))))
        want[k] = (central, skew, i_s, central * i_s * ast * skew * 0.33)
    grid = spark.createDataFrame([(k, y, x, float(v)) for k, p in maps.items() for (y, x), v in np.ndenumerate(p)], "k int, y int, x int, k_ double").withColumnRenamed("k", "eye").withColumnRenamed("k_", "k")
    rings = spark.createDataFrame([(k, m, a, *xy) for k in maps for (m, a), xy in ring.items()], "eye int, mire_num int, angle int, x double, y double")
    got = {r["eye"]: (r["central_k"], r["srax"], r["i_s"], r["kisa"]) for r in surface.kisa_of_map(grid, rings, spark.createDataFrame(eyes, "eye int, cx int, cy int, r_3 double, astigmatism double"), "eye").collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=0.006)
