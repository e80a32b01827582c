"""Windows and centres of photos and frames, the centring gate, the composed surface driver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.operators import edges, framing, polar, surface

R = np.random.default_rng(17)


def table(spark, pictures, value="v", kind="double"):
    rows = [(k, int(y), int(x), v.item()) for k, p in pictures.items() for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, f"k int, y int, x int, {value} {kind}")


def sizes(spark, pictures):
    return spark.createDataFrame([(k, p.shape[1], p.shape[0]) for k, p in pictures.items()], "k int, width int, height int")


def cells(df, value="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], {})[r["y"], r["x"]] = r[value]
    return out


def plain_window(p, cx, cy, side):
    y, x = max(0, cy - side // 2), max(0, cx - side // 2)
    return p[y : max(0, cy + side // 2), x : max(0, cx + side // 2)]


def plain_unzoomed(p, zoom):
    h, w = p.shape
    small = np.zeros((h // zoom, w // zoom))
    for (y, x), _ in np.ndenumerate(small):
        at = [min(max((d + 0.5) * n / (n // zoom) - 0.5, 0), n - 1) for d, n in ((y, h), (x, w))]
        lo = [math.floor(a) for a in at]
        for a in (0, 1):
            for b in (0, 1):
                weight = (1 - abs(lo[0] + a - at[0])) * (1 - abs(lo[1] + b - at[1]))
                if weight > 0:
                    small[y, x] += weight * p[lo[0] + a, lo[1] + b]
    out = np.zeros((h, w))
    oy, ox = (h - h // zoom) // 2, (w - w // zoom) // 2
    out[oy : oy + h // zoom, ox : ox + w // zoom] = np.floor(small.round(9) + 0.5)
    return out


@pytest.mark.parametrize("zoom", [2, 3])
def test_unzoomed(spark, zoom):
    pictures = {k: R.integers(0, 256, shape).astype(float) for k, shape in enumerate([(12, 18), (13, 17), (9, 20), (1, 1)])}
    whole = cells(framing.unzoomed(table(spark, pictures), sizes(spark, pictures), "k", zoom))
    for k, p in pictures.items():
        want = plain_unzoomed(p, zoom)
        got = np.zeros_like(want)
        for at, v in whole.get(k, {}).items():
            got[at] = v
        assert np.abs(got - want).max() == 0, k
    part = cells(framing.photo_windows(table(spark, pictures), sizes(spark, pictures), "k", zoom, 8))
    for k, p in pictures.items():
        want = plain_window(plain_unzoomed(p, zoom), p.shape[1] // 2, p.shape[0] // 2, 8)
        got = np.zeros_like(want)
        for at, v in part.get(k, {}).items():
            got[at] = v
        assert np.array_equal(got, want), k
    assert framing.unzoomed(table(spark, pictures).limit(0), sizes(spark, pictures), "k", zoom, 4).count() == 0


def test_photo_centres(spark):
    pictures = {k: np.zeros((60, 80)) for k in (1, 2, 3, 4)}
    marks = spark.createDataFrame([(1, 0.55, 0.4), (2, None, 0.3), (4, None, None)], "k int, fx double, fy double")
    masks = {2: np.zeros((10, 10), int), 4: np.zeros((10, 10), int)}
    masks[2][3:6, 4:9] = 2
    masks[2][0, 0] = 5  # only the smallest label counts
    got = {r["k"]: (r["cx"], r["cy"]) for r in framing.photo_centres(sizes(spark, pictures), "k", 2, 24, 10, marks, table(spark, masks, "label", "int")).collect()}
    assert got == {1: (44 // 2 + 20 - 28, 24 // 2 + 15 - 18), 2: (6 + 7, 4 + 7), 3: (None, None), 4: (None, None)}
    photos = table(spark, pictures)
    cut = framing.window(framing.photo_windows(photos, sizes(spark, pictures), "k", 2, 24), framing.photo_centres(sizes(spark, pictures), "k", 2, 24, 10, marks, table(spark, masks, "label", "int")), "k", 10)
    assert {r["k"]: r["count"] for r in cut.groupBy("k").count().collect()} == {1: len(range(9, 19)) * 10, 2: 100}


def test_frame_window(spark):
    frames, masks, want, middle = {}, {}, {}, {}
    for k, (cx, cy) in {1: (31, 24), 2: (40, 20), 3: (22, 33)}.items():
        yy, xx = np.mgrid[:50, :60]
        frames[k] = R.integers(0, 256, (50, 60)).astype(float)
        ring = np.where(np.abs(np.hypot(yy - cy, xx - cx) - 4) < 1, 1, np.where(np.abs(np.hypot(yy - cy, xx - cx) - 7) < 1, 2, 0))
        masks[k] = plain_window(ring, 30, 25, 40)
        middle[k], want[k] = (cx, cy), plain_window(frames[k], cx, cy, 16)
    frames[4], masks[4] = np.ones((50, 60)), np.zeros((40, 40), int)
    got, centres = framing.frame_window(table(spark, frames), sizes(spark, frames), table(spark, masks, "label", "int"), "k", 40, 16)
    assert {r["k"]: (r["cx"], r["cy"]) for r in centres.collect()} == middle | {4: (None, None)}
    held = cells(got)
    assert held.keys() == want.keys()
    for k, p in want.items():
        assert held[k] == {at: v for at, v in np.ndenumerate(p)}
    inner = spark.createDataFrame([(1, 2, 3, 1), (1, 2, 3, 1), (1, 0, 0, 0), (2, 5, 5, 7)], "k int, y int, x int, label int")
    marked = cells(framing.frame_mask(got, inner, "k"), "mire")
    assert {(k, *at) for k, p in marked.items() for at, v in p.items() if v == 0} == {(1, 2, 3), (2, 5, 5)}
    assert sum(map(len, marked.values())) == 3 * 256


def test_centring_gate(spark):
    yy, xx = np.mgrid[:64, :72]
    planted = {1: (35, 31), 2: (41, 36)}
    pictures = {k: np.where((np.hypot(yy - cy, xx - cx) / 6).astype(int) % 2 == 1, 180, 60) + R.integers(-4, 5, yy.shape) for k, (cx, cy) in planted.items()}
    pictures[3] = np.full(yy.shape, 90)
    points = edges.canny(table(spark, {k: p.astype(float) for k, p in pictures.items()}), "k")
    found = framing.circle_centre(points, "k", 5, 25, 6, 3.0)
    got = {r["k"]: r for r in framing.centred(found, "k", (F.lit(35), F.lit(31)), 4.0, 1.0, F.lit(2.0)).collect()}
    assert got.keys() == {1, 2}
    for k, (cx, cy) in planted.items():
        assert abs(got[k]["cx"] - cx) <= 1 and abs(got[k]["cy"] - cy) <= 1 and got[k]["circles"] >= 2
        assert got[k]["offset"] == pytest.approx(math.hypot(got[k]["cx"] - 35, got[k]["cy"] - 31) / 2)
    assert got[1]["centred"] and not got[2]["centred"]


SENSOR, RESOLUTION, FOCAL = (6.4, 4.8), (4000, 3000), 4.76


def sphere(radius, distance, rings=12, reach=40.0):
    """Slope of each ring's image, and the ring's radius and height over the rings' end."""
    out = []
    for ring in range(rings):
        y = 0.4 + 0.22 * ring
        z = radius - math.sqrt(radius**2 - y**2)
        normal = np.array([-1.0, y / math.sqrt(radius**2 - y**2)])
        normal /= np.hypot(*normal)
        ray = np.array([-distance - z, -y])
        ray /= np.hypot(*ray)
        back = 2 * (ray @ normal) * normal - ray
        out.append((y / (z + distance), float(y + reach * back[1]), float(z + reach * back[0] + distance)))
    return out


def test_reconstructed_sphere(spark):
    radius, distance, scale = 7.8, 75.0, FOCAL * RESOLUTION[0] / SENSOR[0]
    rings = sphere(radius, distance)
    objects = spark.createDataFrame([(m, r, h) for m, (_, r, h) in enumerate(rings)], "mire_num int, object_radius double, object_height double")
    points = [("e", m, a, 2000 + s * scale * math.cos(math.radians(a)), 1500 + s * scale * math.sin(math.radians(a))) for a in range(0, 360, 15) for m, (s, _, _) in enumerate(rings) if not (a == 45 and m == 0)]
    df = spark.createDataFrame(points, "id string, mire_num int, angle int, x double, y double")
    eyes = spark.createDataFrame([("e", 2000.0, 1500.0, distance, 0.0)], "id string, cx double, cy double, distance double, gap double")
    got = surface.reconstructed(df, eyes, objects, "id", SENSOR, RESOLUTION, FOCAL, [(80, 100)]).collect()
    vertex = [r for r in got if r["angle"] is None]
    shape = [r for r in got if r["angle"] is not None]
    assert len(vertex) == 1 and (vertex[0]["x"], vertex[0]["y"], vertex[0]["z"], vertex[0]["roc"]) == (0, 0, 0, None)
    assert {r["angle"] for r in shape} == set(range(0, 360, 15)) - {45, 90} and len(shape) == 22 * 12
    norm = 0.4 + 0.22 * 11
    for r in shape:
        y = 0.4 + 0.22 * r["mire_num"]
        assert r["norm"] == pytest.approx(norm, abs=1e-4) and math.hypot(r["x"], r["y"]) * r["norm"] == pytest.approx(y, abs=1e-4)
        assert r["z"] == pytest.approx(radius - math.sqrt(radius**2 - y**2), abs=1e-4) and r["roc"] == pytest.approx(radius, rel=0.02)
        assert r["max_radius"] == int(rings[-1][0] * scale) // 2 * 2
    steps = df.sparkSession.createDataFrame([(r["angle"], surface.DIOPTRES / r["roc"] / surface.DIOPTRES) for r in shape], "angle int, k double").withColumn("id", F.lit("e"))
    k = surface.simk(steps, "id", "angle", "k").first()
    assert k["flat_k"] == pytest.approx(43.3, abs=0.4)


def test_meridians_balance_the_first_ring(spark):
    rings = sphere(7.6, 70.0, 5)
    objects = spark.createDataFrame([(m, r, h) for m, (_, r, h) in enumerate(rings)], "mire_num int, object_radius double, object_height double")
    eyes = spark.createDataFrame([("e", 10.0, 20.0, 70.0, 2.5)], "id string, cx double, cy double, distance double, gap double")
    radii = {(0, 0): 4.0, (0, 1): 9.0, (180, 0): 5.0, (180, 2): 11.0, (90, 0): 6.0, (30, 1): 7.0}
    df = spark.createDataFrame([("e", m, a, 10 + r * math.cos(math.radians(a)), 20 + r * math.sin(math.radians(a))) for (a, m), r in radii.items()], "id string, mire_num int, angle int, x double, y double")
    got = {(r["angle"], r["mire_num"]): r for r in surface.meridians(df, eyes, objects, "id", SENSOR, RESOLUTION, FOCAL).collect()}
    pixel = SENSOR[0] / RESOLUTION[0] / FOCAL
    want = {(a, m + 1): r * pixel for (a, m), r in radii.items() if a != 30} | {(0, 0): 4.5 * pixel, (180, 0): 4.5 * pixel}
    assert got.keys() == want.keys()  # no ring 0 at 90, no meridian at 30
    for (a, m), slope in want.items():
        r = got[a, m]
        assert r["slope"] == pytest.approx(-slope) and r["p"] == 72.5
        assert (r["object_y"], r["object_z"]) == (rings[max(m, 1) - 1][1], 70.0 - rings[max(m, 1) - 1][2])
    assert surface.reconstructed(df.limit(0), eyes, objects, "id", SENSOR, RESOLUTION, FOCAL).count() == 0
