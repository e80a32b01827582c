"""Surface reconstruction and indices: ray steps, polynomial fits, curvature, keratometry, cone location."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIOPTRES = 337.5


def _arc(z: np.ndarray, y: np.ndarray, last: np.ndarray, vertex: bool) -> tuple[np.ndarray, np.ndarray]:
    """Slope dz/dy and second derivative at (z, y) of the arc to it: a parabola from the vertex, or a cubic that leaves
    the last point with that point's height, distance, slope and second derivative."""
    z0, y0, s0, q0 = last[..., None] if z.ndim > last.ndim - 1 else last
    run = y - y0
    if vertex:
        return 2 * z / y, 2 * z / y**2
    rest = z - z0 - s0 * run - 0.5 * q0 * run**2  # what the cubic term has to add
    return s0 + q0 * run + 3 * rest / run, q0 + 6 * rest / run**2


def _lean(z: np.ndarray, ray: np.ndarray, oz: np.ndarray, oy: np.ndarray, p: np.ndarray, last: np.ndarray, vertex: bool) -> np.ndarray:
    """By how far the law of reflection fails at height z of an image ray: the surface tangent's part of the unit vectors
    to the camera and to the object, which cancel where the mirror image is."""
    y = (z - p) * ray
    slope, _ = _arc(z, y, last, vertex)
    camera = (slope * (p - z) - y) / np.hypot(p - z, y)
    target = (slope * (oz - z) + oy - y) / np.hypot(oz - z, oy - y)
    return (camera + target) / np.hypot(slope, 1.0)


def reflections(p: float | np.ndarray, slopes: np.ndarray, object_z: np.ndarray, object_y: np.ndarray, step: float = 0.01, reach: float = 100.0, halvings: int = 44) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heights, distances and radii of curvature, shape (meridians, rings), of a mirror seen by a camera at p on its axis.

    A ring's image ray is y = (z - p) * slope, and the surface point is where that ray is reflected to the ring's
    object. Rings follow each other from the axis. All meridians are solved at once, of many pictures (p is one distance, or one a
    meridian): from the height that the last
    arc foretells, steps are taken, many at a time, towards the side where the failure of the law of reflection changes
    sign, and that step is halved. NaN slopes mark missing rings at the end of a meridian; where no change of sign is
    within reach, that ring and those after it are NaN.
    """
    found = np.full((3, *slopes.shape), np.nan)
    last = np.zeros((4, len(slopes)))  # z, y, slope, second derivative
    ahead = np.arange(1, 33) * step
    cameras = np.broadcast_to(np.asarray(p, float), len(slopes))
    for ring in range(slopes.shape[1]):
        live = np.flatnonzero(np.isfinite(slopes[:, ring]) & (np.isfinite(found[0, :, ring - 1]) if ring else True))
        ray, oz, oy = (a[live, ring] for a in (slopes, object_z, object_y))
        p = cameras[live]
        z0, y0, s0, q0 = held = last[:, live]
        run = (z0 - p) * ray - y0
        low = np.zeros(live.size) if ring == 0 else z0 + s0 * run + 0.5 * q0 * run**2
        at_low = _lean(low, ray, oz, oy, p, held, ring == 0) if ring else np.sign(_lean(np.full(live.size, step * 1e-6), ray, oz, oy, p, held, True))
        side = np.where(at_low < 0, 1.0, -1.0)
        open_, high = np.arange(live.size), np.full(live.size, np.nan)
        for _ in range(int(reach / step / ahead.size)):
            if not open_.size:
                break
            tried = low[open_, None] + side[open_, None] * ahead
            turned = _lean(tried, *(x[open_, None] for x in (ray, oz, oy, p)), held[:, open_], ring == 0) * side[open_, None] > 0
            any_, where = turned.any(1), turned.argmax(1)
            hit = open_[any_]
            high[hit] = tried[any_, where[any_]]
            low[hit] = high[hit] - side[hit] * step
            low[open_[~any_]] = tried[~any_, -1]
            open_ = open_[~any_]
        for _ in range(halvings):
            middle = (low + high) / 2
            beyond = _lean(middle, ray, oz, oy, p, held, ring == 0) * side > 0
            high, low = np.where(beyond, middle, high), np.where(beyond, low, middle)
        z = (low + high) / 2
        y = (z - p) * ray
        slope, bend = _arc(z, y, held, ring == 0)
        last[:, live] = z, y, slope, bend
        found[:, live, ring] = z, y, (1 + slope**2) ** 1.5 / np.maximum(np.abs(bend), 1e-12)
    return tuple(found)


def arc_step(points: DataFrame, key: str, p: str = "p", block: int = 1024) -> DataFrame:
    """Surface points of each picture: columns p (camera distance, one a picture), mire_num, slope, object_z, object_y in; z, y, roc
    out (null where no point fits). Rows without a slope give no row. A meridian (angle) is one row on its way to the
    solver, which takes `block` of them at once, of whichever pictures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, block) for batch in batches for at in range(0, batch.num_rows, block)):
            rings = part["r"]
            size = pc.list_value_length(rings).to_numpy(zero_copy_only=False)
            flat = rings.flatten()
            row = np.repeat(np.arange(size.size), size)
            place = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
            grid = np.full((3, size.size, int(size.max(initial=0))), np.nan)
            for held, c in zip(grid, ("slope", "object_z", "object_y"), strict=True):
                held[row, place] = flat.field(c).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", divide="ignore"):
                out = [pa.array(x[row, place]) for x in reflections(part["p"].to_numpy(), *grid)]
            yield pa.RecordBatch.from_arrays([part["k"].take(pa.array(row)), part["angle"].take(pa.array(row)), flat.field("mire_num"), *out], names=[key, "angle", "mire_num", "z", "y", "roc"])

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, long work: not to be coalesced by size
    ring = F.struct(F.col("mire_num").cast("int").alias("mire_num"), *(F.col(c).cast("double").alias(c) for c in ("slope", "object_z", "object_y")))
    rows = points.filter(F.col("slope").isNotNull() & ~F.isnan("slope")).repartition(tasks, key, "angle")
    lines = rows.groupBy(F.col(key).alias("k"), "angle").agg(F.first(F.col(p).cast("double")).alias("p"), F.sort_array(F.collect_list(ring)).alias("r"))
    return lines.mapInArrow(run, f"`{key}` {points.schema[key].dataType.simpleString()}, angle {points.schema['angle'].dataType.simpleString()}, mire_num int, z double, y double, roc double")


def cloud(surface: DataFrame, key: str, most_z: float = 2.0) -> DataFrame:
    """x, y, z of surface points below a height."""
    t = F.radians(F.col("angle").cast("double"))
    return surface.filter(F.col("z") < most_z).select(key, (F.col("y") * F.cos(t)).alias("x"), (F.col("y") * F.sin(t)).alias("y"), "z")


def pixel_slope(x: Column, y: Column, sensor: tuple[float, float], resolution: tuple[int, int], focal: float) -> Column:
    """Slope of the image ray of a pixel offset from the centre."""
    return F.hypot(x * sensor[0] / resolution[0], y * sensor[1] / resolution[1]) / focal


def meridians(points: DataFrame, eyes: DataFrame, objects: DataFrame, key: str, sensor: tuple[float, float], resolution: tuple[int, int], focal: float) -> DataFrame:
    """What arc_step takes, from ring points (key, mire_num from 0, angle in whole degrees, x, y), eyes (key, cx, cy, distance
    from the camera to the rings' end, gap behind it) and the rings themselves (mire_num, object_radius, object_height;
    with the key too where pictures are of different devices).

    Heights count from the surface towards the camera, so that an eye's are below 0. Ring m stands as m + 1. Before it comes ring 0 with the first ring's object, whose slope is the mean of the first ring's
    here and half a turn away, so that both halves of a meridian begin alike; where it is the first ring's own slope (to
    a millionth), or there is no other, the first ring begins. Meridians without a first ring are left out."""
    from .polar import opposite

    at = points.join(eyes, key).join(objects, [key, "mire_num"] if key in objects.columns else "mire_num")
    slope = pixel_slope(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), sensor, resolution, focal)
    rows = at.select(key, "angle", (F.col("mire_num") + 1).cast("int").alias("mire_num"), (F.col("distance") + F.col("gap")).alias("p"), (-slope).alias("slope"), (F.col("distance") - F.col("object_height")).alias("object_z"), F.col("object_radius").alias("object_y"), F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")).alias("_far"))
    first = opposite(rows.filter("mire_num = 1"), [key], "angle", "slope")
    begun = rows.join(first.select(key, "angle"), [key, "angle"], "left_semi")
    start = first.filter("abs(balanced - slope) > 1e-6 * abs(slope)").withColumn("slope", F.col("balanced")).withColumn("mire_num", F.lit(0)).drop("balanced")
    return begun.unionByName(start.select(begun.columns))


def reconstructed(points: DataFrame, eyes: DataFrame, objects: DataFrame, key: str, sensor: tuple[float, float], resolution: tuple[int, int], focal: float, skipped: Sequence[tuple[float, float]] = (), most_z: float = 2.0) -> DataFrame:
    """The surface behind ring points, from pixels to a cloud over the unit disc: slopes, first rings balanced with the other half,
    the reflection solver, points below most_z. Columns key, angle, mire_num (from 0), x, y (divided by norm), z (depth), roc, norm
    (the largest distance from the axis) and max_radius (pixels, the even number at or below the farthest ring point), and for
    each picture the vertex (0, 0, 0) without angle, ring and roc. Angles within `skipped` (from, to; ends included) only
    balance their opposites. Rings that no surface point fits, and those outside them, are left out."""
    rows = meridians(points, eyes, objects, key, sensor, resolution, focal)
    far = points.join(eyes.select(key, "cx", "cy"), key).groupBy(key).agg((2 * F.floor(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))) / 2)).cast("int").alias("max_radius"))
    blind = reduce(lambda a, b: a | b, (F.col("angle").between(*s) for s in skipped), F.lit(False))
    solved = arc_step(rows.filter(~blind).drop("_far"), key).filter((F.col("mire_num") >= 1) & ~F.isnan("z") & F.col("z").isNotNull())
    t, solved = F.radians(F.col("angle").cast("double")), solved.withColumn("z", -F.col("z"))
    seen = solved.filter(F.col("z") < most_z).select(key, "angle", (F.col("mire_num") - 1).alias("mire_num"), (F.col("y") * F.cos(t)).alias("x"), (F.col("y") * F.sin(t)).alias("y"), "z", "roc")
    whole = F.hypot(F.col("x"), F.col("y"))
    names = ("angle", "mire_num", "x", "y", "z", "roc")
    vertex = F.struct(*(F.lit(0.0 if c in "xyz" else None).cast(seen.schema[c].dataType).alias(c) for c in names))
    pictures = seen.groupBy(key).agg(F.max(whole).alias("norm"), F.collect_list(F.struct(*names)).alias("_p")).join(far.hint("merge"), key)  # solved once
    points_ = pictures.select(key, "norm", "max_radius", F.explode(F.concat("_p", F.array(vertex))).alias("_p"))
    return points_.select(key, "_p.angle", "_p.mire_num", (F.col("_p.x") / F.col("norm")).alias("x"), (F.col("_p.y") / F.col("norm")).alias("y"), "_p.z", "_p.roc", "norm", "max_radius")


def noll(j: int) -> tuple[int, int]:
    """(n, m) of the Noll index j >= 1."""
    n = 0
    while (n + 1) * (n + 2) // 2 < j:
        n += 1
    k = j - n * (n + 1) // 2
    m = 2 * (k // 2) if n % 2 == 0 else 2 * ((k - 1) // 2) + 1
    return n, m if j % 2 == 0 else -m


def radial_coefficients(n: int, m: int) -> np.ndarray:
    """Powers n, n - 1, ..., 0 of the radial polynomial."""
    out = np.zeros(n + 1)
    for s in range((n - abs(m)) // 2 + 1):
        out[2 * s] = (-1) ** s * factorial(n - s) / (factorial(s) * factorial((n + abs(m)) // 2 - s) * factorial((n - abs(m)) // 2 - s))
    return out


def zernike(rho: np.ndarray, theta: np.ndarray, degree: int, derivative: int = 0) -> np.ndarray:
    """Basis values (or radial derivatives) at points: shape (points, (degree + 1)(degree + 2) / 2); NaN outside the unit disc."""
    columns = []
    for j in range(1, (degree + 1) * (degree + 2) // 2 + 1):
        n, m = noll(j)
        poly = radial_coefficients(n, m)
        for _ in range(derivative):
            poly = np.polyder(poly) if poly.size > 1 else np.zeros(1)
        angular = np.ones_like(theta) if m == 0 else np.cos(m * theta) if m > 0 else np.sin(-m * theta)
        columns.append(np.sqrt((n + 1) * (1 if m == 0 else 2)) * np.polyval(poly, rho) * angular)
    return np.where((rho <= 1)[:, None], np.stack(columns, axis=1), np.nan)


def normal_equations(df: DataFrame, key: str, terms: dict[str, Column], target: Column) -> DataFrame:
    """Sums of products of all terms and of terms with the target, one row per key: combined where the rows are."""
    names = list(terms)
    sums = [F.count("*").alias("n")]
    for i, a in enumerate(names):
        sums += [F.sum(terms[a] * terms[b]).alias(f"{a}__{b}") for b in names[i:]] + [F.sum(terms[a] * target).alias(f"{a}__target")]
    return df.groupBy(key).agg(*sums)


def solve(sums: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Least-squares coefficients from normal_equations, one small solve per key."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                gram = np.array([[r[f"{a}__{b}"] if f"{a}__{b}" in r else r[f"{b}__{a}"] for b in names] for a in names], float)
                rows.append([r[key], *np.linalg.lstsq(gram, np.array([r[f"{a}__target"] for a in names], float), rcond=None)[0].tolist()])
            yield pd.DataFrame(rows, columns=[key, *names])

    return sums.mapInPandas(run, f"`{key}` {sums.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in names))


def zernike_fit(points: DataFrame, key: str, degree: int) -> DataFrame:
    """Coefficients (key, coefficients array) of z over the unit disc, from rho, theta and z: each partition sends one
    Gram matrix per key, and those are added up per key."""
    size = (degree + 1) * (degree + 2) // 2
    kind = points.schema[key].dataType.simpleString()

    def gram(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key, dropna=False):
                b = zernike(g["rho"].to_numpy(float), g["theta"].to_numpy(float), degree)
                ok = ~np.isnan(b[:, 0])
                b, z = b[ok], g["z"].to_numpy(float)[ok]
                yield pd.DataFrame({key: [k], "sums": [np.r_[(b.T @ b).ravel(), b.T @ z].tolist()]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)
        c = np.linalg.lstsq(total[: size * size].reshape(size, size), total[size * size :], rcond=None)[0]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "coefficients": [c.tolist()]})

    parts = points.select(key, "rho", "theta", "z").mapInPandas(gram, f"`{key}` {kind}, sums array<double>")
    return parts.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, coefficients array<double>")


def curvatures(d1: Column, d2: Column, rho: Column, scale: Column) -> tuple[Column, Column]:
    """Meridional and tangential curvature from the radial derivatives of a surface over the unit disc, whose radius is `scale`."""
    slope = d1 / scale
    return d2 / scale**2 / F.pow(1 + slope**2, 1.5), slope / F.sqrt(1 + slope**2) / (rho * scale + 1e-7)


def simk(meridians: DataFrame, key: str, angle: str, curvature: str, period: int = 180) -> DataFrame:
    """Flattest meridian by mean curvature (first of equals), its partner a half period on, both in dioptres."""
    means = meridians.groupBy(key, F.pmod(angle, F.lit(period)).alias("a")).agg((F.avg(curvature) * DIOPTRES).alias("k"))
    flat = means.groupBy(key).agg(F.min_by(F.struct("a", "k"), F.struct("k", "a")).alias("f"))
    flat = flat.select(key, F.col("f.a").alias("flat_angle"), F.col("f.k").alias("flat_k"), F.pmod(F.col("f.a") + period // 2, F.lit(period)).alias("steep_angle"))
    return flat.join(means.select(key, F.col("a").alias("steep_angle"), F.col("k").alias("steep_k")), [key, "steep_angle"], "left").select(key, "flat_angle", "flat_k", "steep_angle", "steep_k")


def cone_location(grid: DataFrame, key: str, cx: int, cy: int, small: int, large: int) -> DataFrame:
    """Cone index and probability. The steepest disc of radius `small` within the circle of radius `large`, its excess
    over the rest (m1), that of the opposite disc (m2), and the logistic of the index in dioptres. Columns x, y, v."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy(float) for c in ("x", "y", "v"))
        inside = (x - cx) ** 2 + (y - cy) ** 2 <= large**2
        x, y, v = x[inside], y[inside], v[inside]

        def excess(px: float, py: float) -> tuple[float, float]:
            disc = (x - px) ** 2 + (y - py) ** 2 <= small**2
            return (v[disc].mean() if disc.any() else np.nan), (v[disc].mean() - v[~disc].mean() if disc.any() and (~disc).any() else np.nan)

        order = np.lexsort((x, y))
        steep = np.array([excess(x[i], y[i])[0] for i in order])
        best = order[int(np.nanargmax(steep))]
        away = float(np.hypot(x[best] - cx, y[best] - cy))
        t = np.arctan2(y[best] - cy, x[best] - cx + 1e-9) + np.pi
        m1, m2 = excess(x[best], y[best])[1], excess(int(cx + away * np.cos(t)), int(cy + away * np.sin(t)))[1]
        index = (m1 - away / small * m2 if away < small else m1 - m2) * DIOPTRES
        return pd.DataFrame({key: [pdf[key].iloc[0]], "cone_x": [x[best]], "cone_y": [y[best]], "m1": [m1], "m2": [m2], "clmi": [round(index, 2)], "ppk": [round(float(1 / (1 + np.exp(6.4483 - 2.1319 * index))), 2)]})

    return grid.select(key, "x", "y", "v").groupBy(key).applyInPandas(run, f"`{key}` {grid.schema[key].dataType.simpleString()}, cone_x double, cone_y double, m1 double, m2 double, clmi double, ppk double")


def kisa(central_k: Column, inferior: Column, superior: Column, astigmatism: Column, skew: Column) -> Column:
    """Product index of central steepness, inferior-superior asymmetry, astigmatism and axis skew."""
    return F.greatest(F.lit(1.0), central_k - 47.2) * F.greatest(F.lit(1.0), DIOPTRES * F.abs(inferior - superior)) * astigmatism * F.greatest(F.lit(1.0), skew) * 0.33


#: Angles at which the superior and the inferior half are sampled, 300 twice, and the rings of the steepest radii (fixed values).
SUPERIOR, INFERIOR, CENTRAL, STEEPEST = (30, 60, 90, 120, 150), (210, 240, 270, 300, 300), (0, 1, 2), (2, 15)


def kisa_of_map(grid: DataFrame, rings: DataFrame, eyes: DataFrame, key: str) -> DataFrame:
    """central_k, srax, i_s and kisa of curvature maps: grid (key, y, x, k), ring points (key, mire_num, angle, x, y as offsets from
    the centre) and eyes (key, cx, cy, r_3, astigmatism). Positions are cut to whole pixels; points beyond the map are not counted.

    central_k is the mean of the three innermost rings, srax the skew of the steepest points of two rings in the lower (10 to
    170 degrees) and the upper half (190 to 350), the first of equals by angle and ring; a half without a positive point, or
    one above -1, counts as angle -1. i_s compares five samples on the circle r_3 of either half."""
    cut = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    at = rings.filter(F.col("mire_num").isin(*CENTRAL, *STEEPEST)).join(eyes.select(key, "cx", "cy"), key)
    at = at.select(key, "mire_num", "angle", cut(F.col("y") + F.col("cy")).alias("y"), cut(F.col("x") + F.col("cx")).alias("x")).join(grid.select(key, "y", "x", "k"), [key, "y", "x"])
    steep = lambda lo, hi: F.min_by("angle", F.when(F.col("mire_num").isin(*STEEPEST) & F.col("angle").between(lo, hi) & (F.col("k") > -1), F.struct(-F.col("k"), F.col("angle"), F.col("mire_num"))))
    found = at.groupBy(key).agg(F.avg(F.when(F.col("mire_num").isin(*CENTRAL), F.col("k"))).alias("_k"), steep(10, 170).alias("_lower"), steep(190, 350).alias("_upper"))
    far = F.radians(F.col("_a").cast("double"))
    taken = eyes.select(key, "cx", "cy", "r_3", F.explode(F.array(*map(F.lit, (*SUPERIOR, *INFERIOR)))).alias("_a"))
    taken = taken.select(key, "_a", cut(F.col("cx") + F.col("r_3") * F.cos(far)).alias("x"), cut(F.col("cy") + F.col("r_3") * F.sin(far)).alias("y")).join(grid.select(key, "y", "x", "k"), [key, "y", "x"])
    halves = taken.groupBy(key).agg(F.avg(F.when(F.col("_a") < 180, F.col("k"))).alias("_s"), F.avg(F.when(F.col("_a") > 180, F.col("k"))).alias("_i"))
    apart = F.coalesce("_upper", F.lit(-1)) - F.coalesce("_lower", F.lit(-1))
    both = eyes.select(key, "astigmatism").join(found, key).join(halves, key)
    skew = F.greatest(180 - F.least(apart, 360 - apart), F.lit(1)).cast("double")
    told = both.select(key, F.greatest(F.lit(1.0), DIOPTRES * F.col("_k") - 47.2).alias("central_k"), skew.alias("srax"), F.greatest(F.lit(1.0), DIOPTRES * F.abs(F.col("_i") - F.col("_s"))).alias("i_s"), kisa(DIOPTRES * F.col("_k"), F.col("_i"), F.col("_s"), F.col("astigmatism"), skew).alias("kisa"))
    return told.withColumn("kisa", F.round("kisa", 2))


def axial(grid: DataFrame, key: str, angle: str, radius: str, curvature: str) -> DataFrame:
    """Mean curvature from the centre out to each point along its ray, in dioptres."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, angle).orderBy(radius)
    return grid.withColumn("axial", F.avg(curvature).over(w) * DIOPTRES)


def turned(coefficients: np.ndarray, angle: float) -> np.ndarray:
    """Coefficients (Noll order) of a surface turned by an angle in radians: the cosine and sine terms of each order mix."""
    names = [noll(j) for j in range(1, coefficients.size + 1)]
    place, out = {nm: i for i, nm in enumerate(names)}, coefficients.astype(float).copy()
    for (n, m), i in place.items():
        if m > 0:
            k = place.get((n, -m))
            a, b = coefficients[i], coefficients[k] if k is not None else 0.0
            out[i] = a * np.cos(m * angle) - b * np.sin(m * angle)
            if k is not None:
                out[k] = a * np.sin(m * angle) + b * np.cos(m * angle)
    return out


def mirrored(coefficients: np.ndarray, across_x: bool = True) -> np.ndarray:
    """Coefficients of a surface mirrored across the x axis (theta to -theta), or the y axis (theta to pi - theta)."""
    out = coefficients.astype(float).copy()
    for i in range(out.size):
        m = noll(i + 1)[1]
        odd = m < 0 if across_x else (m < 0) == (abs(m) % 2 == 0) and m != 0
        out[i] *= -1 if odd else 1
    return out


def projected(points: DataFrame, key: str, degree: int) -> DataFrame:
    """Coefficients (key, coefficients array) by inner products with the basis: rho, theta, z and the area that each point stands for.
    Sums only, combined where the rows are; exact as far as the points and areas integrate the unit disc."""
    kind = points.schema[key].dataType.simpleString()

    def part(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key, dropna=False):
                b = np.nan_to_num(zernike(g["rho"].to_numpy(float), g["theta"].to_numpy(float), degree))
                yield pd.DataFrame({key: [k], "sums": [(b.T @ (g["z"].to_numpy(float) * g["area"].to_numpy(float)) / np.pi).tolist()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "coefficients": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0).tolist()]})

    parts = points.select(key, "rho", "theta", "z", "area").mapInPandas(part, f"`{key}` {kind}, sums array<double>")
    return parts.groupBy(key).applyInPandas(total, f"`{key}` {kind}, coefficients array<double>")
