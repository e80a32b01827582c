"""Edges, thresholds, circles and binary morphology of picture tables (key, y, x, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import tasks_for

#: Tangent of 22.5 degrees in units of 2^-15 (fixed value).
TANGENT = 13_573


def gradient(pixels: DataFrame, key: str) -> DataFrame:
    """Adds gx and gy, the 3 x 3 Sobel sums (rows and columns repeated beyond the border), and magnitude |gx| + |gy|."""
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    before, after = F.coalesce(F.lag("v").over(row), "v"), F.coalesce(F.lead("v").over(row), "v")
    across = pixels.withColumn("_d", after - before).withColumn("_s", before + 2 * F.col("v") + after)
    up, down = (lambda c: F.coalesce(F.lag(c).over(column), F.col(c))), (lambda c: F.coalesce(F.lead(c).over(column), F.col(c)))
    out = across.withColumn("gx", up("_d") + 2 * F.col("_d") + down("_d")).withColumn("gy", down("_s") - up("_s"))
    return out.withColumn("magnitude", F.abs("gx") + F.abs("gy")).drop("_d", "_s")


def suppressed(gradients: DataFrame, key: str) -> DataFrame:
    """The points whose magnitude is largest across the edge: more than the neighbour before, at least the one behind along a
    row or column, more than both along a diagonal. Beyond the border there is nothing."""
    row, column, zero = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y"), F.lit(0.0)
    m = F.col("magnitude").cast("double")
    wide = gradients.withColumn("_m", m).withColumn("_l", F.coalesce(F.lag("_m").over(row), zero)).withColumn("_r", F.coalesce(F.lead("_m").over(row), zero))
    at = lambda f, c: F.coalesce(f(c).over(column), zero)
    around = wide.select("*", *(at(f, c).alias(f"{n}{c}") for n, f in (("u", F.lag), ("d", F.lead)) for c in ("_m", "_l", "_r")))
    ax, ay = F.abs("gx") * TANGENT, F.abs("gy") * 32_768
    c = F.col("_m")
    flat = (c > F.col("_l")) & (c >= F.col("_r"))
    steep = (c > F.col("u_m")) & (c >= F.col("d_m"))
    falling = (c > F.col("u_l")) & (c > F.col("d_r"))
    rising = (c > F.col("u_r")) & (c > F.col("d_l"))
    sloped = F.when((F.col("gx") < 0) != (F.col("gy") < 0), rising).otherwise(falling)
    return around.filter(F.when(ay < ax, flat).when(ay > ax + F.abs("gx") * 65_536, steep).otherwise(sloped)).select(gradients.columns)


def canny(pixels: DataFrame, key: str, sigma: float = 0.33) -> DataFrame:
    """Edge points (key, y, x, gx, gy): suppressed points above the upper threshold, and those above the lower one that hang
    together with them through their eight neighbours. Thresholds are the median less and plus the share sigma, cut to whole
    levels of 0 to 255. The growing of regions is one pass per picture over its remaining points, the rest windows."""
    middle = pixels.groupBy(key).agg(F.percentile("v", F.lit(0.5)).alias("_median"))
    low, high = F.floor(F.greatest(F.lit(0.0), (1 - sigma) * F.col("_median"))), F.floor(F.least(F.lit(255.0), (1 + sigma) * F.col("_median")))
    thin = suppressed(gradient(pixels, key), key).join(middle, key).filter(F.col("magnitude") > low)
    thin = thin.select(key, "y", "x", "gx", "gy", (F.col("magnitude") > high).alias("strong"))

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, strong = pdf["y"].to_numpy(int), pdf["x"].to_numpy(int), pdf["strong"].to_numpy(bool)
        if not strong.any():
            return pdf[:0].drop(columns="strong")
        open_ = np.zeros((y.max() - y.min() + 3, x.max() - x.min() + 3), bool)
        y, x = y - y.min() + 1, x - x.min() + 1
        open_[y, x] = True
        front = np.stack([y[strong], x[strong]])
        open_[tuple(front)] = False
        steps = np.array([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]).T
        while front.size:
            near = (front[:, :, None] + steps[:, None]).reshape(2, -1)
            near = np.unique(near[:, open_[tuple(near)]], axis=1)
            open_[tuple(near)] = False
            front = near
        return pdf[~open_[y, x]].drop(columns="strong")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in thin.schema if f.name != "strong")
    return thin.groupBy(key).applyInPandas(grown, schema)


def outside(points: DataFrame, centres: DataFrame, key: str, radius: float = 10.0) -> DataFrame:
    """The points further than the radius from their picture's centre (cx, cy): edges without the innermost circle."""
    c = centres.select(key, F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
    return points.join(c, key).filter((F.col("x") - F.col("_cx")) ** 2 + (F.col("y") - F.col("_cy")) ** 2 > radius * radius).drop("_cx", "_cy")


def otsu(pixels: DataFrame, key: str, value: str = "v", levels: int = 256) -> DataFrame:
    """The threshold that parts a picture's levels with the largest variance between the two sides, the smallest of equals:
    levels up to it are one side. Pictures of one level have none. One row a level meets in the window, not a row a pixel."""
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(value))).cast("long")
    counts = pixels.groupBy(key, level.alias("level")).agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy(key).orderBy("level"), Window.partitionBy(key)
    n, s = F.col("n"), F.col("n") * F.col("level")
    sums = counts.select(key, "level", F.sum(n).over(up).alias("c"), F.sum(s).over(up).alias("s"), F.sum(n).over(whole).alias("c_all"), F.sum(s).over(whole).alias("s_all"))
    gap = F.col("s_all").cast("double") * F.col("c") - F.col("s").cast("double") * F.col("c_all")
    parted = sums.filter("c < c_all").withColumn("between", gap * gap / (F.col("c").cast("double") * (F.col("c_all") - F.col("c"))))
    return parted.groupBy(key).agg(F.min_by("level", F.struct(-F.col("between"), F.col("level"))).cast("int").alias("threshold"))


def _around(size: int) -> Column:
    """Steps (dy, dx) of a square of odd size."""
    half = size // 2
    return F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-half, half + 1) for b in range(-half, half + 1)))


def dilated(points: DataFrame, key: str, width: Column, height: Column, size: int = 3) -> DataFrame:
    """Points (key, y, x) of a mask and all within a square around them, inside the picture."""
    moved = points.select(key, "y", "x", width.alias("_w"), height.alias("_h"), F.explode(_around(size)).alias("s")).select(key, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "_w", "_h")
    return moved.filter("y >= 0 AND x >= 0 AND y < _h AND x < _w").select(key, "y", "x").distinct()


def eroded(points: DataFrame, key: str, width: Column, height: Column, size: int = 3) -> DataFrame:
    """Points of a mask whose square holds no other points inside the picture than the mask's. A square has size * size
    points, so a point is counted by its neighbours and compared with how many it has."""
    half = size // 2
    moved = points.select(key, "y", "x", width.alias("_w"), height.alias("_h"), F.explode(_around(size)).alias("s")).select(key, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "_w", "_h")
    span = lambda c, end: F.least(F.col(c) + half, F.col(end) - 1) - F.greatest(F.col(c) - half, F.lit(0)) + 1
    counted = moved.filter("y >= 0 AND x >= 0 AND y < _h AND x < _w").groupBy(key, "y", "x", "_w", "_h").agg(F.count("*").alias("_n"))
    return counted.filter(F.col("_n") == span("y", "_h") * span("x", "_w")).select(key, "y", "x")


def circles(edges: DataFrame, key: str, least: int, most: int, top: int = 1, jump: int | None = None) -> DataFrame:
    """The circles (cx, cy, r, score) that most edge points lie on, `top` a picture, or with `jump` a band of so many radii: every edge point votes, along its gradient
    and against it, for a centre at each radius, and for the cells beside it; a score is votes by radius. Points
    are dealt by picture and radius, in numbers that follow theirs, and vote there; only the best of each radius are dealt on."""
    length = F.hypot(F.col("gx").cast("double"), F.col("gy").cast("double"))
    votes = edges.filter(length > 0).select(key, "x", "y", (F.col("gx") / length).alias("ux"), (F.col("gy") / length).alias("uy"), F.explode(F.sequence(F.lit(least), F.lit(most))).alias("r"))
    votes = votes.repartition(tasks_for(edges, max(1, (1 << 18) // (most - least + 1))), key, "r")
    votes = votes.withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("s", F.explode(_around(3)))
    cell = lambda c, u, d: (F.round(F.col(c) + F.col("way") * F.col("r") * F.col(u)) + F.col(f"s.{d}")).cast("int")
    found = votes.groupBy(key, cell("x", "ux", "dx").alias("cx"), cell("y", "uy", "dy").alias("cy"), "r").agg(F.count("*").alias("n"))
    band = F.lit(0) if jump is None else F.floor((F.col("r") - least) / jump)
    order = F.desc("score"), "cy", "cx", "r"
    best = found.withColumn("score", F.col("n") / F.col("r")).withColumn("rank", F.row_number().over(Window.partitionBy(key, "r").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("_band", band).withColumn("rank", F.row_number().over(Window.partitionBy(key, "_band").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select(key, "rank", "cx", "cy", "r", "score")
