"""Pixel-grid operators over rows (image, y, x, v): moments, sharpness, attention, activation maps, quality gates.

An image is a group of rows; window frames are partitioned by image and row or column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import issue_list, raise_unless


def from_array(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """Rows (key, y, x, v) of an array laid out row by row."""
    cells = df.select(key, F.posexplode(values).alias("p", "v"))
    return cells.select(key, F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).alias("x"), F.col("v").cast("double").alias("v"))


def tasks_for(df: DataFrame, each: int = 1 << 18) -> int:
    """So many partitions that one has about `each` rows of df, and as many as the session's shuffles at least: Spark deals by
    compressed bytes, which say little of rows that multiply after they are dealt."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // each))


def moments(pixels: DataFrame, key: str) -> DataFrame:
    """Mean, population deviation, and edge energy: the sum of the variances of the differences along x and along y."""
    dx = F.lead("v").over(Window.partitionBy(key, "y").orderBy("x")) - F.col("v")
    dy = F.lead("v").over(Window.partitionBy(key, "x").orderBy("y")) - F.col("v")
    return pixels.withColumn("dx", dx).withColumn("dy", dy).groupBy(key).agg(F.avg("v").alias("brightness_mean"), F.stddev_pop("v").alias("contrast_std"), (F.var_pop("dx") + F.var_pop("dy")).alias("edge_energy"))


def laplacian(pixels: DataFrame, key: str, interior: bool = False) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian; borders mirror (without the edge sample), or are left out."""
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    left, right, up, down = F.lag("v").over(row), F.lead("v").over(row), F.lag("v").over(column), F.lead("v").over(column)
    if interior:
        value = left + right + up + down - 4 * F.col("v")
    else:
        value = F.coalesce(left, right, "v") + F.coalesce(right, left, "v") + F.coalesce(up, down, "v") + F.coalesce(down, up, "v") - 4 * F.col("v")
    return pixels.withColumn("l", value).groupBy(key).agg(F.var_pop("l").alias("sharpness"))


def histogram(df: DataFrame, key: str, value: Column, levels: int = 256) -> DataFrame:
    """Share of each level of a value, levels beyond the ends clipped to them."""
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(value))).cast("int")
    counted = df.groupBy(key, level.alias("level")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def attention(pixels: DataFrame, key: str, box: tuple[float, float, float, float], corner: float = 0.2, border: float = 0.1) -> DataFrame:
    """Fractions of a heat-map in its top-left corner, border and box; lift; peak in box; overlap of the top tenth.

    box: x, y, width, height. A map that sums to 0 counts as 1 in total. The first largest value, row by row, is the peak.
    """
    x1, y1, bw, bh = box
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.percentile("v", F.lit(0.9)).alias("cut"), F.min_by(F.struct("y", "x"), F.struct(-F.col("v"), F.col("y"), F.col("x"))).alias("peak"))
    x, y, w, h, v = (F.col(c) for c in ("x", "y", "w", "h", "v"))
    part = lambda n, f: F.greatest(F.lit(1), F.ceil(n * f))
    in_corner = (x < part(w, corner)) & (y < part(h, corner))
    in_border = (y < part(h, border)) | (y >= h - part(h, border)) | (x < part(w, border)) | (x >= w - part(w, border))
    inside = lambda px, py: (px >= F.floor(F.lit(x1))) & (px < F.ceil(F.lit(x1 + bw))) & (py >= F.floor(F.lit(y1))) & (py < F.ceil(F.lit(y1 + bh)))
    in_box, top = inside(x, y), v >= F.col("cut")
    total = F.when(F.sum("v") > 0, F.sum("v")).otherwise(1.0)
    out = pixels.join(size, key).groupBy(key).agg(
        (F.sum(F.when(in_corner, v).otherwise(0.0)) / total).alias("corner_fraction"),
        (F.sum(F.when(in_border, v).otherwise(0.0)) / total).alias("border_fraction"),
        F.avg(in_box.cast("double")).alias("box_area"),
        (F.sum(F.when(in_box, v).otherwise(0.0)) / total).alias("box_fraction"),
        F.first(inside(F.col("peak.x"), F.col("peak.y"))).alias("peak_in_box"),
        (F.count_if(in_box & top) / F.count_if(in_box | top)).alias("top_box_iou"),
    )
    return out.withColumn("box_lift", F.when(F.col("box_area") > 0, F.col("box_fraction") / F.col("box_area")))


def activation_map(features: DataFrame, key: str, position: str, channel: str, value: str, parameters: DataFrame) -> DataFrame:
    """Class-activation map. `parameters`, one row per channel: gamma, beta, mean, variance, weight, epsilon.

    A normalised value counts where it is within (0, 6); a channel's weight is scaled by the share of positions where
    it does. The weighted sum of raw values is cut at 0 and divided by the map's maximum.
    """
    bn = (F.col(value) - F.col("mean")) / F.sqrt(F.col("variance") + F.col("epsilon")) * F.col("gamma") + F.col("beta")
    scale = F.col("gamma") / F.sqrt(F.col("variance") + F.col("epsilon"))
    rows = features.join(parameters, channel).withColumn("active", ((bn > 0) & (bn < 6)).cast("double"))
    share = rows.groupBy(key, channel).agg((F.avg("active") * F.first("weight") * F.first(scale)).alias("alpha"))
    cam = features.join(share, [key, channel]).groupBy(key, position).agg(F.greatest(F.lit(0.0), F.sum(F.col("alpha") * F.col(value))).alias("cam"))
    most = F.max("cam").over(Window.partitionBy(key))
    return cam.withColumn("cam", F.when(most > 0, F.col("cam") / most).otherwise(0.0))


def black_box(pixels: DataFrame, key: str, dark: float = 16.0, reach: float = 0.03, fill: float = 0.98) -> DataFrame:
    """Width and height of a dark box at the top-left corner, (0, 0) if it is too small or not filled."""
    size = pixels.groupBy(key).agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.min(F.when((F.col("y") == 0) & (F.col("v") > dark), F.col("x"))).alias("bw"), F.min(F.when((F.col("x") == 0) & (F.col("v") > dark), F.col("y"))).alias("bh")
    ).select(key, "w", "h", F.coalesce("bw", "w").alias("bw"), F.coalesce("bh", "h").alias("bh"))
    filled = pixels.join(size, key).filter("x < bw AND y < bh").groupBy(key).agg(F.avg((F.col("v") <= dark).cast("double")).alias("filled"))
    ok = (F.col("bw") >= reach * F.col("w")) & (F.col("bh") >= reach * F.col("h")) & (F.coalesce("filled", F.lit(0.0)) >= fill)
    return size.join(filled, key, "left").select(key, F.when(ok, F.col("bw")).otherwise(0).alias("box_width"), F.when(ok, F.col("bh")).otherwise(0).alias("box_height"))


def neutral_corner(pixels: DataFrame, key: str, fraction: float = 0.2, value: float = 127.0) -> DataFrame:
    """The top-left corner, a fraction of either side rounded up and a pixel at least, set to a neutral value."""
    size = Window.partitionBy(key)
    part = lambda c: F.greatest(F.lit(1), F.ceil((F.max(c).over(size) + 1) * fraction))
    return pixels.withColumn("v", F.when((F.col("x") < part("x")) & (F.col("y") < part("y")), F.lit(value)).otherwise(F.col("v")))


def corner_variants(df: DataFrame, n: int = 4) -> DataFrame:
    """Each row n times, with the number of the corner to patch."""
    return df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def centroid(mask: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Mean position of the pixels of the smallest non-zero label; null where there is none."""
    first = mask.groupBy(key).agg(F.min(F.when(F.col(label) != 0, F.col(label))).alias("first"))
    return mask.join(first, key).groupBy(key).agg(F.avg(F.when(F.col(label) == F.col("first"), F.col("x"))).alias("cx"), F.avg(F.when(F.col(label) == F.col("first"), F.col("y"))).alias("cy"))


QUALITY_LIMITS = {"min_side": 224, "min_aspect": 0.75, "max_aspect": 2.0, "min_brightness": 45.0, "max_brightness": 210.0, "min_contrast": 18.0, "min_sharpness": 20.0}


def quality_gate(df: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """issues and accepted from columns width, height, brightness, contrast, sharpness."""
    q = QUALITY_LIMITS | (limits or {})
    aspect, light = F.col("width") / F.col("height"), F.col("brightness")
    rules: Sequence[tuple[str, Column]] = [
        ("too_small", F.least("width", "height") < q["min_side"]),
        ("aspect", (aspect < q["min_aspect"]) | (aspect > q["max_aspect"])),
        ("too_dark", light < q["min_brightness"]),
        ("too_bright", (light >= q["min_brightness"]) & (light > q["max_brightness"])),
        ("low_contrast", F.col("contrast") < q["min_contrast"]),
        ("blurred", F.col("sharpness") < q["min_sharpness"]),
    ]
    return df.withColumn("issues", issue_list(rules)).withColumn("accepted", F.size("issues") == 0)


def bottom_crop(pixels: DataFrame, key: str, columns: tuple[int, int] = (13, 115)) -> DataFrame:
    """Height fraction to keep of a 128 x 128 preview (columns r, g, b): 1.0 unless the edges end well above a reddish-brown margin."""
    lo, hi = columns
    grey = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    inner = pixels.filter((F.col("x") >= lo) & (F.col("x") < hi)).withColumn("v", grey)
    step = F.abs(F.lead("v").over(Window.partitionBy(key, "x").orderBy("y")) - F.lag("v").over(Window.partitionBy(key, "x").orderBy("y")))
    rows = inner.withColumn("d", step).groupBy(key, "y").agg(F.avg("d").alias("e"))
    by_row = Window.partitionBy(key).orderBy("y")
    rows = rows.withColumn("e", F.coalesce("e", F.lag("e").over(by_row), F.lead("e").over(by_row)))
    at = F.explode(F.when(F.col("y") == 0, F.sequence(F.lit(-4), F.lit(0))).when(F.col("y") == 127, F.sequence(F.lit(127), F.lit(131))).otherwise(F.array(F.col("y").cast("int"))))
    energy = rows.select(key, "e", at.alias("y")).withColumn("energy", F.avg("e").over(by_row.rowsBetween(-4, 4))).filter("y BETWEEN 0 AND 127").select(key, "y", "energy")
    ranked = energy.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("energy")) - 1)
    ends = ranked.groupBy(key).agg(F.max(F.when(F.col("k") == 25, F.col("energy"))).alias("low"), F.max(F.when(F.col("k") == 114, F.col("energy"))).alias("peak"))
    act = energy.join(ends, key).withColumn("a", F.greatest(F.lit(0.0), F.col("energy") - F.col("low"))).withColumn("c", F.sum("a").over(by_row)).withColumn("t", F.sum("a").over(Window.partitionBy(key)))
    last = act.groupBy(key).agg(F.min(F.when(F.col("c") >= 0.95 * F.col("t"), F.col("y"))).alias("last"), F.first("low").alias("low"), F.first("peak").alias("peak"), F.first("t").alias("t"))
    margin = inner.filter("y >= 112").groupBy(key).agg(F.avg(F.col("r") - F.col("g")).alias("rg"), F.avg(F.col("g") - F.col("b")).alias("gb"))
    bottom = F.least(F.lit(1.0), (F.col("last") + 1) / 128 + 0.12)
    keep = (F.col("peak") >= F.col("low") + 1.5) & (F.col("t") > 0) & (bottom >= 0.75) & (1 - bottom >= 0.12) & (F.col("rg") >= 48) & (F.col("gb") >= 15)
    return last.join(margin, key).select(key, F.when(keep, bottom).otherwise(1.0).alias("bottom"))


def mean_sharpness(pixels: DataFrame, key: str) -> DataFrame:
    """Mean of the pictures' sharpness; an error if there is no picture."""
    out = laplacian(pixels, key).agg(F.avg("sharpness").alias("sharpness"))
    return raise_unless(out, F.col("sharpness").isNotNull(), "there is no frame")


def cropped(pixels: DataFrame, key: str, bottom: Column) -> DataFrame:
    """The rows of each picture above the fraction `bottom` of its height, rounded half up."""
    height = F.max("y").over(Window.partitionBy(key)) + 1
    return pixels.withColumn("_h", height).filter(F.col("y") < F.floor(F.col("_h") * bottom + 0.5)).drop("_h")


def overlay(pixels: DataFrame, value: str, heat: str, part: float = 0.58) -> DataFrame:
    """A picture's values mixed with its heat-map's."""
    return pixels.withColumn(value, part * F.col(value) + (1 - part) * F.col(heat)).drop(heat)


def attention_by_class(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Means of a value over rows of label 1 and of label 0, and the largest of label 0."""
    of = lambda y: F.when(F.col(label) == y, F.col(value))
    return df.groupBy(key).agg(F.avg(of(1)).alias("positive"), F.avg(of(0)).alias("negative"), F.max(of(0)).alias("worst"))


def resized(pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Pictures (key, y, x, v) in another size, bilinear: a triangle filter whose reach grows with the reduction, so that
    every source pixel counts. Rows and columns are weighted one after the other, each by one join-free pass and one aggregate."""

    def along(df: DataFrame, axis: str, other: str, size: int) -> DataFrame:
        n = F.max(axis).over(Window.partitionBy(key)) + 1
        scale = n / F.lit(float(size))
        reach = F.greatest(F.lit(1.0), scale)
        at = df.withColumn("_scale", scale).withColumn("_reach", reach)
        low, high = F.floor((F.col(axis) + 0.5 - F.col("_reach")) / F.col("_scale") - 0.5), F.ceil((F.col(axis) + 0.5 + F.col("_reach")) / F.col("_scale") - 0.5)
        met = at.withColumn("_to", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), low), F.least(F.lit(size - 1).cast("long"), F.greatest(high, F.lit(0))))))
        weight = 1 - F.abs(F.col(axis) + 0.5 - (F.col("_to") + 0.5) * F.col("_scale")) / F.col("_reach")
        met = met.withColumn("_w", weight).filter("_w > 0")
        return met.groupBy(key, other, F.col("_to").cast("int").alias(axis)).agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("v"))

    return along(along(pixels.select(key, "y", "x", "v"), "x", "y", width), "y", "x", height).select(key, "y", "x", "v")


def exposure(histogram: DataFrame, key: str, over: int, over_share: float, under: int, levels: int = 256) -> DataFrame:
    """over, under or normal of a histogram (key, level, share): the brightest level that occurs, and the share at the top."""
    top = histogram.groupBy(key).agg(F.max(F.when(F.col("share") > 0, F.col("level"))).alias("brightest"), F.coalesce(F.sum(F.when(F.col("level") == levels - 1, F.col("share"))), F.lit(0.0)).alias("clipped"))
    return top.withColumn("exposure", F.when((F.col("brightest") >= over) & (F.col("clipped") > over_share), "over").when(F.col("brightest") < under, "under").otherwise("normal"))


def glare(histogram: DataFrame, key: str, white: int, share: float, levels: int = 256) -> DataFrame:
    """Whether the brightest level that occurs is `white` or more, or the top level's share is over `share`."""
    top = exposure(histogram, key, levels, 1.0, 0, levels)
    return top.select(key, ((F.col("brightest") >= white) | (F.col("clipped") > share)).alias("glare"))


def framing_audit(pixels: DataFrame, key: str, most: int = 40) -> tuple[int, int, DataFrame]:
    """Pictures, those with a suggested crop, and the first `most` of these with the fraction to keep."""
    found = bottom_crop(pixels, key)
    n, cut = found.agg(F.count("*"), F.count_if(F.col("bottom") < 1)).first()
    return n, cut, found.filter("bottom < 1").orderBy(key).limit(most)


def nearest_filled(cells: DataFrame, key: str, value: str = "v", neighbours: int = 9) -> DataFrame:
    """Missing cells of a picture (key, y, x) filled with the mean of the nearest `neighbours` known ones; of equally distant ones
    the first row by row. One numpy pass per picture, a block of missing cells at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        v = pdf[value].to_numpy(float).copy()
        at = pdf[["y", "x"]].to_numpy(float)
        known, missing = np.flatnonzero(~np.isnan(v)), np.flatnonzero(np.isnan(v))
        for lo in range(0, missing.size if known.size else 0, 512):
            some = missing[lo : lo + 512]
            apart = ((at[some, None] - at[known]) ** 2).sum(2)
            v[some] = pdf[value].to_numpy(float)[known[np.argsort(apart, axis=1, kind="stable")[:, :neighbours]]].mean(1)
        return pdf.assign(**{value: v})

    return cells.select(key, "y", "x", value).groupBy(key).applyInPandas(run, f"`{key}` {cells.schema[key].dataType.simpleString()}, y int, x int, `{value}` double")
