"""Where a picture's rings are: windows about a centre, centres from marks, masks or circles, the centring gate.

Pictures are rows (key, y, x, v) beside a table of their sizes (key, width, height). Masks are rows (key, y, x, label) in the
coordinates of the window they were made of; the model that makes them is not part of this. A window of an even side
reaches from its centre less half the side up to, without, its centre plus half the side. It is cut at the picture's
border, and its coordinates count from the corner that is left. Everything is joins by picture and filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import circles
from .grid import centroid, tasks_for


def _corner(centre: Column, side: int) -> Column:
    return F.greatest(F.lit(0), centre - side // 2)


def middles(pictures: DataFrame, key: str) -> DataFrame:
    """The middle (cx, cy) of each picture, in whole pixels."""
    return pictures.select(key, F.floor(F.col("width") / 2).cast("int").alias("cx"), F.floor(F.col("height") / 2).cast("int").alias("cy"))


def window(pixels: DataFrame, centres: DataFrame, key: str, side: int) -> DataFrame:
    """The pixels of a square about each picture's centre (cx, cy), counted from the square's corner. Pictures whose centre is
    null or missing give no rows."""
    at = pixels.join(centres.select(key, F.col("cx").alias("_cx"), F.col("cy").alias("_cy")), key)
    for axis in ("x", "y"):
        lo, hi = _corner(F.col(f"_c{axis}"), side), F.col(f"_c{axis}") + side // 2
        at = at.filter((F.col(axis) >= lo) & (F.col(axis) < hi)).withColumn(axis, (F.col(axis) - lo).cast("int"))
    return at.drop("_cx", "_cy")


def found_centres(mask: DataFrame, about: DataFrame, key: str, side: int) -> DataFrame:
    """The centre of the smallest label of each mask, cut to whole pixels, in the coordinates of the picture that the mask's
    window about (cx, cy) was taken of. A mask without a label, or none at all, gives a null centre."""
    inside = centroid(mask, key).select(key, F.floor("cx").alias("_mx"), F.floor("cy").alias("_my"))
    moved = lambda axis: (F.col(f"_m{axis}") + _corner(F.col(f"c{axis}"), side)).cast("int").alias(f"c{axis}")
    return about.join(inside, key, "left").select(key, moved("x"), moved("y"))


def frame_window(pixels: DataFrame, pictures: DataFrame, mask: DataFrame, key: str, outer: int = 1000, inner: int = 500) -> tuple[DataFrame, DataFrame]:
    """The window of a video frame: the rings' centre is taken from the mask of the outer window about the frame's middle, and
    the inner window is cut about it. Returns the window's pixels and the centres (key, cx, cy) in the frame."""
    centres = found_centres(mask, middles(pictures, key), key, outer)
    return window(pixels, centres, key, inner), centres


def frame_mask(pixels: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """The pixels of a window with `mire` 0 where its mask has a label and 255 elsewhere."""
    marked = mask.filter("label > 0").select(key, "y", "x").distinct().withColumn("_m", F.lit(0))
    return pixels.join(marked, [key, "y", "x"], "left").withColumn("mire", F.coalesce("_m", F.lit(255))).drop("_m")


def zoom_offset(size: Column, zoom: int) -> Column:
    """Where a picture shrunk by the zoom begins in the frame of its own old size."""
    return F.floor((size - F.floor(size / zoom)) / 2)


def unzoomed(pixels: DataFrame, pictures: DataFrame, key: str, zoom: int, side: int | None = None) -> DataFrame:
    """Pictures shrunk by a digital zoom's factor and set in the middle of a black frame of their old size: bilinear between the
    two nearest rows and columns, rounded half up. The black frame has no rows. With `side` only the window of that side
    about the middle is made (in the frame's coordinates), and only the source pixels it needs are read on."""

    def along(df: DataFrame, axis: str, other: str, length: str) -> DataFrame:
        n = F.floor(F.col(length) / zoom)
        scale, offset = F.col(length) / n, zoom_offset(F.col(length), zoom)
        first, last = F.lit(0), n - 1
        if side is not None:
            middle = F.floor(F.col(length) / 2)
            first, last = F.greatest(first, middle - side // 2 - offset), F.least(last, middle + side // 2 - 1 - offset)
        low = F.greatest(first, F.ceil((F.col(axis) - 0.5) / scale - 0.5))
        high = F.least(last, F.floor((F.col(axis) + 1.5) / scale - 0.5))
        met = df.filter((n > 0) & (low <= high)).withColumn("_to", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        met = met.withColumn("_w", 1 - F.abs((F.col("_to") + 0.5) * scale - 0.5 - F.col(axis))).filter("_w > 0")
        made = met.groupBy(key, other, (F.col("_to") + offset).cast("int").alias(axis), "width", "height")
        return made.agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("v"))

    tasks = tasks_for(pixels)  # dealt by picture once, for the join and both aggregates
    rows = pixels.select(key, "y", "x", "v").repartition(tasks, key).join(pictures.select(key, "width", "height").repartition(tasks, key).hint("merge"), key)
    return along(along(rows, "x", "y", "width"), "y", "x", "height").select(key, "y", "x", F.floor(F.round("v", 9) + 0.5).alias("v"))


def photo_centres(pictures: DataFrame, key: str, zoom: int, outer: int, inner: int, marks: DataFrame, mask: DataFrame) -> DataFrame:
    """Centres (key, cx, cy) in the outer window of unzoomed photos: the marked one (fx, fy as fractions of the photo's sides)
    where a mark is given, else that of the mask of the inner window about the outer one's middle; null without either."""
    whole = middles(pictures, key).join(pictures.select(key, "width", "height"), key)
    outer_middle = lambda c, n: F.floor((F.least(c + outer // 2, n) - _corner(c, outer)) / 2).cast("int")
    about = whole.select(key, outer_middle(F.col("cx"), F.col("width")).alias("cx"), outer_middle(F.col("cy"), F.col("height")).alias("cy"))
    found = found_centres(mask, about, key, inner).select(key, F.col("cx").alias("_fx"), F.col("cy").alias("_fy"))
    put = lambda f, n, c: (F.floor(F.floor(F.col(f) * F.col(n)) / zoom) + zoom_offset(F.col(n), zoom) - _corner(F.col(c), outer)).cast("int")
    marked = whole.join(marks.select(key, "fx", "fy"), key, "left").select(key, put("fx", "width", "cx").alias("_mx"), put("fy", "height", "cy").alias("_my"))
    both = F.col("_mx").isNotNull() & F.col("_my").isNotNull()
    return marked.join(found, key, "left").select(key, F.when(both, F.col("_mx")).otherwise(F.col("_fx")).alias("cx"), F.when(both, F.col("_my")).otherwise(F.col("_fy")).alias("cy"))


def photo_windows(pixels: DataFrame, pictures: DataFrame, key: str, zoom: int = 2, outer: int = 1200) -> DataFrame:
    """The outer window of photos: unzoomed, then a square about the middle."""
    return window(unzoomed(pixels, pictures, key, zoom, outer), middles(pictures, key), key, outer)


def circle_centre(edges: DataFrame, key: str, least: int, most: int, jump: int, score: float) -> DataFrame:
    """Mean centre (cx, cy) and number (circles) of the best circles of edge points, one for each band of `jump` radii from
    least to most, those with at least `score` votes a pixel of radius. Pictures without one give no row."""
    best = circles(edges, key, least, most, 1, jump).filter(F.col("score") >= score)
    return best.groupBy(key).agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.count("*").alias("circles"))


def centred(centres: DataFrame, key: str, aim: tuple[Column, Column], cutoff: float, zoom: float = 1.0, norm: Column | float = 1.0) -> DataFrame:
    """Adds offset, the distance of the centre from the aim as a part of the tolerance cutoff * zoom / norm, and centred (offset
    <= 1). Null where there is no centre."""
    tolerance = F.lit(cutoff) * zoom / (norm if isinstance(norm, Column) else F.lit(norm))
    dx, dy = F.col("cx") - aim[0], F.col("cy") - aim[1]
    return centres.withColumn("offset", F.sqrt(dx * dx + dy * dy) / tolerance).withColumn("centred", F.col("offset") <= 1)
