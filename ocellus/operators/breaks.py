"""Break candidates of a frame: supports, peaks within the open arc, temporal validity.

Rows of a frame: key (video and frame in one column), mire_num, angle, x, y, signal, threshold. Peak finding walks a
ring in order of angle, so it is one numpy pass per ring; everything around it is joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import band_pairs
from .signal import reflect_mean, suppressed_peaks

MARGIN = 4.5


def _ring_peaks(df: DataFrame, key: str) -> DataFrame:
    """Peaks of at least the ring's threshold, with their angles."""
    ring = df.withColumn("ring", F.struct(key, "mire_num").cast(f"struct<k:{df.schema[key].dataType.simpleString()},m:int>")).withColumn("over", F.col("signal") - F.col("threshold"))
    named = ring.withColumn("ring", F.to_json("ring"))
    found = suppressed_peaks(named, "ring", "angle", "over", height=0.0)
    return named.join(found.select("ring", "angle"), ["ring", "angle"], "left_semi").drop("ring", "over")


def supports(df: DataFrame, key: str, outermost: int = 15, least: int = 3, reach: float = 5.0) -> DataFrame:
    """left and right support angle of each frame: the mean angle of those peaks near 180 and near 0 degrees, on odd
    rings up to the outermost, that more than `least` peaks (itself included) lie strictly within `reach` of; 180 and 0
    where there is none."""
    inner = df.filter((F.col("mire_num") <= outermost) & (F.col("mire_num") % 2 == 1))
    left = _ring_peaks(inner.filter("angle > 150 AND angle < 210"), key).withColumn("side", F.lit("left"))
    right = _ring_peaks(inner.filter("angle > 330 OR angle < 30"), key).withColumn("side", F.lit("right")).withColumn("angle", F.when(F.col("angle") > 330, F.col("angle") - 360).otherwise(F.col("angle")))
    peaks = left.unionByName(right).select(key, "mire_num", "angle", "side").withColumn("id", F.to_json(F.struct(key, "mire_num", "angle", "side")))
    near = band_pairs(peaks, peaks, [key], "angle", reach, F.abs(F.col("angle") - F.col("r_angle")) < reach).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    agreed = peaks.join(near, "id").groupBy(key).agg(F.avg(F.when(F.col("side") == "left", F.col("angle"))).alias("l"), F.avg(F.when(F.col("side") == "right", F.col("angle"))).alias("r"))
    return df.select(key).distinct().join(agreed, key, "left").select(key, F.coalesce("l", F.lit(180.0)).alias("left_support"), F.coalesce("r", F.lit(0.0)).alias("right_support"))


def _open(angle: Column) -> Column:
    wrapped = F.col("right_support") + MARGIN < 0
    below = angle < F.col("left_support") - MARGIN
    return F.when(wrapped, (angle > F.col("right_support") + 360 + MARGIN) | below).otherwise((angle > F.col("right_support") + MARGIN) & below)


def break_candidates(df: DataFrame, key: str, jump: float = 0.5, gap: float = 10.0, reach: float = 5.0) -> DataFrame:
    """Peaks between the supports. On odd rings from the outermost complete one on, a peak within `reach` degrees of a
    torn place (neighbours more than `gap` pixels apart) of its own ring or the next odd one drops out. Frames without a
    complete odd ring have none."""
    arc = df.join(supports(df, key), key).filter(_open(F.col("angle")))
    span = (F.col("left_support") - 2 * MARGIN - F.col("right_support")) / jump
    full = arc.groupBy(key, "mire_num").agg(F.count("*").alias("n"), F.first(F.floor(span)).alias("points")).filter((F.col("mire_num") % 2 == 1) & (F.col("n") > 0.99 * F.col("points")))
    outer = full.groupBy(key).agg(F.max("mire_num").alias("complete"))
    w = Window.partitionBy(key, "mire_num").orderBy("angle")
    far = lambda x, y: F.coalesce(F.hypot(F.col("x") - x, F.col("y") - y) > gap, F.lit(False))
    torn = arc.filter("mire_num % 2 = 1").withColumn("torn", far(F.lag("x").over(w), F.lag("y").over(w)) | far(F.lead("x").over(w), F.lead("y").over(w))).filter("torn").select(key, "mire_num", "angle")
    edges = torn.unionByName(torn.withColumn("mire_num", F.col("mire_num") - 2)).distinct()
    peaks = _ring_peaks(arc, key).join(outer, key).withColumn("id", F.to_json(F.struct(key, "mire_num", "angle")))
    judged = peaks.filter("mire_num % 2 = 1 AND mire_num >= complete")
    hit = band_pairs(judged.select("id", key, "mire_num", "angle"), edges, [key, "mire_num"], "angle", reach)
    return peaks.join(hit.select("id").distinct(), "id", "left_anti").select(key, "mire_num", "angle")


def temporal_signal(intensities: DataFrame, breaks: DataFrame, video: str, step: float = 0.5, fps: float = 30.0) -> DataFrame:
    """For each break the mean of three neighbouring angles of its ring in every frame of the video, with 0 and 360
    degrees next to each other; frames that lack one of the three are left out, as are, beyond ring 15, sums over 200."""
    a = F.col("angle")
    before, after = F.when(a == 0, 360.0).otherwise(a - step), F.when(a == 360, 0.0).otherwise(a + step)
    wanted = breaks.select("break_id", video, "mire_num", F.explode(F.array(*(F.round(x, 1) for x in (before, a, after)))).alias("angle"))
    got = wanted.join(intensities.withColumn("angle", F.round("angle", 1)), [video, "mire_num", "angle"])
    each = got.groupBy("break_id", "mire_num", "frame").agg(F.sum("intensity").alias("s"), F.count("*").alias("n")).filter("n = 3 AND NOT (mire_num > 15 AND s > 200)")
    return each.select("break_id", "frame", (F.col("frame") / fps).alias("time"), (F.col("s") / 3).alias("value"))


def temporally_valid(intensities: DataFrame, breaks: DataFrame, video: str, sharpness: float, blur: float = 53.0, fps: float = 30.0) -> DataFrame:
    """Breaks (break_id, video, mire_num, angle, frame) whose ring darkens within a second of them: a peak of the negated
    15-frame mean with the ring's prominence and bases at least 8 frames apart. Even rings pass."""
    smooth = reflect_mean(temporal_signal(intensities, breaks, video, fps=fps), "break_id", "frame", "value", 15).withColumn("dark", -F.col("smooth"))
    rings = breaks.select("break_id", "mire_num")
    bounds = [(F.col("mire_num") <= 7, 10.0), ((F.col("mire_num") > 7) & (F.col("mire_num") <= 15), 8.5), (F.col("mire_num") > 15, 7.0 if sharpness > blur else 8.0)]
    seen = None
    for of_ring, prominence in bounds:
        part = suppressed_peaks(smooth.join(rings.filter(of_ring), "break_id", "left_semi"), "break_id", "time", "dark", prominence=prominence, wlen=40, least_base=8)
        seen = part if seen is None else seen.unionByName(part)
    near = seen.join(breaks.select("break_id", (F.col("frame") / fps).alias("at")), "break_id").filter("abs(time - at) <= 1").select("break_id").distinct().withColumn("_near", F.lit(True))
    return breaks.join(near, "break_id", "left").filter((F.col("mire_num") % 2 == 0) | F.coalesce("_near", F.lit(False))).drop("_near")
