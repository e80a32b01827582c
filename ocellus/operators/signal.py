"""Signal operators over (series, time) tables: mirrored means, peaks, medians, runs, drops.

Every window is partitioned by series. Mirrored edges and circular extensions are extra rows made from the series'
own ends, so the windows are plain row frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, series: str, order: str) -> DataFrame:
    """Position i (from 0) of each row in its series, and the series' length n."""
    w = Window.partitionBy(series)
    return df.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))


def _extended(df: DataFrame, series: str, value: str, pad: int, circular: bool) -> DataFrame:
    """Adds rows at positions -pad..-1 and n..n+pad-1: mirrored without the edge sample, or from the other end."""
    i, n = F.col("i"), F.col("n")
    if circular:
        left, right = i - n, i + n
        use_left, use_right = i >= n - pad, i < pad
    else:
        left, right = -i, 2 * (n - 1) - i
        use_left, use_right = (i >= 1) & (i <= pad), (i <= n - 2) & (i >= n - 1 - pad)
    at = F.array_compact(F.array(i, F.when(use_left, left), F.when(use_right, right)))
    return df.select(series, F.col(value).alias("v"), "n", F.explode(at).alias("i"))


def reflect_mean(df: DataFrame, series: str, order: str, value: str, size: int, out: str = "smooth") -> DataFrame:
    """Centred mean of `size` samples with mirrored edges. Series of at most size // 2 samples lack full frames."""
    half = size // 2
    base = numbered(df, series, order)
    w = Window.partitionBy(series).orderBy("i").rowsBetween(-half, half)
    smooth = _extended(base, series, value, half, False).withColumn(out, F.avg("v").over(w)).filter("i >= 0 AND i < n").select(series, "i", out)
    return base.join(smooth, [series, "i"])


def zero_padded_mean(df: DataFrame, series: str, value: str, size: int, out: str) -> DataFrame:
    """Sum of the `size` centred samples divided by size; what lies beyond the ends counts as 0. Needs column i."""
    w = Window.partitionBy(series).orderBy("i").rowsBetween(-(size // 2), size // 2)
    return df.withColumn(out, F.sum(value).over(w) / size)


def z_score(df: DataFrame, series: str, value: str, out: str = "z") -> DataFrame:
    w = Window.partitionBy(series)
    spread = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(spread > 0, (F.col(value) - F.avg(value).over(w)) / spread))


def central_difference(df: DataFrame, series: str, order: str, value: str, lag: int = 2, out: str = "gradient") -> DataFrame:
    """value - value `lag` rows before, stamped with the later row."""
    return df.withColumn(out, F.col(value) - F.lag(value, lag).over(Window.partitionBy(series).orderBy(order)))


def local_peaks(df: DataFrame, series: str, order: str, value: str, height: float) -> DataFrame:
    """Rows of at least the height that exceed both neighbours."""
    w = Window.partitionBy(series).orderBy(order)
    return df.withColumn("_b", F.lag(value).over(w)).withColumn("_a", F.lead(value).over(w)).filter((F.col(value) >= height) & (F.col(value) > F.col("_b")) & (F.col(value) > F.col("_a"))).drop("_a", "_b")


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None, wlen: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of peaks, and the left and right bases of their prominences. Flat tops count at their middle; closer
    than `distance`, the higher peak stays."""
    x = np.asarray(x, float)
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.r_[0, edge + 1], np.r_[edge, x.size - 1]
    tops = [k for k in range(1, starts.size - 1) if x[starts[k - 1]] < x[starts[k]] > x[starts[k + 1]]]
    peaks = np.array([(starts[k] + ends[k]) // 2 for k in tops], int)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and peaks.size:
        keep = np.ones(peaks.size, bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                keep &= (np.abs(peaks - peaks[k]) >= distance) | (np.arange(peaks.size) == k)
        peaks = peaks[keep]
    left, right, drop = np.zeros(peaks.size, int), np.zeros(peaks.size, int), np.zeros(peaks.size)
    reach = x.size if wlen is None else wlen // 2
    for k, p in enumerate(peaks):
        lo, hi = max(0, p - reach), min(x.size - 1, p + reach)
        higher = np.flatnonzero(x[lo:p] > x[p])
        lo = lo + higher[-1] + 1 if higher.size else lo
        higher = np.flatnonzero(x[p + 1 : hi + 1] > x[p])
        hi = p + higher[0] if higher.size else hi
        left[k] = lo + np.flatnonzero(x[lo : p + 1] == x[lo : p + 1].min())[-1]
        right[k] = p + int(np.argmin(x[p : hi + 1]))
        drop[k] = x[p] - max(x[left[k]], x[right[k]])
    if prominence is not None:
        ok = drop >= prominence
        peaks, left, right = peaks[ok], left[ok], right[ok]
    return peaks, left, right


def suppressed_peaks(df: DataFrame, series: str, order: str, value: str, height: float | None = None, distance: int = 1, prominence: float | None = None, wlen: int | None = None, least_base: int = 0) -> DataFrame:
    """Peaks where the choice depends on order (distance, prominence, base width): one numpy pass per series."""
    schema = f"`{series}` {df.schema[series].dataType.simpleString()}, `{order}` {df.schema[order].dataType.simpleString()}, peak double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(order)
        p, lo, hi = find_peaks(pdf[value].to_numpy(), height, distance, prominence, wlen)
        return pdf.iloc[p[hi - lo >= least_base]].rename(columns={value: "peak"})[[series, order, "peak"]].astype({"peak": float})

    return df.select(series, order, value).groupBy(series).applyInPandas(run, schema)


def blinks(df: DataFrame, series: str, frame: str, value: str, fps: float, height: float = 0.5, distance: int = 5) -> DataFrame:
    """Blink times of a frame-deviation signal: 5-sample mirrored mean, z-score, difference over two, peaks."""
    smooth = z_score(reflect_mean(df, series, frame, value, 5), series, "smooth")
    graded = central_difference(smooth, series, "i", "z").filter("gradient IS NOT NULL")
    return suppressed_peaks(graded, series, frame, "gradient", height, distance).select(series, frame, ((F.col(frame) + 1) / fps).alias("time"))


def background_difference(df: DataFrame, series: str, order: str, value: str, wide: int = 51, narrow: int = 5) -> DataFrame:
    """Wide mirrored mean minus narrow zero-padded mean."""
    both = zero_padded_mean(reflect_mean(df, series, order, value, wide, "background"), series, value, narrow, "local")
    return both.withColumn("signal", F.col("background") - F.col("local"))


def _zero_padded(df: DataFrame, series: str, value: str, pad: int) -> DataFrame:
    """Adds rows of value 0 at positions -pad..-1 and n..n+pad-1; nulls count as 0."""
    i, n = F.col("i"), F.col("n")
    none = F.array().cast("array<int>")
    before = F.when(i == 0, F.sequence(F.lit(-pad), F.lit(-1))).otherwise(none)
    after = F.when(i == n - 1, F.transform(F.sequence(F.lit(0), F.lit(pad - 1)), lambda k: (k + n).cast("int"))).otherwise(none)
    out = df.select(series, "i", F.coalesce(F.col(value), F.lit(0.0)).alias("v"), "n", F.explode(F.concat(F.array(i.cast("int")), before, after)).alias("at"))
    return out.select(series, F.when(F.col("at") == F.col("i"), F.col("v")).otherwise(0.0).alias("v"), "n", F.col("at").alias("i"))


def dual_median(df: DataFrame, series: str, order: str, value: str, small: int = 25, large: int = 51, cut: float = 0.05, zero_padded: bool = False) -> DataFrame:
    """Circular medians of two widths, nulls left out; where they differ by more than the cut the wider one holds.
    With zero_padded, nulls and what lies beyond the ends count as 0 instead."""
    base = numbered(df, series, order)
    w = Window.partitionBy(series).orderBy("i")
    wide = _zero_padded(base, series, value, large // 2) if zero_padded else _extended(base, series, value, large // 2, True)
    med = lambda k: F.percentile("v", F.lit(0.5)).over(w.rowsBetween(-(k // 2), k // 2))
    found = wide.withColumn("m1", med(small)).withColumn("m2", med(large)).filter("i >= 0 AND i < n")
    out = F.when(F.abs(F.col("m1") - F.col("m2")) / (F.col("m2") + 1e-9) > cut, F.col("m2")).otherwise(F.col("m1"))
    return base.join(found.select(series, "i", out.alias("median")), [series, "i"])


def runs(df: DataFrame, series: str, order: str, flag: Column, least: int = 1, closed_only: bool = False) -> DataFrame:
    """Maximal runs of consecutive flagged rows: first, last, length. With closed_only a run that lasts to the end is left out."""
    w = Window.partitionBy(series).orderBy(order)
    on = F.coalesce(flag, F.lit(False))
    step = df.withColumn("_on", on).withColumn("_row", F.row_number().over(w)).withColumn("_g", F.col("_row") - F.sum(F.col("_on").cast("long")).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(series)))
    found = step.filter("_on").groupBy(series, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), (F.max("_row") == F.max("_n")).alias("_open"))
    found = found.filter((F.col("length") >= least) & (~F.col("_open") if closed_only else F.lit(True)))
    return found.select(series, "first", "last", "length")


def sustained_drop(df: DataFrame, series: str, order: str, value: str, skip: int = 2, baseline: int = 5, part: float = 0.78, length: int = 3) -> DataFrame:
    """After the largest step of the series: mean of `baseline` samples from `skip` after it, and the first of `length`
    consecutive samples below part of that mean; null drop_at if there is none. At least 3 baseline samples are needed."""
    w = Window.partitionBy(series).orderBy("i")
    base = numbered(df, series, order).withColumn("step", F.abs(F.col(value) - F.lag(value).over(w)))
    jump = base.filter("step IS NOT NULL").groupBy(series).agg(F.min_by("i", F.struct(-F.col("step"), F.col("i"))).alias("jump"))
    after = base.join(jump, series).filter(F.col("i") >= F.col("jump") + skip)
    level = after.filter(F.col("i") < F.col("jump") + skip + baseline).groupBy(series).agg(F.avg(value).alias("level"), F.count(value).alias("samples")).filter("samples >= 3")
    low = runs(after.join(level, series), series, "i", F.col(value) < part * F.col("level"), length)
    first = low.groupBy(series).agg(F.min("first").alias("i")).join(base.select(series, "i", F.col(order).alias("drop_at")), [series, "i"]).select(series, "drop_at")
    return jump.join(level, series, "left").join(first, series, "left").select(series, F.col("jump").cast("long"), "level", "drop_at")


def local_fill(df: DataFrame, series: str, order: str, value: str, before: int = 10, after: int = 9, out: str = "filled") -> DataFrame:
    """A missing value becomes the mean of the rows from `before` ahead to `after` behind, else of the series."""
    w = Window.partitionBy(series)
    near = F.avg(value).over(w.orderBy(order).rowsBetween(-before, after))
    return df.withColumn(out, F.coalesce(value, near, F.avg(value).over(w)))


def gap_outliers(df: DataFrame, series: str, order: str, value: str, first: int = 5, spread: float = 10.0) -> DataFrame:
    """Gap of each row to the one before, and whether it exceeds mean + spread * deviation of all earlier gaps of the
    series, from the gap number `first` (counted from 0) on."""
    w = Window.partitionBy(series).orderBy(order)
    gaps = df.withColumn("gap", F.col(value) - F.lag(value).over(w)).filter("gap IS NOT NULL").withColumn("k", F.row_number().over(w) - 1)
    inner = w.rowsBetween(Window.unboundedPreceding, -1)
    mean, dev = F.avg("gap").over(inner), F.stddev_pop("gap").over(inner)
    return gaps.withColumn("inner_mean", mean).withColumn("outlier", F.coalesce((F.col("k") >= first) & (F.col("gap") > mean + spread * dev), F.lit(False)))


def repaired(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Outliers of gap_outliers replaced: a chain of them grows from the last sound value by the running sum of means."""
    w = Window.partitionBy(series).orderBy(order)
    base = df.withColumn("_s", F.sum(F.when(~F.col("outlier"), 1).otherwise(0)).over(w))
    run = Window.partitionBy(series, "_s").orderBy(order)
    start = F.first(F.when(~F.col("outlier"), F.col(value)), True).over(run)
    return base.withColumn("repaired", F.when(F.col("outlier"), start + F.sum(F.when(F.col("outlier"), F.col("inner_mean")).otherwise(0.0)).over(run)).otherwise(F.col(value))).drop("_s")


def blurred_edge_peaks(df: DataFrame, series: str, order: str, x: str, y: str, jump: float = 10.0) -> DataFrame:
    """Both rows of neighbours that lie further apart than `jump`."""
    w = Window.partitionBy(series).orderBy(order)
    back = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) > jump
    ahead = F.hypot(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)) > jump
    return df.withColumn("edge", F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))).filter("edge").drop("edge")


def sampled_frames(df: DataFrame, frame: str, rate: int, after: int = 0, until: int | None = None) -> DataFrame:
    """Every rate-th frame (frames count from 0, so frame n is the (n + 1)-th) beyond `after` and up to `until`."""
    nth = F.col(frame) + 1
    return df.filter((nth % rate == 0) & (nth > after) & (nth <= until if until is not None else F.lit(True)))


def gap_curve(df: DataFrame, series: str, order: str, value: str, first: int, last: int, margin: int = 10, period: int = 360, degree: int = 2) -> DataFrame:
    """A circular series (places 0 to period - 1) with the values from `first` to `last` replaced by the polynomial through the known
    ones up to `margin` places beside them; 0 and null count as not known. Series with too few known values stay as they are.
    One small least-squares fit per series; only the places near the gap are read for it."""
    length = (last - first) % period
    place = F.pmod(F.col(order) - (first - margin), F.lit(period))
    inside = (place >= margin) & (place <= margin + length)
    near = df.withColumn("_p", place).filter((F.col("_p") <= length + 2 * margin) & ~inside & (F.coalesce(F.col(value), F.lit(0.0)) != 0)).select(series, "_p", value)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) <= degree:
            return pd.DataFrame({series: [], "_c": []})
        return pd.DataFrame({series: [pdf[series].iloc[0]], "_c": [np.polyfit(pdf["_p"].to_numpy(float), pdf[value].to_numpy(float), degree).tolist()]})

    curves = near.groupBy(series).applyInPandas(fit, f"`{series}` {df.schema[series].dataType.simpleString()}, _c array<double>")
    at = F.aggregate("_c", F.lit(0.0), lambda acc, c: acc * place + c)
    return df.join(curves, series, "left").withColumn(value, F.when(inside & F.col("_c").isNotNull(), at).otherwise(F.col(value))).drop("_c")


def zoned_median(df: DataFrame, series: str, order: str, value: str, size: int = 11, cut: float = 270.0) -> DataFrame:
    """Zero-padded median of a partial circle read from beyond the cut on, if the series reaches both its start and beyond the cut."""
    w = Window.partitionBy(series)
    wraps = (F.min(F.when(F.col(order) <= cut, F.col(order))).over(w) == 0) & (F.max(order).over(w) > cut)
    turned = df.withColumn("_at", F.when(wraps & (F.col(order) > cut), F.col(order) - 360).otherwise(F.col(order)))
    base = numbered(turned, series, "_at")
    med = F.percentile("v", F.lit(0.5)).over(Window.partitionBy(series).orderBy("i").rowsBetween(-(size // 2), size // 2))
    found = _zero_padded(base, series, value, size // 2).withColumn("median", med).filter("i >= 0 AND i < n").select(series, "i", "median")
    return base.join(found, [series, "i"]).drop("_at", "i", "n")
