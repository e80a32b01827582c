"""Event operators: intervals over angle and time.

Counting the rows within an interval needs no pairs: rows meet in groups of the equal columns and a cell as wide as the
interval, the others also in the cells beside their own, and the groups are sorted and searched in numpy, many at a time
(interval_count).

Where a condition on both rows has to hold, a band join |x - y| <= r becomes an equality join on cells of width r: the
left row is put in its own cell and the two beside it, the right row in its own, and the band is verified in the join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import wrap_angle


def _before(groups: np.ndarray, values: np.ndarray, group: np.ndarray, at: np.ndarray, equal_too: bool) -> np.ndarray:
    """How many of the rows (sorted by group and value) come before each (group, at)."""
    query = np.r_[np.zeros(values.size, np.int8), np.ones(at.size, np.int8)]
    order = np.lexsort((query if equal_too else -query, np.r_[values, at], np.r_[groups, group]))
    out, mine = np.empty(at.size, np.int64), query[order] == 1
    out[order[mine] - values.size] = np.cumsum(~mine)[mine]
    return out


def _bounds(groups: np.ndarray, values: np.ndarray, group: np.ndarray, at: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the rows (sorted by group and value) from the first to behind the last of the group whose difference to `at`
    is in [low, high], by the differences themselves and not by rounded sums."""
    new = np.r_[True, (groups[1:] != groups[:-1]) | (values[1:] != values[:-1])] if values.size else np.zeros(0, bool)
    first = np.flatnonzero(new)
    each_group, each = groups[first], values[first]
    near = 1e-9 * (1 + np.abs(at) + abs(low) + abs(high))
    lo, hi = _before(each_group, each, group, at + low - near, False), _before(each_group, each, group, at + high + near, True)
    while (late := (lo < hi) & (each[np.minimum(lo, each.size - 1)] - at < low)).any() if each.size else False:
        lo += late
    while (early := (hi > lo) & (each[np.maximum(hi, 1) - 1] - at > high)).any() if each.size else False:
        hi -= early
    first = np.r_[first, values.size]
    return first[lo], first[hi]


def _distinct_within(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distinct codes in each window [lo, hi); both ends rise from window to window."""
    held, out, distinct, i, j = [0] * (int(codes.max()) + 1 if codes.size else 0), [], 0, 0, 0
    codes = codes.tolist()
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        while j < b:
            held[codes[j]] += 1
            distinct += held[codes[j]] == 1
            j += 1
        while i < a:
            held[codes[i]] -= 1
            distinct -= held[codes[i]] == 0
            i += 1
        out.append(distinct)
    return np.array(out, np.int64)


def interval_count(left: DataFrame, right: DataFrame, key: str, equal: Sequence[str], x: str, low: float, high: float, distinct: str | None = None) -> DataFrame:
    """(key, n) of every left row: how many right rows, or distinct values of one of their columns, are equal in `equal` and
    at x + low to x + high, both included. Rows with a null in these columns count for nothing and get none."""
    width = max(abs(low), abs(high))
    cell = F.floor(F.col(x).cast("double") / width)
    kinds = {"key": left.schema[key].dataType, **{c: left.schema[c].dataType for c in equal}}
    value = F.lit(0).cast("long") if distinct is None else F.col(distinct)
    known = lambda df, *more: df.filter(F.array_contains(F.array(*(F.col(c).isNull() for c in (*equal, x, *more))), True) == F.lit(False))
    b = known(right, *([distinct] if distinct else [])).select(*equal, F.col(x).cast("double").alias("_x"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), value.alias("_v"), F.lit(False).alias("_own"))
    b = b.withColumn("_key", F.lit(None).cast(kinds["key"]))
    a = known(left).select(*equal, F.col(x).cast("double").alias("_x"), cell.alias("_cell"), F.lit(None).cast(b.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_own"), F.col(key).alias("_key"))

    def counted(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        own, at = table["_own"].to_numpy(), table["_x"].to_numpy()
        mine, others = (np.flatnonzero(side) for side in (own, ~own))
        mine, others = (rows[np.lexsort((at[rows], group[rows]))] for rows in (mine, others))
        lo, hi = _bounds(group[others], at[others], group[mine], at[mine], low, high)
        n = hi - lo if distinct is None else _distinct_within(pd.factorize(table["_v"].take(others).to_pandas())[0], lo, hi)
        return pa.RecordBatch.from_arrays([table["_key"].take(mine).combine_chunks(), pa.array(n, pa.int64())], names=[key, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:  # whole groups only; the last one waits for the next batch
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            named = np.stack([pd.factorize(table[c].to_pandas())[0] for c in (*equal, "_cell")])
            group = np.r_[0, np.cumsum((named[:, 1:] != named[:, :-1]).any(0))]
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield counted(table.slice(0, cut), group[:cut])
            left = table.slice(cut)
        if left is not None and left.num_rows:
            yield counted(left, np.zeros(left.num_rows, np.int64))

    both = a.unionByName(b.select(*a.columns)).repartition(*equal, "_cell").sortWithinPartitions(*equal, "_cell")
    return both.mapInArrow(run, f"`{key}` {kinds['key'].simpleString()}, n long")


def _cells(x: Column, width: float) -> Column:
    c = F.floor(x / width)
    return F.explode(F.array(c - 1, c, c + 1))


def band_pairs(left: DataFrame, right: DataFrame, equal: Sequence[str], x: str, reach: float, condition: Column | None = None, also: tuple[str, float] | None = None) -> DataFrame:
    """Left rows (all columns, as they are) with right rows (columns prefixed r_) within `reach` in x and equal in `equal`;
    `also` is a second column and its reach."""
    a = left.withColumn("_cell", _cells(F.col(x), reach))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("r__cell", F.floor(F.col(f"r_{x}") / reach))
    on = (F.col("_cell") == F.col("r__cell")) & (F.abs(F.col(x) - F.col(f"r_{x}")) <= reach)
    if also is not None:
        y, far = also
        a, b = a.withColumn("_cell2", _cells(F.col(y), far)), b.withColumn("r__cell2", F.floor(F.col(f"r_{y}") / far))
        on &= (F.col("_cell2") == F.col("r__cell2")) & (F.abs(F.col(y) - F.col(f"r_{y}")) <= far)
    for c in equal:
        on &= F.col(c) == F.col(f"r_{c}")
    if condition is not None:
        on &= condition
    return a.join(b, on).drop("_cell", "r__cell", "_cell2", "r__cell2")


def near_rows(left: DataFrame, right: DataFrame, key: str, equal: Sequence[str], x: str, reach: float, least: float = 0.0, unlike: str | None = None) -> DataFrame:
    """Keys of the left rows that have another right row within `reach` (and at least `least`) in x, equal in `equal`; with
    `unlike` only rows that differ in that column count. Rows are their own others if `right` holds them and least is 0."""
    sides = [(least, reach), (-reach, -least)] if least > 0 else [(-reach, reach)]
    total = None
    for low, high in sides:
        every = interval_count(left, right, key, equal, x, low, high)
        if unlike is not None:
            every = every.unionByName(interval_count(left, right, key, [*equal, unlike], x, low, high).withColumn("n", -F.col("n")))
        total = every if total is None else total.unionByName(every)
    return total.groupBy(key).agg(F.sum("n").alias("n")).filter("n > 0").select(key)


def without_neighbours(df: DataFrame, key: str, equal: Sequence[str], x: str, reach: float, least: float = 0.0, unlike: str | None = None, guard: Column | None = None) -> DataFrame:
    """Rows without another row within `reach` (and at least `least`) in x; rows outside the guard always stay.

    With `unlike` a neighbour must differ in that column; without it, least must be above 0, so that no row is its own
    neighbour. Comparison is with the input as given."""
    if unlike is None and least <= 0:
        raise ValueError("give a least distance or a column in which neighbours differ")
    judged = df if guard is None else df.filter(guard)
    return df.join(near_rows(judged, df, key, equal, x, reach, least, unlike), key, "left_anti")


def neighbour_count(df: DataFrame, key: str, equal: Sequence[str], x: str, reach: float, distinct: str) -> DataFrame:
    """Distinct values of a column among the rows within `reach` in x, the row itself included."""
    return interval_count(df, df, key, equal, x, -reach, reach, distinct).withColumnRenamed("n", "n_near")


def forward_count(df: DataFrame, key: str, equal: Sequence[str], time: str, span: float, distinct: str, near: tuple[str, float] | None = None, closed: bool = True) -> DataFrame:
    """Distinct values among rows at times from this row's to `span` later; with `near` only of rows that are also within a
    reach in that column."""
    if near is None and closed:
        return interval_count(df, df, key, equal, time, 0.0, span, distinct).withColumnRenamed("n", "n_ahead")
    ahead = F.col(f"r_{time}") - F.col(time)
    inside = (ahead >= 0) & ((ahead <= span) if closed else (ahead < span))
    return band_pairs(df, df, equal, time, span, inside, near).groupBy(key).agg(F.countDistinct(f"r_{distinct}").alias("n_ahead"))


def first_dense(df: DataFrame, key: str, equal: Sequence[str], time: str, span: float, distinct: str, least: int, near: tuple[str, float] | None = None, closed: bool = True) -> DataFrame:
    """Per `equal`: the first row in time that has at least `least` distinct values within `span` ahead."""
    dense = df.join(forward_count(df, key, equal, time, span, distinct, near, closed).filter(F.col("n_ahead") >= least), key)
    return dense.groupBy(*equal).agg(F.min_by(F.struct(key, time, "n_ahead"), F.struct(time, key)).alias("r")).select(*equal, "r.*")


def filter_breaks(breaks: DataFrame, sampling: float, video: str = "video_id", frames_factor: float = 5.0) -> DataFrame:
    """Tear-film break candidates that pass all rules; columns video, mire_num, angle, frame, time.

    Angles over 270 count from the other side and even rings drop out. Every rule compares with the unfiltered
    rows: persistence (the same ring within 5 degrees in more than frames_factor * sampling frames, for outer rings
    or flat angles), a detection two rings away within 6 degrees at the same time, one of the same ring 2 to 20
    degrees away, one of the next ring within 2 degrees, and fixed lash regions.
    """
    rows = breaks.dropDuplicates().withColumn("angle", wrap_angle(F.col("angle"))).withColumn("id", F.to_json(F.struct(video, "mire_num", "angle", "frame", "time")))
    m, a = F.col("mire_num"), F.col("angle")
    persistent = neighbour_count(rows, "id", [video, "mire_num"], "angle", 5.0, "frame").filter(F.col("n_near") > frames_factor * sampling)
    out = rows.filter(m % 2 == 1)
    out = out.join(persistent.select("id", F.lit(True).alias("_p")), "id", "left").filter(~(F.coalesce("_p", F.lit(False)) & ((m >= 13) | (a >= 150) | (a <= 30)))).drop("_p")
    beside = lambda by: rows.withColumn("mire_num", F.explode(F.array(m - by, m + by)))
    same_ring = [video, "time", "mire_num"]
    for judged, others, reach, least in (
        (rows.filter((m >= 15) | (a < 20) | (a > 160)), beside(2), 6.0, 0.0),
        (rows.filter(m >= 13), rows, 20.0, 2.0),
        (rows, beside(1), 2.0, 0.0),
    ):
        out = out.join(near_rows(judged, others, "id", same_ring, "angle", reach, least), "id", "left_anti")
    lashes = ((m >= 19) & a.between(60, 120)) | ((m >= 15) & (a >= 60) & (a < 119)) | ((m == 11) & (F.abs(a - 105) <= 6)) | ((m == 13) & (F.abs(a - 106) <= 6))
    return out.filter(~lashes).drop("id")


def break_up_time(breaks: DataFrame, blink: DataFrame, sharp: bool, video: str = "video_id", least: int = 8, span: float = 1.0) -> DataFrame:
    """Per video: first break of a ring that is seen in `least` frames within `span` seconds and 5 degrees, and the
    time from the last blink to it (null if there is none)."""
    rows = breaks.dropDuplicates([video, "mire_num", "angle", "frame", "time"]).withColumn("id", F.to_json(F.struct(video, "mire_num", "angle", "frame", "time")))
    dense = first_dense(rows, "id", [video, "mire_num"], "time", span, "frame", least, ("angle", 5.0), sharp)
    first = dense.groupBy(video).agg(F.min("time").alias("tear_break"))
    return blink.groupBy(video).agg(F.max("time").alias("blink")).join(first, video, "left").withColumn("nibut", F.col("tear_break") - F.col("blink"))


def consecutive(df: DataFrame, series: str, order: str, good: Column, out: str = "streak") -> DataFrame:
    """Number of consecutive good rows up to and including each row; resets at a bad one."""
    w = Window.partitionBy(series).orderBy(order)
    base = df.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_g", F.sum((~F.col("_good")).cast("long")).over(w))
    return base.withColumn(out, F.sum(F.col("_good").cast("long")).over(Window.partitionBy(series, "_g").orderBy(order))).drop("_good", "_g")
