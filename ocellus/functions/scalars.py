"""Column functions: decisions, intervals, geometry, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """top / bottom as double; `otherwise` where bottom is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(otherwise).cast("double"))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds within [0, 1]; null if n is not positive."""
    p = hits.cast("double") / n
    scale = 1 + z * z / n
    centre, reach = (p + z * z / (2 * n)) / scale, z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - reach)), F.when(n > 0, F.least(F.lit(1.0), centre + reach))


def safe_name(name: Column) -> Column:
    """True for a plain file name: no separator or drive colon, not empty, '.' or '..'."""
    return ~name.rlike(r"[/\\:]") & ~name.isin("", ".", "..")


def decision(score: Column, threshold: float) -> Column:
    """1 at or above the threshold, else 0; raises outside [0, 1]."""
    return F.when((score < 0) | (score > 1), F.raise_error(F.lit("score outside [0, 1]")).cast("int")).otherwise((score >= threshold).cast("int"))


def bands(score: Column, cuts: Sequence[tuple[float, str]], top: str) -> Column:
    """The name of the first band whose upper cut is above the score."""
    out = None
    for cut, name in cuts:
        out = F.when(score < cut, name) if out is None else out.when(score < cut, name)
    return out.otherwise(top)


def abstain(first: Column, second: Column, threshold: float) -> Column:
    """'inconclusive' where two scores fall on different sides of the threshold, else the first one's decision."""
    a, b = first >= threshold, second >= threshold
    return F.when(a != b, "inconclusive").when(a, "suspected").otherwise("not_suspected")


def angle_zone(angle: Column, first: tuple[float, float], second: tuple[float, float]) -> Column:
    """Zone of an angle in [0, 360] given two skipped arcs, from one bound to the other counter-clockwise: 1 within the
    first, 2 between first and second, 3 within the second, 4 between second and first. Without arcs (all -1): 2."""
    if (*first, *second) == (-1, -1, -1, -1):
        return F.lit(2)

    def arc(lo: float, hi: float, closed: bool) -> Column:
        above, below = (angle >= lo, angle <= hi) if closed else (angle > lo, angle < hi)
        return (above | below) if lo > hi else (above & below)

    zones = [(arc(*first, True), 1), (arc(first[1], second[0], False), 2), (arc(*second, True), 3), (arc(second[1], first[0], False), 4)]
    out = F.when(*zones[0])
    for hit, zone in zones[1:]:
        out = out.when(hit, zone)
    return out


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's scheme, highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wrap_angle(angle: Column, above: float = 270.0) -> Column:
    """Angles beyond `above` counted from the other side."""
    return F.when(angle > above, angle - 360).otherwise(angle)


def number_distance(first: Column, second: Column) -> Column:
    """Distance of two numeric names, null if either isn't a number."""
    return F.abs(first.try_cast("bigint") - second.try_cast("bigint"))


def map_box(box: Column, left: Column, top: Column, right: Column, bottom: Column, side: int) -> Column:
    """A box in the crop scaled to side x side, cut at its edges and rounded to 3 decimals, with a flag whether it was
    cut; raises if nothing of it is left."""
    bound = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(side)), v))
    at = lambda v, lo, hi: (v - lo) * side / (hi - lo)
    raw = [at(box["x"], left, right), at(box["y"], top, bottom), at(box["x"] + box["width"], left, right), at(box["y"] + box["height"], top, bottom)]
    x1, y1, x2, y2 = map(bound, raw)
    cut = F.greatest(*(F.abs(bound(v) - v) for v in raw)) > 1e-6
    out = F.struct(F.round(x1, 3).alias("x"), F.round(y1, 3).alias("y"), F.round(x2 - x1, 3).alias("width"), F.round(y2 - y1, 3).alias("height"), cut.alias("cut"))
    return F.when((x2 > x1) & (y2 > y1), out).otherwise(F.raise_error(F.lit("the crop removes a whole box")).cast("struct<x:double,y:double,width:double,height:double,cut:boolean>"))


def offset_mm(distance: Column, radius: Column, across: float = 30.0) -> Column:
    """An offset in pixels in millimetres, by a circle of known diameter and its radius in pixels."""
    return distance * across / (2 * radius + 1e-6)


def json_number(x: Column) -> Column:
    """NaN and infinite numbers as null, which JSON can hold."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def scaled_gap(radius: Column, slope: float, intercept: float, base_focal: float, focal: Column, base_width: float, base_sensor: float, width: Column, sensor: Column) -> Column:
    """Working gap from a ring's radius in pixels of another camera: the radius is taken to the calibrated camera's pixels
    (at twice its resolution) and the calibration slope / radius + intercept applied; two decimals."""
    there = radius / width * sensor * (base_focal / focal) * (base_width / base_sensor) * 2
    return F.round(slope / there + intercept, 2)


def evaluation_name(name: Column, prefix: str) -> Column:
    """Name of a map for evaluation: prefix, the file's first part, the eye, the kind of map; null for other files."""
    eye, kind = F.when(name.contains("left"), "OS").otherwise("OD"), F.when(name.contains("tan"), "curv").otherwise("axial")
    return F.when(name.contains("axial") | name.contains("tan"), F.concat(F.concat_ws("_", F.lit(prefix), F.element_at(F.split(name, "_"), 1), eye, kind), F.lit(".png")))
