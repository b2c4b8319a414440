"""Bounding boxes: struct(left, bottom, right, top: double, crs: string)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import affine as A
from .scalar import Num, col, quasi_random_r2

SIDES = ("left", "bottom", "right", "top")


def bbox(left: Num, bottom: Num, right: Num, top: Num, crs: Column | str | None = None) -> Column:
    name = crs if isinstance(crs, Column) else F.lit(crs).cast("string")
    return F.struct(*(col(v).cast("double").alias(n) for n, v in zip(SIDES, (left, bottom, right, top))), name.alias("crs"))


def same_crs(a: Column, b: Column) -> Column:
    """The common CRS, or an error."""
    return F.when(a["crs"].eqNullSafe(b["crs"]), a["crs"]).otherwise(F.raise_error(F.lit("boxes are in different reference systems")).cast("string"))


def intersection(a: Column, b: Column) -> Column:
    """Of disjoint boxes it is inverted; see ``is_empty``."""
    return bbox(F.greatest(a["left"], b["left"]), F.greatest(a["bottom"], b["bottom"]), F.least(a["right"], b["right"]), F.least(a["top"], b["top"]), same_crs(a, b))


def union(a: Column, b: Column) -> Column:
    return bbox(F.least(a["left"], b["left"]), F.least(a["bottom"], b["bottom"]), F.greatest(a["right"], b["right"]), F.greatest(a["top"], b["top"]), same_crs(a, b))


def is_empty(b: Column) -> Column:
    return (b["left"] > b["right"]) | (b["bottom"] > b["top"])


def overlaps(a: Column, b: Column) -> Column:
    """Share a point; touching counts."""
    return (a["left"] <= b["right"]) & (b["left"] <= a["right"]) & (a["bottom"] <= b["top"]) & (b["bottom"] <= a["top"])


def interiors_meet(a: Column, b: Column) -> Column:
    return (a["left"] < b["right"]) & (b["left"] < a["right"]) & (a["bottom"] < b["top"]) & (b["bottom"] < a["top"])


def touches(a: Column, b: Column) -> Column:
    return overlaps(a, b) & ~interiors_meet(a, b)


def covers(a: Column, b: Column) -> Column:
    return (a["left"] <= b["left"]) & (a["right"] >= b["right"]) & (a["bottom"] <= b["bottom"]) & (a["top"] >= b["top"])


def relation(a: Column, b: Column) -> Column:
    """disjoint, touches, equals, within, contains or overlaps, of two boxes that have an area."""
    by_sides = F.when(~interiors_meet(a, b), "touches").when(covers(a, b) & covers(b, a), "equals").when(covers(a, b), "contains").when(covers(b, a), "within").otherwise("overlaps")
    return F.when(~F.coalesce(overlaps(a, b), F.lit(False)), "disjoint").otherwise(by_sides)


def buffered(b: Column, x: Num, y: Num | None = None) -> Column:
    x = col(x)
    y = x if y is None else col(y)
    return bbox(b["left"] - x, b["bottom"] - y, b["right"] + x, b["top"] + y, b["crs"])


def span_x(b: Column) -> Column:
    return b["right"] - b["left"]


def span_y(b: Column) -> Column:
    return b["top"] - b["bottom"]


def aspect(b: Column) -> Column:
    return F.try_divide(span_x(b), span_y(b))


def width(b: Column) -> Column:
    return span_x(b).cast("int")


def height(b: Column) -> Column:
    return span_y(b).cast("int")


def points(b: Column) -> Column:
    """Four corners, x first."""
    at = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(at("left", "bottom"), at("left", "top"), at("right", "bottom"), at("right", "top"))


def from_xy(x0: Column, x1: Column, y0: Column, y1: Column, crs: Column | str | None = None) -> Column:
    return bbox(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1), crs)


from_points = from_xy


def transform(b: Column, m: Column) -> Column:
    """Box of the four mapped corners."""
    xs, ys = zip(*(A.apply(m, b[x], b[y]) for x in ("left", "right") for y in ("bottom", "top")))
    return bbox(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys), b["crs"])


def from_transform(ny: Column, nx: Column, m: Column, crs: Column | str | None = None) -> Column:
    """From two opposite pixel corners only; not the envelope of a rotated grid."""
    x1, y1 = A.apply(m, nx, ny)
    return from_xy(m["c"], x1, m["f"], y1, crs)


def round_out(b: Column) -> Column:
    return bbox(F.floor(b["left"]), F.floor(b["bottom"]), F.ceil(b["right"]), F.ceil(b["top"]), b["crs"])


def boundary(b: Column, per_side: int = 2) -> Column:
    """Closed ring of points, ``per_side`` on each side, through single precision."""
    n = per_side - 1
    at = lambda lo, hi, i: (lo + (hi - lo) * (i / F.lit(float(n)))).cast("float").cast("double")
    p = lambda x, y: F.struct(x.cast("float").cast("double").alias("x"), y.cast("float").cast("double").alias("y"))
    up, down = F.sequence(F.lit(0), F.lit(n)), F.sequence(F.lit(n), F.lit(0))
    left, right, bottom, top = (b[k] for k in ("left", "right", "bottom", "top"))
    return F.concat(
        F.transform(up, lambda i: p(at(left, right, i), bottom)), F.transform(F.slice(up, 2, n), lambda i: p(right, at(bottom, top, i))),
        F.transform(F.slice(down, 2, n), lambda i: p(at(left, right, i), top)), F.transform(F.slice(down, 2, n), lambda i: p(left, at(bottom, top, i))),
    )


def qr2sample(b: Column, i: Column, padding: float = 0.0) -> Column:
    """The i-th quasi-random point of the box, at least ``padding`` inside."""
    p = quasi_random_r2(i)
    return F.struct((b["left"] + padding + p["x"] * (span_x(b) - 2 * padding)).alias("x"), (b["bottom"] + padding + p["y"] * (span_y(b) - 2 * padding)).alias("y"))


def union_agg(b: Column) -> Column:
    """Enclosing box of all rows: four running extremes, combined map-side; boxes of several CRSs are an error."""
    return _agg(b, (F.min, F.min, F.max, F.max))


def intersection_agg(b: Column) -> Column:
    """Common box of all rows; inverted when there is none."""
    return _agg(b, (F.max, F.max, F.min, F.min))


def _agg(b: Column, ops: tuple) -> Column:
    crs = F.coalesce(b["crs"], F.lit(""))
    one = F.min(crs) == F.max(crs)
    name = F.when(one, F.min(b["crs"])).otherwise(F.raise_error(F.lit("boxes are in different reference systems")).cast("string"))
    return F.struct(*(op(b[n]).alias(n) for op, n in zip(ops, SIDES)), name.alias("crs"))


def map_bounds(b: Column, source=None) -> Column:
    """struct(south_west, north_east), each struct(lat, lon)."""
    from .crs import transform as project

    def at(x: Column, y: Column) -> Column:
        lon, lat = (x, y) if source is None else project(x, y, source, 4326)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.struct(at(b["left"], b["bottom"]).alias("south_west"), at(b["right"], b["top"]).alias("north_east"))


def area_of_interest(b: Column, source=None) -> Column:
    """The box in longitude and latitude, around its boundary points there."""
    from .crs import transform as project

    if source is None:
        return b
    pts = F.transform(boundary(b, 21), lambda p: F.struct(*(v.alias(n) for v, n in zip(project(p["x"], p["y"], source, 4326), "xy"))))
    side = lambda k: F.transform(pts, lambda p: p[k])
    return bbox(F.array_min(side("x")), F.array_min(side("y")), F.array_max(side("x")), F.array_max(side("y")), "EPSG:4326")
