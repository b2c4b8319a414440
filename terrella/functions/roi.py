"""Slices struct(start, stop) and regions struct(y0, y1, x0, x1) of pixel planes, half open and normalised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import align_down, align_up, finite


def span(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def normalise(start: Column, stop: Column, n: Column) -> Column:
    """Open ends (null) filled, negative ends counted from the end."""
    fix = lambda v: F.when(v < 0, n + v).otherwise(v)
    return span(fix(F.coalesce(start, F.lit(0))), fix(F.coalesce(stop, n)))


def length(s: Column) -> Column:
    return s["stop"] - s["start"]


def is_empty(s: Column) -> Column:
    return length(s) <= 0


def is_full(s: Column, n: Column) -> Column:
    return (s["start"] <= 0) & (s["stop"] >= n)


def intersect(a: Column, b: Column) -> Column:
    """Of disjoint slices, the empty slice at a's nearer end."""
    return (
        F.when(a["stop"] < b["start"], span(a["stop"], a["stop"])).when(a["start"] > b["stop"], span(a["start"], a["start"]))
        .otherwise(span(F.greatest(a["start"], b["start"]), F.least(a["stop"], b["stop"])))
    )


def intersect3(a: Column, b: Column) -> Column:
    """struct(a, b, ab): the overlap within a, within b, and absolute."""
    na, nb, zero = length(a), length(b), F.lit(0)
    out = lambda x, y, z: F.struct(x.alias("a"), y.alias("b"), z.alias("ab"))
    lo, hi = F.greatest(a["start"], b["start"]), F.least(a["stop"], b["stop"])
    return (
        F.when(a["stop"] < b["start"], out(span(na, na), span(zero, zero), span(a["stop"], a["stop"])))
        .when(a["start"] > b["stop"], out(span(zero, zero), span(nb, nb), span(a["start"], a["start"])))
        .otherwise(out(span(lo - a["start"], hi - a["start"]), span(lo - b["start"], hi - b["start"]), span(lo, hi)))
    )


def pad(s: Column, by: Column | int, n: Column) -> Column:
    return span(F.greatest(F.lit(0), s["start"] - by), F.least(n, s["stop"] + by))


def center(s: Column) -> Column:
    return (s["start"] + s["stop"]) * 0.5


def scale_down(s: Column, k: Column | int) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return span(F.floor(s["start"] / k), F.ceil(s["stop"] / k))


def scale_up(s: Column, k: Column | int, n: Column | None = None) -> Column:
    lo, hi = s["start"] * k, s["stop"] * k
    return span(lo, hi) if n is None else span(F.least(lo, n), F.least(hi, n))


def scaled_down_length(n: Column, k: Column | int) -> Column:
    return F.ceil(n / (k if isinstance(k, Column) else F.lit(k)))


def window(y: Column, x: Column) -> Column:
    """Reader's window: ((row start, row stop), (column start, column stop))."""
    return F.struct(y.alias("rows"), x.alias("cols"))


def boundary(y: Column, x: Column, per_side: int = 2) -> Column:
    from . import bbox as B

    return B.boundary(B.bbox(x["start"], y["start"], x["stop"], y["stop"]), per_side)


def from_points(x: Column, y: Column, ny: Column, nx: Column, padding: int = 0, align: int | None = None) -> Column:
    """Aggregate: struct(y, x) slices around the finite points, padded, aligned, clipped to the plane; empty without any."""
    ok = finite(x) & finite(y)

    def axis(v: Column, n: Column) -> Column:
        v = F.when(ok, v)
        lo, hi = F.floor(F.min(v)) - padding, F.ceil(F.max(v)) + padding
        if align is not None:
            lo, hi = align_down(lo, align), align_up(hi, align)
        clip = lambda c: F.coalesce(F.least(F.greatest(c, F.lit(0).cast("long")), n.cast("long")), F.lit(0).cast("long"))
        return span(clip(lo), clip(hi))

    return F.struct(axis(y, F.max(ny)).alias("y"), axis(x, F.max(nx)).alias("x"))


def polygon_path(xs: Column, ys: Column, closed: bool = True) -> Column:
    """Ring of points along the edges of a grid given by its axis values (arrays)."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, x1, y0, y1 = F.element_at(xs, 1), F.element_at(xs, -1), F.element_at(ys, 1), F.element_at(ys, -1)
    rest = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    ring = F.concat(
        F.transform(xs, lambda x: p(x, y0)), F.transform(rest(ys), lambda y: p(x1, y)),
        F.transform(rest(F.reverse(xs)), lambda x: p(x, y1)), F.transform(rest(F.reverse(ys)), lambda y: p(x0, y)),
    )
    return ring if closed else F.slice(ring, 1, F.size(ring) - 1)
