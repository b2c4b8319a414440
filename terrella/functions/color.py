"""Colour: stretching to bytes, RGBA, lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_u8(x: Column, vmin: Column | float, vmax: Column | float, integer: bool = True) -> Column:
    """Stretch [vmin, vmax] to 0..255: floor division for integer pixels, truncation for floating ones."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (vmin, vmax))
    c = F.least(F.greatest(x, lo), hi)
    if integer:
        return F.floor((c - lo).cast("long") * 255 / (hi - lo).cast("long")).cast("int")
    return F.try_divide((c - lo) * 255.0, hi - lo).cast("int")


def rgba(r: Column, g: Column, b: Column, vmin: Column | float, vmax: Column | float, nodata: float | None = None, integer: bool = True) -> Column:
    """struct(r, g, b, a); transparency follows the red band alone."""
    lost = r.isNull() | (F.isnan(r) if not integer else F.lit(False))
    if nodata is not None:
        lost = lost | (r == nodata)
    bands = (F.when(lost, F.lit(0)).otherwise(to_u8(v, vmin, vmax, integer)) for v in (r, g, b))
    return F.struct(*(v.alias(n) for v, n in zip(bands, "rgb")), F.when(lost, F.lit(0)).otherwise(F.lit(255)).alias("a"))


def clamp_guess(*bands: Column) -> Column:
    """Aggregate: the largest value of all bands; the stretch starts at 0."""
    return F.greatest(*(F.max(b) for b in bands)) if len(bands) > 1 else F.max(bands[0])


def guess_rgb(names: Sequence[str]) -> tuple[str, str, str]:
    """The one name each that contains red, green and blue."""
    found = []
    for c in ("red", "green", "blue"):
        hits = [n for n in names if c in n.lower()]
        if len(hits) != 1:
            raise ValueError(f"no single {c} band among {list(names)}")
        found.append(hits[0])
    return tuple(found)  # type: ignore[return-value]


def colorize(x: Column, lut: Sequence[Sequence[int]], clip: bool = False) -> Column:
    """Colour of a class number from a table (a literal array); beyond it: the nearest end if clipped, else null."""
    table = F.array(*(F.array(*(F.lit(int(v)) for v in row)) for row in lut))
    i = x.cast("int")
    if clip:
        i = F.least(F.greatest(i, F.lit(0)), F.lit(len(lut) - 1))
    return F.try_element_at(table, F.when(i >= 0, i + 1))


def stretch(x: Column, vmin: Column, vmax: Column, levels: int = 256) -> Column:
    """Class number of a continuous colour table."""
    return F.least(F.greatest(F.floor(F.try_divide(x - vmin, vmax - vmin) * levels), F.lit(0).cast("long")), F.lit(levels - 1).cast("long")).cast("int")


def robust_range(x: Column) -> Column:
    """Aggregate: struct(lo, hi), the 2nd and 98th percentiles."""
    p = F.percentile(x, F.array(F.lit(0.02), F.lit(0.98)))
    return F.struct(p[0].alias("lo"), p[1].alias("hi"))


def replace_transparent(c: Column, color: tuple[int, int, int] = (255, 0, 255)) -> Column:
    pick = lambda n, v: F.when(c["a"] == 0, F.lit(v)).otherwise(c[n])
    return F.struct(*(pick(n, v).alias(n) for n, v in zip("rgb", color)), c["a"].alias("a"))
