"""Scalar maths: snapping, alignment, binning, quasi-random points, line and affine fits."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int
R2 = (0.7548776662466927, 0.5698402909980532)  # fixed values of the R2 sequence


def col(x: Num | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x) if isinstance(x, float) else x)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, where f uses it many times."""
    return F.element_at(F.transform(F.array(x), f), 1)


def bound(f: Callable) -> Callable:
    """A builder whose first argument is evaluated once: composed builders would otherwise repeat it for every use.

    A plain column needs no binding, so expressions over columns stay in generated code.
    """

    @wraps(f)
    def run(x: Column, *args, **kw) -> Column:
        return f(x, *args, **kw) if len(str(x)) < 48 else let(x, lambda v: f(v, *args, **kw))

    return run


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def maybe_zero(x: Column, tol: float) -> Column:
    return F.when(F.abs(x) < tol, F.lit(0.0)).otherwise(x)


@bound
def split_float(x: Column) -> Column:
    """struct(whole, frac), frac in [-0.5, 0.5]; what is not finite is whole."""
    part = x % F.lit(1.0)
    shift = F.when(part > 0.5, F.lit(1.0)).when(part < -0.5, F.lit(-1.0)).otherwise(F.lit(0.0))
    return F.when(finite(x), F.struct((x - part + shift).alias("whole"), (part - shift).alias("frac"))).otherwise(F.struct(x.alias("whole"), F.lit(0.0).alias("frac")))


@bound
def maybe_int(x: Column, tol: float) -> Column:
    s = split_float(x)
    return F.when(finite(x) & (F.abs(s["frac"]) < tol), s["whole"]).otherwise(x)


@bound
def snap_scale(s: Column, tol: float = 1e-6) -> Column:
    """Nearest integer or 1/integer within tol."""
    inverse = F.try_divide(F.lit(1.0), s)
    snapped = maybe_int(inverse, tol)
    return F.when(F.abs(s) >= 1 - tol, maybe_int(s, tol)).when((F.abs(s) < tol) | (snapped == inverse), s).otherwise(F.try_divide(F.lit(1.0), snapped))


def align_down(x: Column, n: Num) -> Column:
    return x - F.pmod(x, col(n))


def align_up(x: Column, n: Num) -> Column:
    return align_down(x + (col(n) - 1), n)


@bound
def align_up_pow2(x: Column) -> Column:
    """Smallest power of two not below x; 1 for x <= 0. A loop-free bit smear, exact for all longs below 2**62."""
    v = x.cast("long") - 1
    for k in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftright(v, k))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(v + 1)


@bound
def align_down_pow2(x: Column) -> Column:
    up = align_up_pow2(x)
    return F.when(up > x, F.shiftright(up, 1)).otherwise(up)


def clamp(x: Column, lo: Num, hi: Num) -> Column:
    """NaN passes through, as comparisons with it fail."""
    return F.when(F.isnan(x.cast("double")), x).otherwise(F.least(F.greatest(x, col(lo)), col(hi)))


@bound
def is_almost_int(x: Column, tol: float) -> Column:
    m = F.abs(x % F.lit(1.0))
    return finite(x) & (F.least(m, 1 - m) < tol)


def snap_grid(x0: Column, x1: Column, res: Num, off_pix: float | None = 0.0, tol: float = 1e-6) -> Column:
    """struct(origin, n) of the pixel axis that covers [x0, x1]: snapped to off_pix of a pixel, or floating for None."""
    one = F.lit(1).cast("long")

    def free(v: Column) -> Column:
        n = F.greatest(one, F.ceil(maybe_int((v["x1"] - v["x0"]) / v["size"], tol)))
        return F.struct(F.when(v["r"] > 0, v["x0"]).otherwise(v["x1"]).alias("origin"), n.alias("n"))

    def snapped(v: Column) -> Column:
        off = v["size"] * off_pix
        lo, hi = F.floor(maybe_int((v["x0"] - off) / v["size"], tol)), F.ceil(maybe_int((v["x1"] - off) / v["size"], tol))
        ends = F.struct(lo.alias("lo"), F.greatest(one, hi - lo).alias("n"))
        return let(ends, lambda e: F.struct((F.when(v["r"] > 0, e["lo"] * v["size"]).otherwise((e["lo"] + e["n"]) * v["size"]) + off).alias("origin"), e["n"].alias("n")))

    r = col(res).cast("double")
    axis = F.struct(x0.alias("x0"), x1.alias("x1"), r.alias("r"), F.abs(r).alias("size"))
    return let(axis, free if off_pix is None else snapped)


def bin_index(x: Column, size: Num, origin: Num = 0.0, direction: int = 1) -> Column:
    return (F.floor((x - col(origin)) / col(size)) * direction).cast("long")


def bin_edges(i: Column, size: Num, origin: Num = 0.0, direction: int = 1) -> Column:
    """struct(lo, hi) of bin i."""
    lo = i * direction * col(size) + col(origin)
    return F.struct(lo.alias("lo"), (lo + col(size)).alias("hi"))


def bin_from_sample(index: int, lo: float, hi: float, direction: int = 1) -> tuple[float, float, int]:
    """(size, origin, direction) of bins of which one is known."""
    size = hi - lo
    return size, lo - direction * index * size, direction


def quasi_random_r2(i: Column) -> Column:
    """struct(x, y) of the R2 sequence; the index passes through single precision."""
    k = i.cast("float").cast("double")
    return F.struct(*((k * a % F.lit(1.0)).alias(n) for n, a in zip("xy", R2)))


def axis_fit(value: Column, index: Column, fallback: Num | None = None) -> tuple[Column, Column]:
    """Aggregates (resolution, offset) of a regular axis: from its first and last value, half a pixel before the first."""
    n = F.count(value)
    first, last = F.min_by(value, index), F.max_by(value, index)
    one = F.lit(None).cast("double") if fallback is None else col(fallback).cast("double")
    res = F.when(n > 1, F.try_divide(last - first, n - 1)).otherwise(one)
    res = F.when(res.isNotNull(), res).otherwise(F.raise_error(F.lit("an axis of one value needs a resolution")).cast("double"))
    return res, first - res * 0.5


def affine_fit(x: Column, y: Column, u: Column, v: Column) -> dict[str, Column]:
    """Aggregates of the least-squares affine (u, v) = A (x, y): partial sums about a map-side mean, one 2x2 solve at the end."""
    cov = lambda p, q: F.covar_pop(p, q)
    det = cov(x, x) * cov(y, y) - cov(x, y) * cov(x, y)
    out = {}
    for (p, q, r), t in ((("a", "b", "c"), u), (("d", "e", "f"), v)):
        out[p] = F.try_divide(cov(x, t) * cov(y, y) - cov(y, t) * cov(x, y), det)
        out[q] = F.try_divide(cov(y, t) * cov(x, x) - cov(x, t) * cov(x, y), det)
        out[r] = F.avg(t) - out[p] * F.avg(x) - out[q] * F.avg(y)
    return out


def norm_xy_scale(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """Aggregate: mean of each point's inverse distance from the mean (scaled so that distances average root two)."""
    return F.avg(F.try_divide(F.lit(1.0), F.sqrt(((x - mx) * (x - mx) + (y - my) * (y - my)) * 0.5)))


def edge_index(ny: Num, nx: Num, closed: bool = False) -> Column:
    """Array of struct(y, x): the walk along the edge of a ny by nx grid, clockwise from (0, 0)."""
    ny, nx = col(ny).cast("int"), col(nx).cast("int")
    at = lambda y, x: F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"))
    empty = F.array().cast("array<int>")
    span = lambda a, b, ok: F.when(ok, F.sequence(a, b)).otherwise(empty)
    zero = F.lit(0)
    walk = [
        F.transform(span(zero, nx - 1, nx > 0), lambda i: at(zero, i)),
        F.transform(span(F.lit(1), ny - 1, ny > 1), lambda i: at(i, nx - 1)),
        F.transform(F.reverse(span(zero, nx - 2, nx > 1)), lambda i: at(ny - 1, i)),
        F.transform(F.reverse(span(F.lit(1), ny - 2, ny > 2)), lambda i: at(i, zero)),
    ]
    return F.concat(*walk, *([F.array(at(zero, zero))] if closed else []))
