"""Ground control points: polynomial maps between pixel and world, fitted per image from partial sums.

A map has up to nine terms, products of powers of x and y up to the second. Points are centred and scaled per image, their
moments are sums with map-side combine, and one small system of equations is solved per row: no image's points are ever
gathered. Maps the other way are found by Newton's method from the linear part, as column expressions.

A grid with control points is a plain grid (``functions.geobox``) from its pixels to those of the control points, next to the
columns of a fit: crops, pads and zooms are those of plain grids.

Defined cases: images with fewer than three points have no row in the fit; with three, four to eight, or nine and more points
a map has three, four or nine terms; points that fix no such map, as on one line, give null coefficients. Rows with a null
coordinate don't count. Repeated points count as often as they occur.
"""

from __future__ import annotations

from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine as A
from ..functions import geobox as G
from ..functions.scalar import let
from .shapes import later

#: Powers of x and y of each term, in order of the coefficients.
POWERS = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2))


def terms(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Columns of the design matrix: 3 linear, 4 bilinear, 9 biquadratic."""
    return np.stack([x**i * y**j for i, j in POWERS[:n]], -1)


def term_count(n: int) -> int:
    return 9 if n >= 9 else 4 if n >= 4 else 3


def fit(aa: np.ndarray, bb: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float, int]:
    """The map of one image's points in memory, by the same centring and scale."""
    n = len(aa)
    if n < 3:
        raise ValueError("at least 3 points are needed")
    mean = aa.mean(0)
    d = aa - mean
    scale = float(np.sqrt(2 * n / (d**2).sum()))
    k = term_count(n)
    c, *_ = np.linalg.lstsq(terms(d[:, 0] * scale, d[:, 1] * scale, k), bb, rcond=None)
    return c[:, 0], c[:, 1], float(mean[0]), float(mean[1]), scale, k


@later("struct<px:array<double>,py:array<double>>")
def _solved(moments: pa.Array, sides: pa.Array, n: pa.Array) -> pa.Array:
    """Coefficients from the sums of u**i * v**j, i and j up to 4, and of terms times both targets."""
    out: tuple[list, list] = ([], [])
    for m, s, count in zip(moments.to_pylist(), sides.to_pylist(), n.to_pylist()):
        k = term_count(count)
        square = np.array([[m[5 * (a + c) + b + d] for c, d in POWERS[:k]] for a, b in POWERS[:k]], float)
        right = np.array(s, float).reshape(2, 9)[:, :k].T
        whole = np.isfinite(square).all() and np.linalg.matrix_rank(square, hermitian=True) == k
        found = np.linalg.solve(square, right).T if whole else (None, None)
        for o, c in zip(out, found):
            o.append(None if c is None else c.tolist())
    return pa.StructArray.from_arrays([pa.array(o, pa.list_(pa.float64())) for o in out], ["px", "py"])


def fit_images(points: DataFrame, source: tuple[str, str], target: tuple[str, str], image: str = "image") -> DataFrame:
    """image, coefficients px and py, centre mx and my, scale, terms: one row per image."""
    x, y, wx, wy = (F.col(c).cast("double") for c in (*source, *target))
    p = points.select(F.col(image).cast("long").alias("image"), x.alias("x"), y.alias("y"), wx.alias("wx"), wy.alias("wy")).dropna(subset=["x", "y", "wx", "wy"])
    spread = F.sqrt(F.try_divide(F.lit(2.0), F.var_pop("x") + F.var_pop("y")))
    centre = p.groupBy("image").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), spread.alias("scale"), F.count(F.lit(1)).alias("n")).filter("n >= 3").withColumnRenamed("image", "_of")
    u, v = (F.col("x") - F.col("mx")) * F.col("scale"), (F.col("y") - F.col("my")) * F.col("scale")
    q = p.join(centre, F.col("image").eqNullSafe(F.col("_of"))).select("image", "mx", "my", "scale", "n", u.alias("u"), v.alias("v"), "wx", "wy")
    power = lambda i, j: F.pow("u", F.lit(i)) * F.pow("v", F.lit(j))
    moments = F.array(*(F.sum(power(i, j)) for i, j in product(range(5), repeat=2)))
    sides = F.array(*(F.sum(power(i, j) * F.col(w)) for w in ("wx", "wy") for i, j in POWERS))
    sums = q.groupBy("image", "mx", "my", "scale", "n").agg(moments.alias("m"), sides.alias("s"))
    solved = sums.withColumn("c", _solved("m", "s", "n"))
    count = F.when(F.col("n") >= 9, 9).when(F.col("n") >= 4, 4).otherwise(3)
    return solved.select("image", "c.px", "c.py", "mx", "my", "scale", count.alias("terms"))


def _value(c: Column, u: Column, v: Column) -> Column:
    at = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    return F.when(c.isNotNull(), at(0) + at(1) * u + at(2) * v + at(3) * u * v + (at(4) + at(6) * v) * u * u + (at(5) + at(7) * u) * v * v + at(8) * u * u * v * v)


def _slopes(c: Column, u: Column, v: Column) -> tuple[Column, Column]:
    at = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    return at(1) + at(3) * v + (at(4) + at(6) * v + at(8) * v * v) * u * 2 + at(7) * v * v, at(2) + at(3) * u + (at(5) + at(7) * u + at(8) * u * u) * v * 2 + at(6) * u * u


def _columns(prefix: str) -> list[Column]:
    return [F.col(prefix + n) for n in ("px", "py", "mx", "my", "scale")]


def evaluate(x: Column, y: Column, prefix: str = "") -> tuple[Column, Column]:
    """Pixel to world by the fit columns of the row."""
    px, py, mx, my, scale = _columns(prefix)
    u, v = (x - mx) * scale, (y - my) * scale
    return _value(px, u, v), _value(py, u, v)


def invert(x: Column, y: Column, prefix: str = "", rounds: int = 12) -> Column:
    """World to pixel by the fit columns of the row: struct(x, y), by Newton steps from the linear part of the map."""
    px, py, mx, my, scale = _columns(prefix)

    def step(p: Column, first: bool) -> Column:
        u, v = p["u"], p["v"]
        if first:  # about the centre, where only the linear terms are left
            (a, b), (c, d), e, f = (F.get(px, F.lit(1)), F.get(px, F.lit(2))), (F.get(py, F.lit(1)), F.get(py, F.lit(2))), x - F.get(px, F.lit(0)), y - F.get(py, F.lit(0))
        else:
            (a, b), (c, d), e, f = _slopes(px, u, v), _slopes(py, u, v), x - _value(px, u, v), y - _value(py, u, v)
        bound = F.struct(*(k.alias(n) for k, n in zip((a, b, c, d, e, f), "abcdef")))
        solve = lambda m: F.struct((u + F.try_divide(m["e"] * m["d"] - m["b"] * m["f"], m["a"] * m["d"] - m["b"] * m["c"])).alias("u"), (v + F.try_divide(m["a"] * m["f"] - m["e"] * m["c"], m["a"] * m["d"] - m["b"] * m["c"])).alias("v"))
        return let(bound, solve)

    start = step(F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("v")), True)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda p, _: step(p, False))
    return let(found, lambda p: F.struct((p["u"] / scale + mx).alias("x"), (p["v"] / scale + my).alias("y")))


def substituted(c: Column, sx: Column | float, tx: Column | float, sy: Column | float, ty: Column | float) -> Column:
    """Nine coefficients of a map after x -> sx * x + tx and y -> sy * y + ty on its input."""
    lit = lambda k: k if isinstance(k, Column) else F.lit(float(k))
    sx, tx, sy, ty = map(lit, (sx, tx, sy, ty))
    at = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))

    def power(k: Column, n: int) -> Column:
        return F.lit(1.0) if n == 0 else k if n == 1 else k * k

    def term(a: int, b: int) -> Column:
        parts = [at(n) * (comb(i, a) * comb(j, b)) * power(sx, a) * power(tx, i - a) * power(sy, b) * power(ty, j - b) for n, (i, j) in enumerate(POWERS) if i >= a and j >= b]
        return sum(parts[1:], parts[0])

    return F.array(*(term(a, b) for a, b in POWERS))


def on_grid(fits: DataFrame, xs: Column, ys: Column, prefix: str = "") -> DataFrame:
    """The maps at all places of two axes (arrays): the fits' columns with x, y, wx, wy."""
    t = fits.withColumn("y", F.explode(ys.cast("array<double>"))).withColumn("x", F.explode(xs.cast("array<double>")))
    wx, wy = evaluate(F.col("x"), F.col("y"), prefix)
    return t.withColumns({"wx": wx, "wy": wy})


def grid_to_world(g: Column, x, y, prefix: str = "") -> tuple[Column, Column]:
    """A pixel of a grid over control points in the world."""
    p = G.pix2wld(g, x, y)
    return evaluate(p["x"], p["y"], prefix)


def world_to_grid(g: Column, x: Column, y: Column, prefix: str = "") -> Column:
    """struct(x, y): a place in the world as a pixel of a grid over control points."""
    return let(invert(x, y, prefix), lambda p: G.wld2pix(g, p["x"], p["y"]))


def grid_points(g: Column, px: Column, py: Column) -> Column:
    """struct(x, y): a control point's pixel in a cropped, padded or zoomed grid."""
    return G.wld2pix(g, px, py)


def grid_affine(g: Column, approximation: Column) -> Column:
    """The best affine of a whole image, for the pixels of a grid over it."""
    return A.multiply(approximation, g["m"])


def approximate(points: DataFrame, image: str = "image") -> DataFrame:
    """Best affine per image, from partial sums."""
    from ..functions.scalar import affine_fit

    f = affine_fit(F.col("px"), F.col("py"), F.col("wx"), F.col("wy"))
    return points.groupBy(image).agg(*(v.alias(k) for k, v in f.items()))
