"""Measures of pairs of simple shapes in closed form: what a polygon has in common with a box or a segment, where two segments meet.

Shapes are corners, each two columns; a ring's last corner is its first. Many more pairs than rows can meet in a join, so
nothing is made per pair but numbers: NumPy over plain columns, or generated code. For shapes that are rows' own, of any
number of corners, see ``overlay``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shapes import later

Corner = tuple[Column, Column]
#: Relative distance below which places count as equal, as in the kernels.
EPS = 1e-12


def ring_area(ring: list[Corner]) -> Column:
    """Area of a simple ring."""
    (ox, oy), rest = ring[0], ring[1:-1]
    return F.abs(reduce(add, [(px - ox) * (qy - oy) - (qx - ox) * (py - oy) for (px, py), (qx, qy) in zip(rest, rest[1:])])) / 2


def _kernel(f, values: list[Column]) -> Column:
    """f over arrays of numbers, null where one of them is; a column given many times is sent once."""
    sent = {id(v): v for v in values}
    order = [list(sent).index(id(v)) for v in values]

    @later("double")
    def run(*columns: pa.Array) -> pa.Array:
        found = [c.to_numpy(zero_copy_only=False) for c in columns]
        void = reduce(np.logical_or, [c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        return pa.array(f(*(found[i] for i in order)), pa.float64(), mask=void)

    return run(*(v.cast("double") for v in sent.values()))


def area_in_box(ring: list[Corner], box: Column) -> Column:
    """Area that a simple ring and a box have in common; the set operations' areas follow from it.

    Every edge adds the signed area under it, down to the box's bottom and no further than the box goes.
    """
    return _kernel(areas_in_boxes, [v for c in ring for v in c] + [box[k] for k in ("left", "bottom", "right", "top")])


def areas_in_boxes(*values: np.ndarray) -> np.ndarray:
    """Rows' corners x, y in turn, then left, bottom, right and top."""
    xs, ys, (left, low, right, top) = values[:-4:2], values[1:-4:2], values[-4:]
    width, high = np.maximum(right - left, 0.0), np.maximum(top - low, 0.0)
    inner = [np.clip(x - left, 0.0, width) for x in xs]

    def whole(v: np.ndarray) -> np.ndarray:
        """The integral, up to v, of a height that counts between 0 and the box's."""
        h = np.clip(v, 0.0, high)
        return h * (np.maximum(v, 0.0) - h / 2)

    total = np.zeros(len(left))
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(len(xs) - 1):
            step, rise = inner[i + 1] - inner[i], np.nan_to_num((ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]), posinf=0.0, neginf=0.0)
            u, v = (ys[i] - low + (x - (xs[i] - left)) * rise for x in inner[i : i + 2])
            level = np.abs(v - u) <= 1e-9 * (1 + np.abs(u))
            mean = np.where(level, np.clip((u + v) / 2, 0.0, high), (whole(v) - whole(u)) / (v - u))
            total += np.where(step == 0, 0.0, step * mean)
    return np.abs(total)


def share_in_ring(ring: list[Corner], p: Corner, q: Corner) -> Column:
    """Share of the segment from p to q that lies in a simple ring or along it; 0 of one without length.

    Just left of the segment a place is inside if an odd number of edges cross the line ahead of it, and so just right of it; so
    the share is a sum over crossings. The two sides differ only where corners are on the line: then what either has inside counts.
    """
    return _kernel(shares_in_rings, [v for c in (*ring, p, q) for v in c])


def shares_in_rings(*values: np.ndarray) -> np.ndarray:
    """Rows' corners x, y in turn, then those of the segment's ends."""
    c = np.stack(values, 1).reshape(len(values[0]), -1, 2)
    ring, p, d = c[:, :-2], c[:, -2], c[:, -1] - c[:, -2]
    size = (d**2).sum(1)
    far = EPS * np.maximum(1.0, np.abs(c).max((1, 2)))
    rel = ring - p[:, None]
    side = d[:, :1] * rel[..., 1] - d[:, 1:] * rel[..., 0]
    side[np.abs(side) <= (far * np.sqrt(size))[:, None]] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        along = (rel * d[:, None]).sum(-1) / size[:, None]
        at = np.clip((along[:, :-1] * side[:, 1:] - along[:, 1:] * side[:, :-1]) / (side[:, 1:] - side[:, :-1]), 0.0, 1.0)
    lefts, rights = side > 0, side >= 0
    way = lefts[:, 1:].astype(np.int8) - lefts[:, :-1]
    out = np.abs(np.where(way != 0, way * at, 0.0).sum(1))
    k = np.flatnonzero((side == 0).any(1) & (size > 0))
    if len(k):
        both = [np.where(s[k, 1:] != s[k, :-1], at[k], -1.0) for s in (lefts, rights)]  # -1 is ahead of no place
        stops = np.sort(np.clip(np.concatenate([*both, np.zeros((len(k), 1)), np.ones((len(k), 1))], 1), 0.0, 1.0), 1)
        mid = (stops[:, 1:] + stops[:, :-1]) / 2
        inside = [(b[:, None] > mid[..., None]).sum(-1) % 2 == 1 for b in both]
        out[k] = np.where(inside[0] | inside[1], np.diff(stops, axis=1), 0.0).sum(1)
    return np.where(size > 0, out, 0.0)


def with_crossing(df: DataFrame, p: Corner, q: Corner, u: Corner, v: Corner, name: str) -> DataFrame:
    """``df`` with struct(x, y) where the segments p to q and u to v meet, ends included; null where they do not, or are parallel."""
    ends = {f"_{k}{n}": w.cast("double") for n, c in enumerate((p, q, u, v)) for k, w in zip("xy", c)}
    p, q, u, v = ((F.col(f"_x{n}"), F.col(f"_y{n}")) for n in range(4))
    dx, dy, ex, ey, span, far, s, t = (F.col(f"_{k}") for k in ("dx", "dy", "ex", "ey", "span", "far", "s", "t"))
    made = {"_dx": q[0] - p[0], "_dy": q[1] - p[1], "_ex": v[0] - u[0], "_ey": v[1] - u[1], "_far": EPS * F.greatest(F.lit(1.0), *(F.abs(w) for c in (p, q, u, v) for w in c))}
    place = {"_s": F.try_divide((u[0] - p[0]) * ey - (u[1] - p[1]) * ex, span), "_t": F.try_divide((u[0] - p[0]) * dy - (u[1] - p[1]) * dx, span)}
    # along each as far as its ends, or within rounding of them
    on = lambda r, a, b: (r * F.sqrt(a * a + b * b) >= -far) & ((r - 1) * F.sqrt(a * a + b * b) <= far)
    # steps are columns of their own: expressions that repeat what they build on would grow with every step
    out = reduce(lambda f, step: f.withColumns(step), (ends, made, {"_span": dx * ey - dy * ex}, place), df)
    meet = F.when((span != 0) & on(s, dx, dy) & on(t, ex, ey), F.struct((p[0] + dx * s).alias("x"), (p[1] + dy * s).alias("y")))
    return out.select(*df.columns, meet.alias(name))
