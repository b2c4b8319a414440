"""Set operations on geometries of any shape and dimension, and splitting by lines.

Both geometries become one arrangement of nodes and edges (``topology``), which knows on which sides of every edge each of
the two lies. An area of a result is bounded by the edges on one side of which it lies; lines of a result are the edges in
it that its areas leave uncovered; points, the nodes that only touch. One row is one pair, so nothing is gathered;
``dissolve`` merges the polygons of many rows by cells, level by level.

Defined cases: a null gives null; different coordinate systems are an error. ``pieces`` gives a result's points, lines and
areas apart; the other functions give its highest dimension: of two polygons always an area, without parts where they have
none in common, of a polygon and a line what the operation leaves of the line (a union is the polygon, and the line outside
by ``pieces``), of two lines lines or else the points where they cross.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as Geo
from ..functions.crs import projected_lon
from ..functions.geometry import TYPE
from .kernels import _dim, _geom, _near, _points, _reach, _rings, _segments, arrangement, arrangements, cut, in_batches, members, oriented, place, signed_area
from .shapes import decode, encode, later, pairs, same_system, whole
from .topology import ON, ONE, Arrangement, numbered, paths, rings

#: What a result has, by what the two operands have.
UNION, INTERSECTION, SYMMETRIC = np.logical_or, np.logical_and, np.logical_xor


def DIFFERENCE(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # noqa: N802
    return a & ~b


OPERATIONS = {"union": UNION, "intersection": INTERSECTION, "difference": DIFFERENCE, "symmetric": SYMMETRIC}


def turned(s: np.ndarray) -> np.ndarray:
    return s[:, [2, 3, 0, 1]]


def polygons_of(found: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings, each with the holes in it; a hole goes to the smallest ring around it. Rings do not cross."""
    if len(found) < 2:
        return [found] if found and signed_area(found[0]) > 0 else []
    flat, start = np.concatenate(found), np.cumsum([0] + [len(r) for r in found[:-1]])
    q = flat - np.repeat(flat[start], np.diff(np.append(start, len(flat))), axis=0)
    turn = np.append(q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1], 0.0)
    turn[start[1:] - 1] = 0  # from ring to ring
    areas = np.add.reduceat(turn, start) / 2
    outer = [k for k in np.argsort(areas, kind="stable").tolist() if areas[k] > 0]
    parts = [[found[k]] for k in outer]
    holes = np.flatnonzero(areas < 0).tolist()
    if len(outer) == 1:
        parts[0] += [found[k] for k in holes]
        return parts
    low, high, sizes = np.minimum.reduceat(flat, start), np.maximum.reduceat(flat, start), areas[outer]
    for h in holes:
        around = np.flatnonzero((low[outer] <= low[h]).all(1) & (high[outer] >= high[h]).all(1) & (sizes > -areas[h]))
        middle = (found[h][:1] + found[h][1:2]) / 2  # rings share points, not edges
        for k in around.tolist():
            # every hole is in some ring, so the only one it can be in needs no test
            if len(around) == 1 or place(middle, _geom("Polygon", None, [[parts[k][0]]]))[0] > 0:
                parts[k].append(found[h])
                break
    return parts


def _shaped(crs, kind: str, parts: list) -> dict:
    return _geom(f"Multi{kind}" if len(parts) > 1 else kind, crs, parts)


def _areas_by_group(r: Arrangement, systems: list[str | None], op) -> list[dict]:
    found, heads = rings(r.xy, r.area(op))
    by: list[list[np.ndarray]] = [[] for _ in systems]
    for ring, g in zip(found, r.node_group[heads].tolist() if heads else ()):
        by[g].append(ring)
    return [_shaped(crs, "Polygon", polygons_of(each)) for crs, each in zip(systems, by)]


def _areas(r: Arrangement, crs, op) -> dict:
    return _areas_by_group(r, [crs], op)[0]


def apart(a, b, op) -> tuple[dict, dict, dict]:
    """The points, lines and areas of a result."""
    crs, none = a["crs"], lambda kind: _geom(kind, a["crs"], [])
    dims = _dim(a), _dim(b)
    if 0 not in dims:
        r = arrangement(a, b)
        area = _areas(r, crs, op) if 2 in dims else none("Polygon")
        left = r.lines(op)
        lines = _shaped(crs, "LineString", [[x] for x in paths(r.xy, left)])
        spots = np.zeros(0, np.int64)
        if op is INTERSECTION:
            spots = r.common_nodes()
            inside = op(r.left[0], r.left[1]) | op(r.right[0], r.right[1])
            taken = np.concatenate([left.ravel(), r.u[inside], r.v[inside]])
            spots = spots[~np.isin(spots, taken)]
        return _shaped(crs, "Point", [[p[None]] for p in r.xy[spots]]), lines, area
    eps = _reach(a, b)
    # point sets: each point is in the result or not; what is no point set stays whole, but for an intersection
    kept = [np.zeros((0, 2))]
    rest = [none("Point"), none("LineString"), none("Polygon")]
    for mine, other, first in ((a, b, True), (b, a, False)):
        alone, shared = (op(np.array([x]), np.array([y]))[0] for x, y in (((True, False), (True, True)) if first else ((False, True), (True, True))))
        if _dim(mine):
            if alone:
                rest[_dim(mine)] = mine
            continue
        p = np.unique(_points(mine), axis=0)
        both = members(p, other, eps)
        kept.append(p[~both & alone | both & shared])
    p = np.unique(np.concatenate(kept), axis=0)
    for g in rest[1:]:
        if len(p) and g["parts"]:
            p = p[~members(p, g, eps)]
    rest[0] = _shaped(crs, "Point", [[x[None]] for x in p])
    return tuple(rest)


def combine(a, b, op) -> dict:
    """The highest dimension of a result."""
    if _dim(a) == 2 and _dim(b) == 2:
        return _areas(arrangement(a, b), a["crs"], op)
    found = apart(a, b, op)
    return next((g for g in found[::-1] if g["parts"]), found[min(_dim(a), _dim(b))])


def split_polygon(g, line) -> list[dict]:
    """The pieces of a polygon that lines cut off; ends of lines inside it cut nothing."""
    eps = _reach(g, line)
    edge, ls = oriented(g), _segments(line)
    inner = cut(cut(ls, edge, eps), ls, eps)
    inner = inner[place((inner[:, :2] + inner[:, 2:]) / 2, g, eps) > 0]
    edge = cut(edge, ls, eps)
    while len(inner):
        ends = np.concatenate([edge, inner]).reshape(-1, 2)
        ids = numbered(ends, eps * ONE / ON)
        degree = np.bincount(ids)
        loose = (degree[ids.reshape(-1, 2)] < 2).any(1)[len(edge) :]
        if not loose.any():
            break
        inner = inner[~loose]
    every = np.concatenate([edge, inner, turned(inner)])
    ids = numbered(every.reshape(-1, 2), eps * ONE / ON).reshape(-1, 2)
    ids = np.unique(ids[ids[:, 0] != ids[:, 1]], axis=0)
    return [_geom("Polygon", g["crs"], [part]) for part in polygons_of(rings(every.reshape(-1, 2), ids)[0])]


def uncut(found: list[tuple[dict, dict] | None]) -> dict[int, dict]:
    """By number, the convex polygons of three or four corners whose boxes are apart from the lines': one piece each, in no need of cutting."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(found):
        if p is not None and _dim(p[0]) == 2 and all(len(g["parts"]) == 1 and len(g["parts"][0]) == 1 for g in p):
            n, m = (len(g["parts"][0][0]) for g in p)
            if 4 <= n <= 5 and m:
                groups.setdefault((n, m), []).append(i)
    out = {}
    for rows in groups.values():
        a, b = (np.stack([_rings(found[i][k])[0][0] for i in rows]) for k in (0, 1))
        side = np.diff(a, axis=1)
        after = np.roll(side, -1, 1)
        turn = side[..., 0] * after[..., 1] - side[..., 1] * after[..., 0]
        far = ONE * np.maximum(1.0, np.maximum(np.abs(a).max((1, 2)), np.abs(b).max((1, 2))))[:, None]
        apart = ((a.min(1) > b.max(1) + far) | (b.min(1) > a.max(1) + far)).any(1)
        simple = (a[:, 0] == a[:, -1]).all(1) & ((turn > 0).all(1) | (turn < 0).all(1)) & (np.abs(side).max(2) > far).all(1)
        for k in np.flatnonzero(apart & simple).tolist():
            out[rows[k]] = _geom("Polygon", found[rows[k]][0]["crs"], [[a[k] if turn[k, 0] > 0 else a[k, ::-1]]])
    return out


def split_line(g, by) -> list[dict]:
    """The pieces of lines between their meetings with a geometry."""
    eps = _reach(g, by)
    other = _segments(by)
    out = []
    for part in _rings(g):
        for r in part:
            steps = cut(np.concatenate([r[:-1], r[1:]], 1), other, eps)
            run: list = []
            for s in steps:
                run = run or [s[:2]]
                run.append(s[2:])
                if len(other) and _near(s[None, 2:], other, eps).any():
                    out.append(np.array(run))
                    run = []
            if run:
                out.append(np.array(run))
    return [_geom("LineString", g["crs"], [[r]]) for r in out]


def combine_all(found: list[tuple[dict, dict] | None], ops: list) -> list[list[dict | None]]:
    """``combine`` of many pairs, by operation; polygons are arranged many pairs at a time."""
    out: list[list[dict | None]] = [[None] * len(found) for _ in ops]
    for run in in_batches(found):
        batch = [found[i] for i in run]
        areal = _dim(batch[0][0]) == _dim(batch[0][1]) == 2
        shared = arrangements(batch) if areal else None
        for k, op in enumerate(ops):
            for i, g in zip(run, _areas_by_group(shared, [a["crs"] for a, _ in batch], op) if areal else [combine(a, b, op) for a, b in batch]):
                out[k][i] = g
    return out


def _operation(name: str) -> Callable[[Column, Column], Column]:
    @later(TYPE)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return encode(combine_all(list(pairs(a, b)), [OPERATIONS[name]])[0])

    return lambda a, b: run(whole(a), whole(b))


_RUN = {name: _operation(name) for name in OPERATIONS}


def union(a: Column, b: Column) -> Column:
    return _RUN["union"](a, b)


def intersection(a: Column, b: Column) -> Column:
    return _RUN["intersection"](a, b)


def difference(a: Column, b: Column) -> Column:
    return _RUN["difference"](a, b)


def symmetric_difference(a: Column, b: Column) -> Column:
    return _RUN["symmetric"](a, b)


def _struct(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


@later(f"struct<{','.join(f'{n}:{TYPE}' for n in OPERATIONS)}>")
def _every(a: pa.Array, b: pa.Array) -> pa.Array:
    return _struct({n: encode(x) for n, x in zip(OPERATIONS, combine_all(list(pairs(a, b)), list(OPERATIONS.values())))})


def every_operation(a: Column, b: Column) -> Column:
    """struct(union, intersection, difference, symmetric): all of one arrangement."""
    return _every(whole(a), whole(b))


_PIECES: dict[str, Callable[[Column, Column], Column]] = {}


def pieces(a: Column, b: Column, operation: str = "intersection") -> Column:
    """struct(points, lines, areas) of a result; lines that its areas cover and points on either are no pieces of their own."""
    if operation not in _PIECES:

        @later(f"struct<points:{TYPE},lines:{TYPE},areas:{TYPE}>")
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            found = [(None, None, None) if p is None else apart(*p, OPERATIONS[operation]) for p in pairs(a, b)]
            return _struct({n: encode([f[i] for f in found]) for i, n in enumerate(("points", "lines", "areas"))})

        _PIECES[operation] = run
    return _PIECES[operation](whole(a), whole(b))


def fold_all(groups: list[list[dict | None]], op) -> list[dict | None]:
    """Each group folded to one geometry, neighbours first, so the operands stay small as long as possible; a level of all groups at a time."""
    todo = [[g for g in shapes if g is not None] for shapes in groups]
    for shapes in todo:
        for g in shapes[1:]:
            same_system(shapes[0], g)
    while any(len(shapes) > 1 for shapes in todo):
        met = iter(combine_all([(s[i], s[i + 1]) for s in todo for i in range(0, len(s) - 1, 2)], [op])[0])
        todo = [[next(met) for _ in range(len(s) // 2)] + s[len(s) // 2 * 2 :] for s in todo]
    return [s[0] if s else None for s in todo]


def _fold(op):
    @later(TYPE)
    def run(shapes: pa.Array) -> pa.Array:
        flat, ends = decode(shapes.flatten()), np.cumsum([0] + [len(x) if x.is_valid else 0 for x in shapes])
        return encode(fold_all([flat[a:b] for a, b in zip(ends, ends[1:])], op))

    return run


_unary_union, _unary_intersection = _fold(UNION), _fold(INTERSECTION)


def _all_whole(shapes: Column) -> Column:
    return F.transform(shapes, lambda g: F.when(g.isNotNull(), whole(g)))


def unary_union(shapes: Column) -> Column:
    """Union of an array of geometries in one row; null for an empty array. Of the polygons of many rows, see ``dissolve``."""
    return _unary_union(_all_whole(shapes))


def unary_intersection(shapes: Column) -> Column:
    return _unary_intersection(_all_whole(shapes))


def _stadium(p: np.ndarray, q: np.ndarray, d: float, quadrant: int) -> np.ndarray:
    """All places within d of a segment: its offsets to both sides, and half circles of ``2 * quadrant`` sides."""
    way = np.arctan2(*(q - p)[::-1])
    t = np.linspace(-np.pi / 2, np.pi / 2, 2 * quadrant + 1)
    half = lambda c, a: c + d * np.stack([np.cos(a), np.sin(a)], 1)
    ring = np.concatenate([half(q, way + t), half(p, way + np.pi + t)])
    return np.concatenate([ring, ring[:1]])


def _strokes(g, d: float, quadrant: int) -> list[dict]:
    """Stadiums around every segment, discs around lone points."""
    s = _segments(g)
    s = s[(s[:, :2] != s[:, 2:]).any(1)]
    around = [_stadium(x[:2], x[2:], d, quadrant) for x in s]
    if not len(s):
        t = np.linspace(0, 2 * np.pi, 4 * quadrant + 1)
        around = [p + d * np.stack([np.cos(t), np.sin(t)], 1) for p in np.unique(_points(g), axis=0)]
    return [_geom("Polygon", g["crs"], [[r]]) for r in around]


def _outlines(paths: np.ndarray, d: np.ndarray, quadrant: int, closed: bool) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Offsets to the right of closed ways (rows of corners, the first not again), round where they turn left; None where it is not that simple.

    That is the union of stadiums around the sides as long as corners are whole steps of the circle's sides, as then those
    of two stadiums are the same. ``closed``: ways around convex polygons; else there and back along lines of one bend at most.
    """
    step = np.pi / 2 / quadrant
    side = np.roll(paths, -1, 1) - paths
    length = np.hypot(side[..., 0], side[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        way = side / length[..., None]
    before = np.roll(way, 1, 1)
    turn = np.arctan2(before[..., 0] * way[..., 1] - before[..., 1] * way[..., 0], (before * way).sum(-1))
    if not closed:  # the ends of a line are turned around
        ends = np.zeros(paths.shape[1], bool)
        ends[[0, paths.shape[1] // 2]] = True
        turn[:, ends] = np.pi
    steps = np.rint(np.nan_to_num(turn) / step).astype(np.int64)
    fits = (length > 0).all(1) & np.isfinite(turn).all(1) & (np.abs(turn - steps * step) < 1e-9).all(1) & np.isfinite(d) & (d > 0)
    if closed:
        fits &= (steps >= 0).all(1) & (steps.sum(1) == 4 * quadrant) & (steps < 2 * quadrant).all(1)
    else:
        fits &= (np.abs(steps[:, ~ends]) <= quadrant).all(1) & (length > d[:, None] * (1 + 1e-9)).all(1)
    normal, last = (np.stack([w[..., 1], -w[..., 0]], -1) for w in (way, before))
    out: list[np.ndarray | None] = [None] * len(paths)
    kinds, which = np.unique(steps, axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        rows = np.flatnonzero(fits & (which.ravel() == k))
        points = []
        for i, n in enumerate(kind.tolist() if len(rows) else ()):
            at, far, a, b = paths[rows, i], d[rows, None], last[rows, i], normal[rows, i]
            if n < 0:  # to the inside, the offsets of both sides meet
                points.append(at + far * (a + b) / (1 + (a * b).sum(1, keepdims=True)))
                continue
            for t in np.arange(n) * step:
                points.append(at + far * (a * np.cos(t) + np.stack([-a[:, 1], a[:, 0]], 1) * np.sin(t)))
            points.append(at + far * b)
        if points:
            for row, ring in zip(rows.tolist(), np.stack([*points, points[0]], 1)):
                out[row] = ring
    return fits, out


def rounded(shapes: list[dict | None], distances: list[float | None], quadrant: int) -> list[dict | None]:
    """Buffers whose outline is known without an arrangement, many at a time: of points, of lines with one bend at most, and of convex polygons; rectangles shrink as well."""
    out: list[dict | None] = [None] * len(shapes)
    groups: dict[tuple, list[int]] = {}
    for i, (g, d) in enumerate(zip(shapes, distances)):
        if g is None or not d or len(g["parts"]) != 1 or len(g["parts"][0]) != 1:
            continue
        r, dim = _rings(g)[0][0], _dim(g)
        n = len(r)
        if d > 0 and ((dim == 0 and n == 1) or (dim == 1 and 2 <= n <= 3)) or dim == 2 and 4 <= n <= 64 and (r[0] == r[-1]).all() and (d > 0 or n == 5):
            groups.setdefault((dim, n, d > 0), []).append(i)
    for (dim, n, grow), rows in groups.items():
        p, d = np.stack([_rings(shapes[i])[0][0] for i in rows]), np.abs(np.array([distances[i] for i in rows], float))
        if dim == 0:
            t = np.linspace(0, 2 * np.pi, 4 * quadrant + 1)
            found: list[np.ndarray | None] = list(p + d[:, None, None] * np.stack([np.cos(t), np.sin(t)], 1))
            for k in np.flatnonzero(~(np.isfinite(p).all((1, 2)) & np.isfinite(d))).tolist():
                found[k] = None
        elif dim == 1:
            found = _outlines(np.concatenate([p, p[:, -2:0:-1]], 1), d, quadrant, closed=False)[1]
        else:
            p = p[:, :-1]
            q = p - p[:, :1]
            double = (q[:, :, 0] * np.roll(q[:, :, 1], -1, 1) - q[:, :, 1] * np.roll(q[:, :, 0], -1, 1)).sum(1)
            p = np.where((double < 0)[:, None, None], p[:, ::-1], p)
            fits, found = _outlines(p, d, quadrant, closed=True)
            if not grow:
                found = [None] * len(rows)
                one, two = p[:, 1] - p[:, 0], p[:, 2] - p[:, 1]
                wide, high = np.hypot(*one.T), np.hypot(*two.T)
                # four corners of a quarter turn each are a rectangle
                square = fits & (np.abs((one * two).sum(1)) <= 1e-12 * wide * high) & (np.abs(p[:, 0] + p[:, 2] - p[:, 1] - p[:, 3]).max(1) <= 1e-12 * np.abs(p).max((1, 2)))
                for k in np.flatnonzero(square).tolist():
                    u, v = one[k] / wide[k] * d[k], two[k] / high[k] * d[k]
                    left = min(wide[k], high[k]) > 2 * d[k] + ONE * max(1.0, np.abs(p[k]).max())
                    found[k] = p[k, [0, 1, 2, 3, 0]] + np.array([u + v, v - u, -u - v, u - v, u + v]) if left else np.zeros((0, 2))
        for i, ring in zip(rows, found):
            if ring is not None:
                out[i] = _geom("Polygon", shapes[i]["crs"], [[ring]] if len(ring) else [])
    return out


def buffered(shapes: list[dict | None], distances: list[float | None], quadrant: int) -> list[dict | None]:
    """Each geometry grown by its distance, or, a polygon by a negative one, shrunk: the union with, or difference from, what lies that near its segments."""
    quick = rounded(shapes, distances, quadrant)
    there = [g if g is not None and d is not None and q is None else None for g, d, q in zip(shapes, distances, quick)]
    near = fold_all([_strokes(g, abs(d), quadrant) if g is not None and d and (d > 0 or _dim(g) == 2) else [] for g, d in zip(there, distances)], UNION)
    pairs_of = lambda grow: [(g, n) if g is not None and n is not None and _dim(g) == 2 and (d > 0) == grow else None for g, n, d in zip(there, near, distances)]
    grown, shrunk = (combine_all(pairs_of(grow), [op])[0] for grow, op in ((True, UNION), (False, DIFFERENCE)))
    out: list[dict | None] = []
    for g, d, n, more, less, q in zip(there, distances, near, grown, shrunk, quick):
        if q is not None:
            out.append(q)
        elif g is None or (_dim(g) == 2 and (not d or n is None)):
            out.append(g)
        elif _dim(g) == 2:
            out.append(more if d > 0 else less)
        else:
            out.append(n if d > 0 and n is not None else _geom("Polygon", g["crs"], []))
    return out


def buffer(g: Column, distance: float | Column, quadrant: int = 30) -> Column:
    """All places within a distance of a geometry, as polygons; round joins and caps of ``quadrant`` sides a quarter turn.

    A polygon shrinks by a negative distance, to no parts in the end, and stays as it is for 0; of lines and points only
    positive distances leave something. A null distance gives null.
    """

    @F.arrow_udf(TYPE)
    def run(g: pa.Array, d: pa.Array) -> pa.Array:
        return encode(buffered(decode(g), d.to_pylist(), quadrant))

    return run(whole(g), (distance if isinstance(distance, Column) else F.lit(distance)).cast("double"))


@later(f"array<{TYPE}>")
def _split(g: pa.Array, by: pa.Array) -> pa.Array:
    both = list(pairs(g, by))
    same = uncut(both)
    found = [None if p is None else [same[i]] if i in same else split_polygon(*p) if _dim(p[0]) == 2 else split_line(*p) for i, p in enumerate(both)]
    ends = np.cumsum([0] + [len(x or []) for x in found])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), encode([y for x in found for y in x or []]), mask=pa.array([x is None for x in found], pa.bool_()))


def split(g: Column, by: Column) -> Column:
    """Array of the pieces of a polygon or of lines, cut by lines."""
    return _split(whole(g), whole(by))


def chop_along_antimeridian(g: Column, crs, precision: float = 0.1) -> Column:
    """Pieces on each side of the antimeridian as one Multi geometry; the geometry itself where it does not meet it."""
    pieces = F.array_compact(split(g, Geo.line(projected_lon(crs, 180.0, step=precision), g["crs"])))
    single = F.regexp_replace(g["type"], "^Multi", "")
    return F.when(F.size(pieces) < 2, whole(g)).otherwise(whole(Geo.geometry(F.concat(F.lit("Multi"), single), F.flatten(F.transform(pieces, lambda p: p["parts"])), g["crs"])))


#: Polygons that one task merges at a time, and cells of a level that become one of the next, along each axis.
GROUP, FAN = 32, 2


def dissolve(df: DataFrame, geom: str, keys: list[str], cell: float, group: int = GROUP) -> DataFrame:
    """One row per key: the union of its polygons, as ``keys`` and ``geom``; rows without a polygon are left out.

    Polygons are dealt to the cell of their box's corner, and the polygons of a cell to as many hands as keep each under
    ``group``. Every round merges what shares a cell and a hand and then halves hands, or, where one is left everywhere, the
    cells' resolution; only what is still apart moves. So no task holds more than ``group`` operands, whatever key or cell is
    hot, and the rounds grow with the logarithm of the input. A key's result is one row, so the size of that is the data's.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    at = lambda k: F.floor(F.array_min(F.transform(Geo.vertices(F.col("_g")), lambda p: p[k])) / cell)
    # what repeats adds nothing, and would all fall to one hand
    t = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), whole(F.col(geom)).alias("_g")).filter(F.size("_g.parts") > 0).distinct()
    t = t.withColumns({"_y": at("y"), "_x": at("x")})
    place_of = [*names, "_y", "_x"]
    sizes = t.groupBy(*place_of).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n"), F.min("_y"), F.max("_y"), F.min("_x"), F.max("_x")).first()
    if most[0] is None:
        return df.select(*keys, whole(F.col(geom)).alias(geom)).limit(0)
    hands = -(-most[0] // group)
    if hands > 1:
        own = t.join(sizes.withColumnsRenamed({n: f"_s{n}" for n in place_of}), [F.col(n).eqNullSafe(F.col(f"_s{n}")) for n in place_of])
        t = own.select(*place_of, "_g", F.pmod(F.xxhash64("_g"), F.ceil(F.col("_n") / group)).alias("_h"))
    else:
        t = t.withColumn("_h", F.lit(0).cast("long"))
    span = max(most[2] - most[1], most[4] - most[3]) + 1
    while True:
        t = t.groupBy(*place_of, "_h").agg(unary_union(F.collect_list("_g")).alias("_g"))
        if hands > 1:
            t, hands = t.withColumn("_h", F.floor(F.col("_h") / group)), -(-hands // group)
        elif span > 1:
            t = t.withColumns({k: F.floor((F.col(k) - low) / FAN) + low for k, low in (("_y", most[1]), ("_x", most[3]))})
            span = -(-span // FAN)
        else:
            return t.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("_g").alias(geom))
