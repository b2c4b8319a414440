"""Geometry kernels that need loops or sorting: NumPy over Arrow batches.

Relations cover points, lines and polygons of any shape; lines and polygons are decided by their arrangement (``topology``).
``intersection`` here is the fast way for polygons without holes of which one is convex, and raises for others; ``overlay``
has the general operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bbox as B
from ..functions import geometry as Geo
from ..functions.geometry import TYPE
from ..functions.scalar import let
from .shapes import decode, encode, later, pairs, whole
from .topology import ON, Arrangement, meeting_pairs, meetings, winding_inside

Ring = np.ndarray


def _rings(g) -> list[list[Ring]]:
    """Rings as arrays; those of a plain row's vertices are converted."""
    return [[ring if isinstance(ring, np.ndarray) else np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in part] for part in g["parts"]]


def _segments(g) -> np.ndarray:
    out = [np.concatenate([r[:-1], r[1:]], 1) for part in _rings(g) for r in part if len(r) > 1]
    return np.concatenate(out) if out else np.zeros((0, 4))


def signed_area(r: np.ndarray) -> float:
    q = r - r[0]
    return float((q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum() / 2)


def oriented(g) -> np.ndarray:
    """Edges with the interior to the left: outer rings counter-clockwise, holes clockwise."""
    out = [np.zeros((0, 4))]
    for part in _rings(g):
        for i, r in enumerate(part):
            if len(r) > 3:
                r = r if (signed_area(r) > 0) == (i == 0) else r[::-1]
                out.append(np.concatenate([r[:-1], r[1:]], 1))
    return np.concatenate(out)


def arrangements(found: list[tuple[dict, dict]]) -> Arrangement:
    """One arrangement of many pairs, a group each; all pairs of the same dimensions, and no point sets."""
    areal = tuple(_dim(g) == 2 for g in found[0])
    sides = []
    for k, area in enumerate(areal):
        each = [oriented(p[k]) if area else _segments(p[k]) for p in found]
        s, g = np.concatenate(each), np.repeat(np.arange(len(found)), [len(e) for e in each])
        real = (s[:, :2] != s[:, 2:]).any(1)
        sides.append((s[real], g[real]))
    (s, gs), (t, gt) = sides
    return Arrangement(s, t, areal, np.array([_reach(*p) / ON for p in found]), gs, gt)


def arrangement(a, b) -> Arrangement:
    return arrangements([(a, b)])


def in_batches(found: list, most: int = 20_000):
    """Numbers of the pairs that are there, in runs of the same dimensions and a bounded number of vertices."""
    run, size, kind = [], 0, None
    for i, p in enumerate(found):
        if p is None:
            continue
        n, k = sum(len(r) for g in p for part in g["parts"] for r in part), (_dim(p[0]), _dim(p[1]))
        if run and (k != kind or size + n > most):
            yield run
            run, size = [], 0
        run.append(i)
        size, kind = size + n, k
    if run:
        yield run


def _orient(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def hits(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether each segment of s meets the one of t beside it."""
    p, q, u, v = s[:, :2], s[:, 2:], t[:, :2], t[:, 2:]
    o1, o2, o3, o4 = _orient(p, q, u), _orient(p, q, v), _orient(u, v, p), _orient(u, v, q)

    def on(a, b, c, o):
        return (o == 0) & (np.minimum(a, b) <= c).all(-1) & (c <= np.maximum(a, b)).all(-1)

    return (o1 * o2 < 0) & (o3 * o4 < 0) | on(p, q, u, o1) | on(p, q, v, o2) | on(u, v, p, o3) | on(u, v, q, o4)


def _reach(*geometries) -> float:
    """Distance below which places count as equal: rounding of coordinates of this size."""
    points = np.concatenate([_points(g) for g in geometries])
    return 1e-12 * max(1.0, float(np.abs(points).max(initial=0)))


def _near(points: np.ndarray, s: np.ndarray, eps: float) -> np.ndarray:
    """Whether each point is on each segment, points down, segments across."""
    d = s[:, 2:] - s[:, :2]
    length = np.maximum((d**2).sum(1), 1e-300)
    rel = points[:, None] - s[None, :, :2]
    t = np.clip((rel * d).sum(-1) / length, 0, 1)
    return ((rel - t[..., None] * d) ** 2).sum(-1) <= eps * eps


def near_any(points: np.ndarray, s: np.ndarray, eps: float) -> np.ndarray:
    """Whether each point is on any segment: one that is meets it, as a segment without length."""
    out = np.zeros(len(points), bool)
    block = max(1, 500_000 // max(len(s), 1))
    for k in range(0, len(points) if len(s) else 0, block):
        out[k : k + block] = _near(points[k : k + block], s, eps).any(1)
    return out


def place(points: np.ndarray, g, eps: float | None = None) -> np.ndarray:
    """Of each point: 1 inside the polygon, 0 on its boundary, -1 outside; in blocks, so that memory is bounded."""
    s = _segments(g)
    if not len(s) or not len(points):
        return np.full(len(points), -1)
    return np.where(near_any(points, s, _reach(g) if eps is None else eps), 0, np.where(winding_inside(points, s), 1, -1))


def members(points: np.ndarray, g, eps: float) -> np.ndarray:
    """Whether points belong to a geometry."""
    if _dim(g) == 2:
        return place(points, g, eps) >= 0
    if _dim(g) == 1:
        return near_any(points, _segments(g), eps)
    own = {tuple(p) for p in _points(g).tolist()}
    return np.array([tuple(p) in own for p in points.tolist()], bool)


def _points(g) -> np.ndarray:
    r = [r for part in _rings(g) for r in part]
    return np.concatenate(r) if r else np.zeros((0, 2))


def _dim(g) -> int:
    return 2 if g["type"].endswith("Polygon") else 1 if g["type"].endswith("LineString") else 0


def cut(s: np.ndarray, t: np.ndarray, eps: float) -> np.ndarray:
    """The segments s, cut wherever they meet a segment of t, in their order and along each."""
    s = s[(s[:, :2] != s[:, 2:]).any(1)]
    (seg, at, point), _, new = meetings(s, t, eps)
    points = np.concatenate([s.reshape(-1, 2), t.reshape(-1, 2), new])
    n = np.arange(len(s))
    seg, at, point = np.concatenate([seg, n, n]), np.concatenate([at, np.zeros(len(s)), np.ones(len(s))]), np.concatenate([point, 2 * n, 2 * n + 1])
    order = np.lexsort((at, seg))
    # a place within rounding of the last one kept is the same; the ends are kept
    seg, xy = seg[order], points[point[order]]
    fresh = np.ones(len(seg), bool)
    fresh[1:] = (seg[1:] != seg[:-1]) | (((xy[1:] - xy[:-1]) ** 2).sum(1) > eps * eps)
    seg, xy = seg[fresh], xy[fresh]
    step = seg[1:] == seg[:-1]
    return np.concatenate([xy[:-1][step], xy[1:][step]], 1)


def _line_ends(g) -> np.ndarray:
    """The boundary of lines: ends that an odd number of them has."""
    ends: dict[tuple, int] = {}
    for part in _rings(g):
        for r in part:
            if len(r):
                for p in (tuple(r[0]), tuple(r[-1])):
                    ends[p] = ends.get(p, 0) + 1
    return np.array([p for p, n in ends.items() if n % 2]).reshape(-1, 2)


def relation(a, b) -> str:
    """disjoint, touches, equals, within, contains, overlaps or crosses."""
    va, vb = _points(a), _points(b)
    if not len(va) or not len(vb):
        return "disjoint"
    da, db = _dim(a), _dim(b)
    if da < db:
        r = relation(b, a)
        return {"within": "contains", "contains": "within"}.get(r, r)
    if db == 0:
        return _relation_to_points(a, b, va, vb)
    if da == 2 and db == 2:
        return _areal_relations([(a, b)])[0]
    r = arrangement(a, b)
    meet = r.common_nodes()
    if da == 2:
        left, right = r.left[0][r.on[1]], r.right[0][r.on[1]]
        if not (left & right).any():
            return "touches" if len(meet) else "disjoint"
        return "contains" if (left | right).all() else "crosses"
    if (r.on[0] & r.on[1]).any():
        a_in, b_in = r.on[1][r.on[0]].all(), r.on[0][r.on[1]].all()
        return "equals" if a_in and b_in else "contains" if b_in else "within" if a_in else "overlaps"
    # they meet at nodes alone: a crossing, if one of these is an end of neither
    inner = [n[meet] % 2 == 0 for n in r.ends]
    return "disjoint" if not len(meet) else "crosses" if (inner[0] & inner[1]).any() else "touches"


def _areal_relations(found: list[tuple[dict, dict]]) -> list[str]:
    """Of pairs of polygons: every face of either has an edge, and what lies beside the edges decides."""
    r = arrangements(found)
    a, b = (np.concatenate([r.left[i], r.right[i]]) for i in (0, 1))
    group = np.concatenate([r.group, r.group])
    some = lambda m: np.bincount(group[m], minlength=len(found)) > 0
    inner, a_out, b_out = some(a & b), some(a & ~b), some(b & ~a)
    meet = np.bincount(r.node_group[r.common_nodes()], minlength=len(found)) > 0
    names = np.select([~inner & ~meet, ~inner, a_out & b_out, a_out, b_out], ["disjoint", "touches", "overlaps", "contains", "within"], "equals")
    return names.tolist()


def _relation_to_points(a, b, va: np.ndarray, vb: np.ndarray) -> str:
    eps = _reach(a, b)
    if _dim(a) == 2:
        spots = place(vb, a, eps)
        if not (spots > 0).any():
            return "touches" if (spots == 0).any() else "disjoint"
        return "crosses" if (spots < 0).any() else "contains"
    if _dim(a) == 1:
        on = near_any(vb, _segments(a), eps)
        ends = _line_ends(a)
        inner = on & ~(np.abs(vb[:, None] - ends[None]).max(-1) <= eps).any(1) if len(ends) else on
        return "disjoint" if not on.any() else "touches" if not inner.any() else "contains" if on.all() else "crosses"
    pa_, pb = {tuple(p) for p in va.tolist()}, {tuple(p) for p in vb.tolist()}
    return "equals" if pa_ == pb else "contains" if pa_ > pb else "within" if pa_ < pb else "overlaps" if pa_ & pb else "disjoint"


def covered(a, b) -> bool:
    """Whether no point of b is outside a; unlike containment, b may lie in a's boundary."""
    if not len(_points(a)) or not len(_points(b)) or _dim(a) < _dim(b):
        return False
    if _dim(b) == 0:
        return bool(members(_points(b), a, _reach(a, b)).all())
    r = arrangement(a, b)
    return bool(r.member(0)[r.on[1]].all()) if _dim(b) == 1 else not (r.left[1] & ~r.left[0] | r.right[1] & ~r.right[0]).any()


def _extent(g) -> tuple[float, float, float, float, bool] | None:
    """Bounding box, and whether the polygon fills it."""
    p = _points(g)
    if not len(p):
        return None
    (x0, y0), (x1, y1) = p.min(0).tolist(), p.max(0).tolist()
    full = g["type"] == "Polygon" and len(p) == 5 and len(g["parts"][0]) == 1 and x0 < x1 and y0 < y1
    if full:
        d = np.diff(p, axis=0) == 0
        full = bool(((p == (x0, y0)) | (p == (x1, y1))).all()) and bool((d[:, 0] != d[:, 1]).all())
    return x0, y0, x1, y1, full


def _by_boxes(a, b) -> str | None:
    """The relation where bounding boxes decide it: of boxes apart, and of rectangles."""
    p, q = _extent(a), _extent(b)
    if not p or not q or p[0] > q[2] or q[0] > p[2] or p[1] > q[3] or q[1] > p[3]:
        return "disjoint"
    if not (p[4] and q[4]):
        return None
    if not (p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]):
        return "touches"
    out, in_ = (x[0] <= y[0] and x[1] <= y[1] and x[2] >= y[2] and x[3] >= y[3] for x, y in ((p, q), (q, p)))
    return "equals" if out and in_ else "contains" if out else "within" if in_ else "overlaps"


@later("string")
def _relation(a: pa.Array, b: pa.Array) -> pa.Array:
    found = list(pairs(a, b))
    out = [None if p is None else _by_boxes(*p) for p in found]
    todo = [p if r is None else None for p, r in zip(found, out)]
    for run in in_batches(todo):
        batch = [todo[i] for i in run]
        areal = all(_dim(g) == 2 for g in batch[0])
        for i, r in zip(run, _areal_relations(batch) if areal else [relation(*p) for p in batch]):
            out[i] = r
    return pa.array(out, pa.string())


@later("boolean")
def _covered(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if p is None else covered(*p) for p in pairs(a, b)], pa.bool_())


def _is_rectangle(g: Column, box: Column) -> Column:
    """Whether a polygon fills its bounding box."""
    ring = g["parts"][0][0]
    corner = lambda p: p["x"].isin(box["left"], box["right"]) & p["y"].isin(box["bottom"], box["top"])
    straight = F.forall(Geo.edges(g), lambda e: (e["p"]["x"] == e["q"]["x"]) != (e["p"]["y"] == e["q"]["y"]))
    shape = (g["type"] == "Polygon") & (F.size(g["parts"]) == 1) & (F.size(g["parts"][0]) == 1) & (F.size(ring) == 5)
    return shape & (box["left"] < box["right"]) & (box["bottom"] < box["top"]) & F.forall(ring, corner) & straight


def relate(a: Column, b: Column) -> Column:
    """The relation's name; an error where the coordinate systems differ. Of many rectangles, or boxes apart, ``with_relation`` is faster."""
    return _relation(whole(a), whole(b))


def with_relation(df: DataFrame, a: str, b: str, name: str = "relation") -> DataFrame:
    """``df`` with the relation of two geometry columns. Boxes apart and rectangles are decided by columns first; the kernel gets nulls for these.

    The decision is a column of its own: functions of arrays inside a kernel's arguments would keep it from being used in filters.
    """
    facts = lambda g: let(Geo.boundingbox(g), lambda box: F.struct(box.alias("box"), F.coalesce(_is_rectangle(g, box), F.lit(False)).alias("full")))

    def decide(p: Column) -> Column:
        x, y, full = p["x"]["box"], p["y"]["box"], p["x"]["full"] & p["y"]["full"]
        return F.when(~F.coalesce(B.overlaps(x, y), F.lit(False)), "disjoint").when(full, B.relation(x, y))

    x, y = F.col(a), F.col(b)
    given = x.isNotNull() & y.isNotNull() & x["type"].isNotNull() & y["type"].isNotNull()
    agree = F.when(given & ~x["crs"].eqNullSafe(y["crs"]), F.raise_error(F.lit("CRSMismatch: the geometries' coordinate systems differ")).cast("string"))
    t = df.withColumn("_quick", F.when(given, F.coalesce(agree, let(F.struct(facts(x).alias("x"), facts(y).alias("y")), decide))))
    none, todo = F.lit(None).cast(TYPE), given & F.col("_quick").isNull()
    return t.withColumn(name, F.coalesce("_quick", _relation(F.when(todo, whole(x)).otherwise(none), F.when(todo, whole(y)).otherwise(none)))).drop("_quick")


def intersects(a: Column, b: Column) -> Column:
    return relate(a, b) != "disjoint"


def disjoint(a: Column, b: Column) -> Column:
    return relate(a, b) == "disjoint"


def touches(a: Column, b: Column) -> Column:
    return relate(a, b) == "touches"


def contains(a: Column, b: Column) -> Column:
    return relate(a, b).isin("contains", "equals")


def covers(a: Column, b: Column) -> Column:
    """Whether no point of b is outside a; unlike ``contains``, of a line in a polygon's boundary as well."""
    return _covered(whole(a), whole(b))


def within(a: Column, b: Column) -> Column:
    return relate(a, b).isin("within", "equals")


def overlaps(a: Column, b: Column) -> Column:
    return relate(a, b) == "overlaps"


def crosses(a: Column, b: Column) -> Column:
    return relate(a, b) == "crosses"


def interiors_intersect(a: Column, b: Column) -> Column:
    return ~relate(a, b).isin("disjoint", "touches")


def hull(points: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise hull by monotone chain."""
    pts = np.unique(points[np.isfinite(points).all(1)], axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = np.array(half(pts)[:-1] + half(pts[::-1])[:-1])
    return np.concatenate([ring, ring[:1]])


def rim(points: np.ndarray) -> np.ndarray:
    """Of many points a few that have the same hull: none that lies inside the polygon of those farthest in 32 directions."""
    if len(points) < 64:
        return points
    t = np.arange(32) * (np.pi / 16)
    ways = np.stack([np.cos(t), np.sin(t)])
    far = points[np.unique((points @ ways).argmax(0))]
    ring = hull(far)
    if len(ring) < 4:
        return points
    d = np.diff(ring, axis=0)
    # by how much a point is inside the edge that it is least inside of; what rounding could put there stays
    depth = np.min([e[0] * (points[:, 1] - p[1]) - e[1] * (points[:, 0] - p[0]) for p, e in zip(ring, d)], axis=0)
    eps = 1e-12 * np.abs(points).max() * np.abs(d).max()
    return points[depth <= eps]


#: Points that a task keeps before it reduces them to hulls.
HELD = 200_000


def convex_hulls(df: DataFrame, key: str, x: str, y: str, name: str = "hull") -> DataFrame:
    """One row per key: the hull of its points, as ``key`` and ``name``. Every task reduces its points to hulls, so only hulls meet."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def thin(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            coded = t["k"].combine_chunks().dictionary_encode(null_encoding="encode")
            code, xy = coded.indices.to_numpy(), np.stack([t[n].to_numpy() for n in "xy"], 1)
            order = np.argsort(code, kind="stable")
            kept, starts = [], np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            for a, b in zip(starts, starts[1:]):
                p = xy[order[a:b]]
                p = p[np.isfinite(p).all(1)]
                found = hull(rim(p)) if len(p) > 8 else p
                kept.append(found if len(found) else np.full((1, 2), np.nan))  # a key without a place stays a key
            flat = np.concatenate(kept)
            keys = coded.dictionary.take(pa.array(np.repeat(np.arange(len(kept)), [len(p) for p in kept])))
            return pa.record_batch([keys, *(pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1))], names=list("kxy"))

        held: list[pa.RecordBatch] = []
        size = least = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            # what one reduction leaves, as of ever new keys, must not be reduced again with every batch
            if size > max(HELD, 2 * least):
                held = [thin(held)]
                size = least = held[0].num_rows
                if least > HELD:
                    yield held.pop()
                    size = least = 0
        if held:
            yield thin(held)

    points = df.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"))))
    found = points.mapInArrow(reduced, points.schema)
    m = Geo.geometry("MultiPoint", F.collect_list(F.array(F.array(Geo.vertex(F.col("x"), F.col("y"))))))
    return found.groupBy(F.col("k").alias(key)).agg(m.alias("_m")).select(key, convex_hull("_m").alias(name))


def simplify_ring(r: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker with a stack."""
    keep = np.zeros(len(r), bool)
    keep[[0, -1]] = True
    if len(r) > 3 and (r[0] == r[-1]).all():
        keep[int(((r - r[0]) ** 2).sum(1).argmax())] = True
    marks = np.flatnonzero(keep)
    stack = list(zip(marks[:-1].tolist(), marks[1:].tolist()))
    while stack:
        i, j = stack.pop()
        if j < i + 2:
            continue
        d, p = r[j] - r[i], r[i + 1 : j] - r[i]
        n = d @ d
        t = np.clip(p @ d / n, 0, 1) if n else np.zeros(len(p))
        away = ((p - t[:, None] * d) ** 2).sum(1)
        k = int(away.argmax())
        if away[k] > tol * tol:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return r[keep]


def is_simple(r: np.ndarray) -> bool:
    """No two edges meet but neighbours at their common vertex."""
    s = np.concatenate([r[:-1], r[1:]], 1)
    i, j = meeting_pairs(s, s, 0.0)
    apart = (i + 1 < j) & ~((i == 0) & (j == len(s) - 1) & bool((r[0] == r[-1]).all()))
    return not hits(s[i[apart]], s[j[apart]]).any()


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a ring inside a convex ring, edge by edge."""
    def turn(r):
        return r if ((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() >= 0) else r[::-1]

    out, w = turn(subject)[:-1], turn(window)
    for a, b in zip(w[:-1], w[1:]):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, ns = np.roll(out, -1, 0), np.roll(side, -1)
        new = []
        for p, q, s, t in zip(out, nxt, side, ns):
            if s >= 0:
                new.append(p)
            if s * t < 0:
                new.append(p + (q - p) * (s / (s - t)))
        out = np.array(new).reshape(-1, 2)
    return np.concatenate([out, out[:1]]) if len(out) else out


def is_convex(r: np.ndarray) -> bool:
    d = np.diff(r, axis=0)
    c = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    return bool((c >= 0).all() or (c <= 0).all())


class _Edge:
    """A directed edge; ``onext`` and ``oprev`` are its neighbours around its origin."""

    __slots__ = ("org", "dest", "onext", "oprev", "sym", "gone")

    def __init__(self, org: int, dest: int):
        self.org, self.dest, self.gone = org, dest, False
        self.onext = self.oprev = self


class _Places:
    """Exact signs for points of doubles: by floating point where its error cannot matter, else in whole numbers."""

    def __init__(self, p: np.ndarray):
        self.x, self.y = p[:, 0].tolist(), p[:, 1].tolist()
        self._whole: tuple[list[int], list[int]] | None = None

    def whole(self) -> tuple[list[int], list[int]]:
        if self._whole is None:
            ratios = [[v.as_integer_ratio() for v in axis] for axis in (self.x, self.y)]
            unit = max(d for axis in ratios for _, d in axis)  # powers of two
            self._whole = tuple([n * (unit // d) for n, d in axis] for axis in ratios)
        return self._whole

    def turn(self, p: int, a: int, b: int) -> int:
        """1 where p lies left of the way from a to b, -1 right, 0 on its line."""
        x, y = self.x, self.y
        s, t = (x[a] - x[p]) * (y[b] - y[p]), (y[a] - y[p]) * (x[b] - x[p])
        if abs(s - t) <= 1e-15 * (abs(s) + abs(t)):
            x, y = self.whole()
            s, t = (x[a] - x[p]) * (y[b] - y[p]), (y[a] - y[p]) * (x[b] - x[p])
        return (s > t) - (s < t)

    def in_circle(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether d lies within the circle of a, b and c, which turn right."""
        for exact in (False, True):
            x, y = self.whole() if exact else (self.x, self.y)
            ax, ay, bx, by, cx, cy = x[a] - x[d], y[a] - y[d], x[b] - x[d], y[b] - y[d], x[c] - x[d], y[c] - y[d]
            al, bl, cl = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            det = al * (bx * cy - cx * by) + bl * (cx * ay - ax * cy) + cl * (ax * by - bx * ay)
            if exact or abs(det) > 4e-15 * (al * (abs(bx * cy) + abs(cx * by)) + bl * (abs(cx * ay) + abs(ax * cy)) + cl * (abs(ax * by) + abs(bx * ay))):
                break
        return det < 0


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of the distinct points, by divide and conquer (Guibas and Stolfi); places that are the same go by their first number."""
    p = np.asarray(points, float).reshape(-1, 2)
    at = np.flatnonzero(np.isfinite(p).all(1))
    p, first = np.unique(p[at] + 0.0, axis=0, return_index=True)
    if len(p) < 3:
        return []
    places, edges = _Places(p), []
    turn, in_circle = places.turn, places.in_circle

    def make(org: int, dest: int) -> _Edge:
        e, back = _Edge(org, dest), _Edge(dest, org)
        e.sym, back.sym = back, e
        edges.extend((e, back))
        return e

    def splice(a: _Edge, b: _Edge) -> None:
        a.onext.oprev, b.onext.oprev = b, a
        a.onext, b.onext = b.onext, a.onext

    def connect(a: _Edge, b: _Edge) -> _Edge:
        e = make(a.dest, b.org)
        splice(e, a.sym.oprev)
        splice(e.sym, b)
        return e

    def drop(e: _Edge) -> None:
        splice(e, e.oprev)
        splice(e.sym, e.sym.oprev)
        e.gone = e.sym.gone = True

    def build(lo: int, hi: int) -> tuple[_Edge, _Edge]:
        """Of points lo to hi, in order of x and y, the edges of the hull that leave the first and the last."""
        if hi - lo == 2:
            a = make(lo, lo + 1)
            return a, a.sym
        if hi - lo == 3:
            a, b = make(lo, lo + 1), make(lo + 1, lo + 2)
            splice(a.sym, b)
            side = turn(lo + 2, lo, lo + 1)
            if side < 0:
                c = connect(b, a)
                return c.sym, c
            if side > 0:
                connect(b, a)
            return a, b.sym
        mid = (lo + hi + 1) // 2
        (ldo, ldi), (rdi, rdo) = build(lo, mid), build(mid, hi)
        while True:
            if turn(rdi.org, ldi.org, ldi.dest) > 0:
                ldi = ldi.sym.onext
            elif turn(ldi.org, rdi.org, rdi.dest) < 0:
                rdi = rdi.sym.oprev
            else:
                break
        base = connect(ldi.sym, rdi)
        if ldi.org == ldo.org:
            ldo = base
        if rdi.org == rdo.org:
            rdo = base.sym
        above = lambda e: turn(e.dest, base.org, base.dest) > 0
        while True:
            right, left = base.sym.onext, base.oprev
            on_right, on_left = above(right), above(left)
            if not (on_right or on_left):
                return ldo, rdo
            if on_right:
                while above(right.onext) and in_circle(base.dest, base.org, right.dest, right.onext.dest):
                    following = right.onext
                    drop(right)
                    right = following
            if on_left:
                while above(left.oprev) and in_circle(base.dest, base.org, left.dest, left.oprev.dest):
                    following = left.oprev
                    drop(left)
                    left = following
            if not on_right or (on_left and in_circle(right.dest, right.org, left.org, left.dest)):
                base = connect(left, base.sym)
            else:
                base = connect(base.sym, right.sym)

    build(0, len(p))
    name, out = at[first].tolist(), set()
    for e in edges:
        if not e.gone:
            f = e.sym.onext
            if f.sym.onext.dest == e.org and f.sym.onext.sym.onext is e and turn(f.dest, e.org, e.dest) > 0:
                out.add(tuple(sorted((name[e.org], name[e.dest], name[f.dest]))))
    return sorted(out)


def _geom(kind: str, crs, rings: list[list[np.ndarray]]) -> dict:
    return {"type": kind, "crs": crs, "parts": rings}


def _mapped(column: pa.Array, f) -> pa.Array:
    return encode([None if g is None else f(g) for g in decode(column)])


@later(TYPE)
def _convex_hull(g: pa.Array) -> pa.Array:
    return _mapped(g, lambda x: _geom("Polygon", x["crs"], [[hull(_points(x))]]))


def convex_hull(g: Column | str) -> Column:
    return _convex_hull(whole(F.col(g) if isinstance(g, str) else g))


def simplify(g: Column, tolerance: float) -> Column:
    """Douglas-Peucker by ring; a polygon's ring that would collapse stays as it was."""

    def thin(x):
        least = 4 if x["type"].endswith("Polygon") else 2
        ring = lambda r: s if len(s := simplify_ring(r, tolerance)) >= least else r
        return _geom(x["type"], x["crs"], [[ring(r) for r in part] if _dim(x) else part for part in _rings(x)])

    @F.arrow_udf(TYPE)
    def run(g: pa.Array) -> pa.Array:
        return _mapped(g, thin)

    return run(whole(g))


@later("boolean")
def _is_valid(g: pa.Array) -> pa.Array:
    def ok(x) -> bool:
        rings = [r for part in _rings(x) for r in part]
        if not all(np.isfinite(r).all() for r in rings):
            return False
        return not x["type"].endswith("Polygon") or all(len(r) >= 4 and (r[0] == r[-1]).all() and is_simple(r) for r in rings)

    return pa.array([None if x is None else ok(x) for x in decode(g)], pa.bool_())


def is_valid(g: Column | str) -> Column:
    """Finite, rings closed and simple."""
    return _is_valid(whole(F.col(g) if isinstance(g, str) else g))


@later(TYPE)
def _clipped(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for p in pairs(a, b):
        if p is None:
            out.append(None)
            continue
        x, y = p
        (rx,), (ry,) = _rings(x)[0], _rings(y)[0]
        if len(_rings(x)) > 1 or len(_rings(y)) > 1 or not (is_convex(rx) or is_convex(ry)):
            raise NotImplementedError("intersection of general polygons")
        ring = clip_convex(rx, ry) if is_convex(ry) else clip_convex(ry, rx)
        out.append(_geom("Polygon", x["crs"], [[ring]] if len(ring) else []))
    return encode(out)


def intersection(a: Column, b: Column) -> Column:
    """Of two polygons without holes, at least one convex."""
    return _clipped(whole(a), whole(b))


@later("array<struct<a:int,b:int,c:int>>")
def _triangulate(g: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [{"a": a, "b": b, "c": c} for a, b, c in delaunay(_points(x))] for x in decode(g)], pa.list_(pa.struct([(k, pa.int32()) for k in "abc"])))


def triangulate(g: Column | str) -> Column:
    """Delaunay triangles as vertex numbers."""
    return _triangulate(whole(F.col(g) if isinstance(g, str) else g))


def buffer_points(g: Column, distance: float, quadrant: int = 30) -> Column:
    """Disc around each vertex, as polygons of 4 * quadrant sides."""
    t = np.linspace(0, -2 * np.pi, 4 * quadrant + 1)
    ring = distance * np.stack([np.cos(t), np.sin(t)], 1)

    @F.arrow_udf(TYPE)
    def run(g: pa.Array) -> pa.Array:
        return _mapped(g, lambda x: _geom("Polygon" if len(_points(x)) == 1 else "MultiPolygon", x["crs"], [[p + ring] for p in _points(x)]))

    return run(whole(g))
