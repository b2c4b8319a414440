"""Overlay by area identities against a fine raster of points, and splitting."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.functions import geometry as Geo
from terrella.operators import kernels, overlay


def shape(*rings):
    return {"type": "Polygon", "crs": None, "parts": [[[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in rings]]}


def size(g):
    return sum(abs(overlay.signed_area(r)) * (1 if i == 0 else -1) for part in kernels._rings(g) for i, r in enumerate(part))


SQUARE = shape([(0, 0), (4, 0), (4, 4), (0, 4)])
RING = shape([(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)])
ELL = shape([(1, 1), (5, 1), (5, 3), (3, 3), (3, 5), (1, 5)])
COMB = shape([(-1, 1), (7, 1), (7, 5), (5, 5), (5, 2), (3, 2), (3, 5), (1, 5), (1, 2), (-1, 2)])
AWAY = shape([(9, 9), (10, 9), (10, 10)])
SLANT = shape([(2, -1), (5, 2), (2, 5), (-1, 2)])
EDGE = shape([(4, 0), (8, 0), (8, 4), (4, 4)])
INSIDE = shape([(1, 1), (2, 1), (2, 2), (1, 2)])
ALL = [SQUARE, RING, ELL, COMB, AWAY, SLANT, EDGE, INSIDE]


@pytest.mark.parametrize("i", range(len(ALL)))
@pytest.mark.parametrize("j", range(len(ALL)))
def test_areas(i, j):
    a, b = ALL[i], ALL[j]
    both = size(overlay.combine(a, b, overlay.INTERSECTION))
    assert size(overlay.combine(a, b, overlay.UNION)) == pytest.approx(size(a) + size(b) - both)
    assert size(overlay.combine(a, b, overlay.DIFFERENCE)) == pytest.approx(size(a) - both)
    assert size(overlay.combine(a, b, overlay.SYMMETRIC)) == pytest.approx(size(a) + size(b) - 2 * both)
    r = np.random.default_rng(7)
    p = r.uniform(-2, 11, (400, 2))
    ia, ib = (kernels.place(p, g) > 0 for g in (a, b))
    for rule, want in ((overlay.INTERSECTION, ia & ib), (overlay.UNION, ia | ib), (overlay.DIFFERENCE, ia & ~ib), (overlay.SYMMETRIC, ia ^ ib)):
        assert ((kernels.place(p, overlay.combine(a, b, rule)) > 0) == want).all()


def test_random_stars():
    r = np.random.default_rng(3)
    p = r.uniform(-2, 2, (300, 2))
    for _ in range(30):
        def star():
            n = int(r.integers(5, 12))
            t, d = np.sort(r.uniform(0, 2 * np.pi, n)), r.uniform(0.3, 1.5, n)
            return shape([*zip((d * np.cos(t) + r.uniform(-0.3, 0.3)).tolist(), (d * np.sin(t)).tolist())])
        a, b = star(), star()
        if not all(kernels.is_simple(kernels._rings(g)[0][0]) for g in (a, b)):
            continue
        ia, ib = (kernels.place(p, g) > 0 for g in (a, b))
        for rule, want in ((overlay.INTERSECTION, ia & ib), (overlay.UNION, ia | ib), (overlay.DIFFERENCE, ia & ~ib), (overlay.SYMMETRIC, ia ^ ib)):
            assert ((kernels.place(p, overlay.combine(a, b, rule)) > 0) == want).all()


def test_columns(spark):
    a, b = Geo.box(0, 0, 4, 4, "EPSG:3857"), Geo.box(2, 2, 6, 6, "EPSG:3857")
    cut = Geo.line([(-1, 1), (9, 1)], "EPSG:3857")
    wide = Geo.box(170, 0, 190, 10, "EPSG:4326")
    shapes = F.array(a, b, Geo.box(3, 3, 5, 5, "EPSG:3857"))
    row = spark.range(1).select(
        Geo.area(overlay.union(a, b)).alias("u"), Geo.area(overlay.difference(a, b)).alias("d"), Geo.area(overlay.unary_union(shapes)).alias("uu"),
        Geo.area(overlay.unary_intersection(shapes)).alias("ui"), F.transform(overlay.split(a, cut), Geo.area).alias("s"),
        overlay.chop_along_antimeridian(wide, 4326).alias("chop"), overlay.chop_along_antimeridian(Geo.box(0, 0, 5, 5, "EPSG:4326"), 4326)["type"].alias("same"),
        overlay.union(a, F.lit(None).cast(Geo.TYPE)).alias("none"), F.size(overlay.split(Geo.line([(0, 0), (4, 4)], "EPSG:3857"), cut)).alias("halves"),
    ).collect()[0]
    assert (row["u"], row["d"], row["uu"], row["ui"], sorted(row["s"])) == (28.0, 12.0, 28.0, 1.0, [4.0, 12.0])
    assert row["chop"]["type"] == "MultiPolygon" and len(row["chop"]["parts"]) == 2 and row["same"] == "Polygon"
    assert row["none"] is None or row["none"]["type"] is None
    assert row["halves"] == 2
    with pytest.raises(Exception, match="coordinate systems differ"):
        spark.range(1).select(overlay.union(a, wide).alias("u")).collect()


def test_meets_box(spark):
    """Against the relation of the same polygon and box, at random."""
    from terrella.functions import bbox as B

    r = np.random.default_rng(11)
    rows = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in np.concatenate([r.uniform(-3, 8, (150, 2)), r.uniform(0.1, 4, (150, 2))], 1)]
    boxes = spark.createDataFrame(rows, "l double, b double, r double, t double")
    for g in (RING, COMB, SLANT):
        lit = Geo.polygon([(p["x"], p["y"]) for p in g["parts"][0][0]], None, *([(p["x"], p["y"]) for p in ring] for ring in g["parts"][0][1:]))
        for row in boxes.select("*", Geo.meets_box(lit, B.bbox(F.col("l"), F.col("b"), F.col("r"), F.col("t"))).alias("m")).collect():
            box = shape([(row.l, row.b), (row.r, row.b), (row.r, row.t), (row.l, row.t)])
            assert row.m == (kernels.relation(g, box) != "disjoint")


def coast(n, phase, r):
    t = np.arange(n) * 2 * np.pi / n
    d = 1 + 0.1 * np.sin(9 * t + phase) + 0.02 * np.sin(211 * t) + 0.001 * r.uniform(-1, 1, n)
    return shape([*zip((phase + d * np.cos(t)).tolist(), (d * np.sin(t)).tolist())])


def test_many_vertices():
    """Two coasts of 20,000 vertices, and stars whose edges nearly all cross others: areas add up, in seconds."""
    r = np.random.default_rng(5)

    def star(n, at):
        t, d = np.sort(r.uniform(0, 2 * np.pi, n)), r.uniform(0.5, 1, n)
        return shape([*zip((at + d * np.cos(t)).tolist(), (d * np.sin(t)).tolist())])

    for a, b in ((coast(20_000, 0.0, r), coast(20_000, 0.1, r)), (star(2000, 0.0), star(2000, 0.1))):
        began = time.process_time()
        u, i, d, s = (size(g[0]) for g in overlay.combine_all([(a, b)], list(overlay.OPERATIONS.values())))
        assert time.process_time() - began < 20
        assert u == pytest.approx(size(a) + size(b) - i, rel=1e-9) and d == pytest.approx(size(a) - i, rel=1e-9) and s == pytest.approx(u - i, rel=1e-9)
        assert kernels.relation(a, b) == "overlaps" and kernels.relation(a, a) == "equals"


def test_pairs_at_once_equal_pairs_alone():
    found = [(a, b) for a in ALL for b in ALL]
    for op in overlay.OPERATIONS.values():
        together = overlay.combine_all([None, *found], [op])[0]
        assert together[0] is None
        for (a, b), g in zip(found, together[1:]):
            one = overlay.combine(a, b, op)
            assert g["type"] == one["type"] and sorted(r.tolist() for p in g["parts"] for r in p) == sorted(r.tolist() for p in one["parts"] for r in p)


def path(*points):
    return {"type": "LineString", "crs": None, "parts": [[[{"x": float(x), "y": float(y)} for x, y in points]]]}


def spots(*points):
    return {"type": "MultiPoint", "crs": None, "parts": [[[{"x": float(x), "y": float(y)}]] for x, y in points]}


def reach(g):
    return sum(float(np.hypot(*np.diff(r, axis=0).T).sum()) for part in kernels._rings(g) for r in part)


@pytest.mark.parametrize("op", ["union", "intersection", "difference", "symmetric"])
def test_lines_with_polygons(op):
    """Lengths inside and outside by fine steps along the line."""
    line = path((-1, 3), (7, 3), (7, 0.5), (2.5, 0.5), (2.5, 5))
    xy = kernels._rings(line)[0][0]
    steps = np.concatenate([a + (b - a) * ((np.arange(4000) + 0.5) / 4000)[:, None] for a, b in zip(xy, xy[1:])])
    weight = np.repeat(np.hypot(*np.diff(xy, axis=0).T) / 4000, 4000)
    for g in (SQUARE, RING, ELL, COMB, SLANT, AWAY):
        inside = weight[kernels.place(steps, g) >= 0].sum()
        points, lines, areas = overlay.apart(g, line, overlay.OPERATIONS[op])
        want = {"union": reach(line) - inside, "intersection": inside, "difference": 0, "symmetric": reach(line) - inside}[op]
        assert reach(lines) == pytest.approx(want, abs=0.01) and not points["parts"]
        assert size(areas) == pytest.approx(0 if op == "intersection" else size(g))
        points, lines, areas = overlay.apart(line, g, overlay.DIFFERENCE)
        assert reach(lines) == pytest.approx(reach(line) - inside, abs=0.01) and not areas["parts"]


def test_lines_and_points():
    a, b = path((0, 0), (4, 0), (4, 4)), path((2, 0), (6, 0))
    points, lines, _ = overlay.apart(a, b, overlay.INTERSECTION)
    assert reach(lines) == 2 and not points["parts"] and reach(overlay.combine(a, b, overlay.UNION)) == 10 and reach(overlay.combine(a, b, overlay.SYMMETRIC)) == 8
    points, lines, _ = overlay.apart(a, path((3, 1), (3, -1), (4, -1), (5, 3), (3, 3)), overlay.INTERSECTION)
    assert sorted(kernels._points(points).round(9).tolist()) == [[3, 0], [4, 3]] and not lines["parts"]
    p = spots((1, 1), (4, 4), (9, 9), (2, 0))
    inside = overlay.apart(SQUARE, p, overlay.INTERSECTION)[0]
    assert sorted(kernels._points(inside).tolist()) == [[1, 1], [2, 0], [4, 4]]
    assert kernels._points(overlay.apart(p, SQUARE, overlay.DIFFERENCE)[0]).tolist() == [[9, 9]]
    points, lines, areas = overlay.apart(SQUARE, p, overlay.UNION)
    assert kernels._points(points).tolist() == [[9, 9]] and size(areas) == 16
    assert sorted(kernels._points(overlay.combine(p, spots((9, 9), (0, 7)), overlay.SYMMETRIC)).tolist()) == [[0, 7], [1, 1], [2, 0], [4, 4]]


def test_touching_polygons_leave_a_line():
    points, lines, areas = overlay.apart(SQUARE, EDGE, overlay.INTERSECTION)
    assert reach(lines) == 4 and not points["parts"] and not areas["parts"]


def test_dissolve(spark):
    """A hot key and a hot cell, polygons that repeat, null keys and null polygons: areas by a raster of the boxes."""
    r = np.random.default_rng(2)
    rows = [(int(k) if k else None, float(x), float(y), float(w), float(h)) for k, x, y, w, h in zip(r.choice([0, 1, 1, 1, 1, 2], 400), r.integers(0, 60, 400), r.integers(0, 60, 400), r.integers(1, 6, 400), r.integers(1, 6, 400))]
    rows += [(1, float(x), float(y), 2.0, 3.0) for x, y in r.integers(0, 7, (120, 2))] + [(2, 5.0, 5.0, 3.0, 3.0)] * 200
    df = spark.createDataFrame(rows, "k int, x double, y double, w double, h double").withColumn("g", Geo.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    df = df.unionByName(df.limit(3).withColumn("g", F.lit(None).cast(Geo.TYPE)))
    got = {row["k"]: row["a"] for row in overlay.dissolve(df, "g", ["k"], 8.0, 16).select("k", Geo.area(F.col("g")).alias("a")).collect()}
    for k in (None, 1, 2):
        grid = np.zeros((80, 80), bool)
        for key, x, y, w, h in rows:
            if key == k:
                grid[int(y) : int(y + h), int(x) : int(x + w)] = True
        assert got[k] == pytest.approx(grid.sum())
    assert overlay.dissolve(df.limit(0), "g", ["k"], 8.0).count() == 0


@pytest.mark.parametrize("d", [-1.2, -0.4, 0.3, 1.0, 2.5])
def test_buffers_by_distance(d):
    """Places near enough, by their distance from the boundary; arcs of many sides leave a thin doubt."""
    r = np.random.default_rng(3)
    p = r.uniform(-4, 10, (3000, 2))
    for g in (SQUARE, RING, ELL, COMB, SLANT, path((0, 0), (4, 1), (2, 5), (2, 1)), path((1, 1), (1, 1)), spots((0, 0), (3, 3))):
        got = overlay.buffered([g], [d], 60)[0]
        s = kernels._segments(g) if kernels._dim(g) else np.concatenate([kernels._points(g)] * 2, 1)
        e, rel = s[:, 2:] - s[:, :2], p[:, None] - s[None, :, :2]
        t = np.clip((rel * e).sum(-1) / np.maximum((e**2).sum(1), 1e-300), 0, 1)
        away = np.sqrt(((rel - t[..., None] * e) ** 2).sum(-1)).min(1)
        inside = kernels.place(p, g) > 0 if kernels._dim(g) == 2 else np.zeros(len(p), bool)
        want = inside | (away < d) if d > 0 else inside & (away > -d)
        sure = np.abs(away - abs(d)) > 1e-3
        assert ((kernels.place(p, got) > 0) == want)[sure].all()
