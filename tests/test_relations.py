"""Geometry predicates against known answers, and tile indices at tile edges."""

import pytest
from pyspark.sql import functions as F

from terrella.functions import crs as C
from terrella.functions import geometry as Geo
from terrella.operators import kernels, tiles


def polygon(*rings):
    return {"type": "Polygon", "parts": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]}


def line(*points):
    return {"type": "LineString", "parts": [[[{"x": float(x), "y": float(y)} for x, y in points]]]}


SQUARE = polygon([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
NOTCHED = polygon([(0, 0), (4, 0), (4, 4), (2.1, 4), (2, 3.9), (1.9, 4), (0, 4), (0, 0)])
FRAME = polygon([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)])
FILL = polygon([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)])
BACK = {"contains": "within", "within": "contains"}


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (SQUARE, NOTCHED, "contains"), (SQUARE, SQUARE, "equals"), (FRAME, FILL, "touches"), (SQUARE, FRAME, "contains"), (SQUARE, FILL, "contains"),
        (FRAME, polygon([(1.5, 1.5), (2, 1.5), (2, 2), (1.5, 2), (1.5, 1.5)]), "disjoint"), (SQUARE, polygon([(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)]), "touches"),
        (SQUARE, polygon([(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]), "overlaps"), (SQUARE, polygon([(4, 4), (5, 4), (5, 5), (4, 5), (4, 4)]), "touches"),
        (line((0, 0), (4, 0)), line((1, 0), (3, 0)), "contains"), (line((0, 0), (4, 0)), line((2, 0), (6, 0)), "overlaps"), (line((0, 0), (4, 0)), line((2, -1), (2, 1)), "crosses"),
        (line((0, 0), (4, 0)), line((2, 0), (2, 1)), "touches"), (line((0, 0), (2, 0), (4, 0)), line((2, -1), (2, 0), (2, 1)), "crosses"), (line((0, 0), (4, 0)), line((4, 0), (0, 0)), "equals"),
        (SQUARE, line((1, 1), (2, 2)), "contains"), (SQUARE, line((0, 0), (4, 0)), "touches"), (SQUARE, line((-1, 2), (5, 2)), "crosses"), (SQUARE, line((5, 5), (6, 6)), "disjoint"),
    ],
)
def test_relation(a, b, want):
    assert kernels.relation(a, b) == want and kernels.relation(b, a) == BACK.get(want, want)


def test_covers_includes_the_boundary():
    edge = line((0, 0), (4, 0))
    assert kernels.covered(SQUARE, edge) and kernels.relation(SQUARE, edge) == "touches"
    assert not kernels.covered(SQUARE, line((0, 0), (5, 0))) and kernels.covered(SQUARE, NOTCHED) and not kernels.covered(NOTCHED, SQUARE)


def test_rectangles_need_no_kernel(spark):
    """Closed forms and the kernel agree on rectangles, equal and degenerate ones among them."""
    boxes = [(0, 0, 4, 4), (4, 0, 8, 4), (1, 1, 3, 3), (0, 0, 4, 4), (2, 2, 6, 6), (9, 9, 10, 10), (0, 0, 4, 2), (4, 4, 5, 5)]
    rows = [(*map(float, a), *map(float, b)) for a in boxes for b in boxes]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    x, y = Geo.box(*map(F.col, "abcd")), Geo.box(*map(F.col, "efgh"))
    for r in df.select("*", kernels.relate(x, y).alias("rel")).collect():
        corner = lambda q: polygon([(q[0], q[1]), (q[2], q[1]), (q[2], q[3]), (q[0], q[3]), (q[0], q[1])])
        assert r["rel"] == kernels.relation(corner(r[:4]), corner(r[4:8]))


def test_relations_in_columns_and_filters(spark):
    """By columns first, by the kernel alone, and in a filter: the same; rectangles, slanted shapes, nulls."""
    boxes = [(0, 0, 4, 4), (4, 0, 8, 4), (1, 1, 3, 3), (9, 9, 10, 10)]
    df = spark.createDataFrame([(*map(float, a), *map(float, b), s) for a in boxes for b in boxes for s in (True, False)], "a double, b double, c double, d double, e double, f double, g double, h double, s boolean")
    x = Geo.box(*map(F.col, "abcd"))
    tri = Geo.polygon(F.array(Geo.vertex(F.col("e"), F.col("f")), Geo.vertex(F.col("g"), F.col("f")), Geo.vertex(F.col("g"), F.col("h")), Geo.vertex(F.col("e"), F.col("f"))))
    y = F.when(F.col("s"), Geo.box(*map(F.col, "efgh"))).otherwise(tri)
    t = df.select(x.alias("x"), y.alias("y")).unionByName(df.limit(1).select(x.alias("x"), F.lit(None).cast(Geo.TYPE).alias("y")))
    got = kernels.with_relation(t, "x", "y").withColumn("alone", kernels.relate(F.col("x"), F.col("y"))).collect()
    assert len(got) == 33 and all(r.relation == r.alone for r in got) and {r.relation for r in got} >= {None, "disjoint", "touches", "contains", "equals", "overlaps"}
    assert t.filter(kernels.intersects(F.col("x"), F.col("y"))).count() == sum(r.alone not in (None, "disjoint") for r in got)


def test_systems_must_agree(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "z double, o double")
    a, b = (Geo.box(F.col("z"), F.col("z"), F.col("o"), F.col("o"), crs) for crs in ("EPSG:4326", "EPSG:3857"))
    with pytest.raises(Exception, match="CRSMismatch"):
        df.select(kernels.relate(a, b).alias("rel")).collect()


def test_points_on_tile_edges(spark):
    """Of the 1024 edges of zoom 10, a point on one is in the tile east of it, as in the plain formula."""
    import math

    grid = tiles.GridSpec.web_tiles(10)
    lons = [i * 360 / 1024 - 180 for i in range(1024)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lons)], "i long, lon double")
    got = df.select("i", grid.pt2idx(*C.transform(F.col("lon"), F.lit(1.0), 4326, 3857)).alias("t")).select("i", "t.ix").collect()
    half, tile = math.pi * 6378137.0, 2 * math.pi * 6378137.0 / 1024
    for r in got:
        assert r["ix"] == math.floor((lons[r["i"]] * (math.pi / 180) * 6378137.0 + half) / tile)
