"""Polygons that lines do not come near are one piece without being cut; the same pieces as by cutting."""

import time

import numpy as np
from pyspark.sql import functions as F

from terrella.functions import geometry as Geo
from terrella.operators import overlay
from terrella.operators.kernels import signed_area
from terrella.plans import registry


def shape(kind, *points):
    return {"type": kind, "crs": None, "parts": [[np.array(points, float)]]}


CUT = shape("LineString", (0, -9), (0, 9))


def quad(*p):
    return shape("Polygon", *p, p[0])


def test_uncut():
    away = [quad((1, 0), (3, 0), (3, 2), (1, 2)), quad((1, 2), (3, 2), (3, 0), (1, 0)), quad((1, 0), (4, 0), (2, 3)), quad((-4, 20), (4, 20), (4, 30), (-4, 30))]
    others = [
        quad((0, 0), (3, 0), (3, 2), (0, 2)), quad((-1, 0), (3, 0), (3, 2), (-1, 2)), quad((1, 0), (3, 2), (3, 0), (1, 2)), quad((1, 0), (3, 0), (1.5, 0.5), (1, 2)), quad((1, 0), (1, 0), (3, 0), (1, 2)), quad((1, 0), (2, 0), (3, 0), (1, 0)),
        {"type": "MultiPolygon", "crs": None, "parts": away[0]["parts"] * 2}, shape("LineString", (1, 0), (2, 0), (3, 1), (4, 4)),
    ]
    found = overlay.uncut([(g, CUT) for g in away + others] + [None])
    assert sorted(found) == list(range(len(away)))
    for k, g in enumerate(away):
        (whole,) = overlay.split_polygon(g, CUT)
        ring, want = found[k]["parts"][0][0], whole["parts"][0][0]
        assert found[k]["type"] == whole["type"] == "Polygon" and signed_area(ring) == signed_area(want) > 0
        assert {tuple(p) for p in ring.tolist()} == {tuple(p) for p in want.tolist()}


def test_split_of_many(spark):
    """Near the line and far from it, in one column."""
    began = time.perf_counter()
    df = spark.range(20_000).select("id", Geo.box(F.col("id") % 400 - 200.0, F.lit(0.0), F.col("id") % 400 - 197.5, F.lit(2.0)).alias("g"))
    p = df.select("id", overlay.split(F.col("g"), Geo.line([(0.25, -9.0), (0.25, 9.0)])).alias("p"))
    got = p.select("id", F.size("p").alias("n"), F.aggregate("p", F.lit(0.0), lambda a, v: a + Geo.area(v)).alias("area")).collect()
    assert all(r["n"] == (2 if r["id"] % 400 in (198, 199, 200) else 1) and r["area"] == 5.0 for r in got) and time.perf_counter() - began < 30


def test_parts_are_spread(spark):
    assert "Repartition" in registry.QUERIES["geometry_parts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_centroid_is_folded_once(spark):
    hole = Geo.polygon([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], None, [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])
    df = spark.range(1).select(Geo.centroid(hole).alias("c"))
    (c,) = df.collect()[0]
    assert (c["x"], c["y"]) == (28 / 12, 28 / 12)
