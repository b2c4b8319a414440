"""Hulls of groups by tasks, and triangles of many points."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.functions import geometry as Geo
from terrella.operators import kernels
from terrella.plans import registry


def test_hulls_by_tasks(spark, monkeypatch):
    """As the hull of all of a group's points: keys that are null, groups without a place, and points beyond what a task keeps."""
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(0, 9, (4000, 2)), rng.integers(-20, 20, (4000, 2)), np.full((3, 2), np.nan), [[1, 1], [2, 2]]])
    keys = np.concatenate([rng.integers(0, 7, 8000), [7, 7, 7], [8, 8]])
    df = spark.createDataFrame([(None if k == 3 else int(k), float(x), float(y)) for k, (x, y) in zip(keys, xy)], "g int, x double, y double").repartition(5)
    found = kernels.convex_hulls(df, "g", "x", "y", "h")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {r["g"]: np.array([tuple(v) for v in r["h"]["parts"][0][0]]).reshape(-1, 2).tolist() for r in found.collect()}
    assert got == {None if k == 3 else int(k): kernels.hull(xy[keys == k]).reshape(-1, 2).tolist() for k in np.unique(keys)}


def test_rim_keeps_the_hull():
    rng = np.random.default_rng(3)
    for points in (rng.normal(0, 1, (3000, 2)), rng.integers(0, 30, (3000, 2)).astype(float), np.repeat([[1.0, 2.0]], 100, 0), np.stack([np.arange(100.0)] * 2, 1)):
        kept = kernels.rim(points)
        assert (kernels.hull(kept) == kernels.hull(points)).all()
    assert len(kernels.rim(rng.normal(0, 1, (3000, 2)))) < 300


def test_hull_query_moves_hulls_only(spark):
    d = "/root/testdata/sf0.001"
    got = {r["g"]: (r["n"], r["area"]) for r in registry.QUERIES["convex_hulls"](spark, d).collect()}
    whole = registry.pts(spark, d).withColumn("g", F.col("ok") % 20).groupBy("g").agg(Geo.geometry("MultiPoint", F.collect_list(F.array(F.array(Geo.vertex(F.col("lon"), F.col("lat")))))).alias("m"))
    for r in whole.collect():
        h = kernels.hull(np.array([tuple(p[0][0]) for p in r["m"]["parts"]]))
        assert got[r["g"]] == (len(h), pytest.approx(kernels.signed_area(h), abs=1e-3))


@pytest.mark.parametrize("k", range(8))
def test_triangles(k):
    """They fill the hull, no circle has a point within it, and their count is Euler's: on grids, at random, with copies."""
    rng = np.random.default_rng(k)
    p = rng.integers(0, 3 + k, (50, 2)).astype(float) if k % 2 else rng.uniform(-5, 5, (20 * k + 3, 2))
    triangles, each = kernels.delaunay(np.concatenate([p, p[:2]])), np.unique(p, axis=0)
    ring, area = kernels.hull(p), 0.0
    for (ax, ay), (bx, by), (cx, cy) in (p[list(t)] for t in triangles):
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        area += abs(d) / 4
        b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        mid = np.array([ax + ((cy - ay) * b2 - (by - ay) * c2) / d, ay + ((bx - ax) * c2 - (cx - ax) * b2) / d])
        assert (((each - mid) ** 2).sum(1) >= ((mid - (ax, ay)) ** 2).sum() * (1 - 1e-9) - 1e-9).all()
    rim = kernels.near_any(each, np.concatenate([ring[:-1], ring[1:]], 1), 1e-9).sum()
    assert area == pytest.approx(kernels.signed_area(ring)) and len(triangles) == 2 * len(each) - 2 - rim


def test_triangles_of_many_points():
    began = time.perf_counter()
    p = np.random.default_rng(1).integers(0, 2000, (12_000, 2)) / 10
    assert len(kernels.delaunay(p)) > 20_000 and time.perf_counter() - began < 30
    assert kernels.delaunay(np.zeros((5, 2))) == [] == kernels.delaunay(np.stack([np.arange(9.0)] * 2, 1))
