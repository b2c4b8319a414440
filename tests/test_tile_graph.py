"""Tiles that footprints meet: against every tile decided alone, and in a plan that computes a footprint once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.functions import affine as A
from terrella.functions import bbox as B
from terrella.functions import geobox as G
from terrella.functions import geometry as Geo
from terrella.functions import reproject as R
from terrella.operators import tiles


def test_tiles_of_footprints(spark):
    rng = np.random.default_rng(5)
    rows = [(n, *map(float, rng.uniform((-170, -70, -2e6, -2e6), (150, 60, 2e6, 2e6)))) for n in range(40)]
    df = spark.createDataFrame(rows, "n int, l double, t double, u double, v double").coalesce(1)
    source = G.geobox(100, 80, A.affine(0.5, 0.0, F.col("l"), 0.0, -0.5, F.col("t")), "EPSG:4326")
    x, y = F.radians("l") * 6378137, F.log(F.tan(F.radians("t") / 2 + np.pi / 4)) * 6378137
    dst = G.geobox(70, 60, A.affine(40000.0, 9000.0, x + F.col("u"), 3000.0, -40000.0, y - F.col("v")), "EPSG:3857")
    df = df.select("n", source.alias("s"), dst.alias("g"))
    got = tiles.grid_intersect(df, F.col("g"), F.col("s"), 3857, 4326, (100, 80, 20, 25)).select("n", "sy", "sx")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bEXP\(", plan, re.I)) == 1 and "Repartition" in plan
    foot = df.withColumn("f", R.tile_footprint(F.col("g"), F.col("s"), 3857, 4326)).withColumn("b", Geo.boundingbox(F.col("f")))
    every = foot.crossJoin(spark.range(5).toDF("sy")).crossJoin(spark.range(4).toDF("sx"))
    y0, y1, x0, x1 = tiles.tile_slices(F.col("sy").cast("int"), F.col("sx").cast("int"), 100, 80, 20, 25)
    meets = Geo.meets_box(F.col("f"), B.bbox(x0, y0, x1, y1))
    want = {tuple(r) for r in every.filter(meets & B.overlaps(F.col("b"), B.bbox(F.lit(0), F.lit(0), F.lit(80), F.lit(100)))).select("n", "sy", "sx").collect()}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_back_is_the_inverse(spark):
    """A footprint with the source's inverse bound once is the same as the map of each point."""
    df = spark.range(5).select(G.geobox(10, 12, A.affine(0.5, 0.1, F.col("id") - 3.0, 0.2, -0.5, 40.0), "EPSG:4326").alias("s"), G.geobox(9, 7, A.affine(20000.0, 0.0, F.col("id") * 1e5, 0.0, -20000.0, 5e6), "EPSG:3857").alias("g"))
    f = R.pixel_map(F.col("g"), F.col("s"), 3857, 4326)
    ring = R.through(G.boundary(F.col("g"), 5), lambda x, y: f(x, y))
    for r in df.select(R.tile_footprint(F.col("g"), F.col("s"), 3857, 4326)["parts"][0][0].alias("a"), ring.alias("b")).collect():
        assert np.array(r["a"], float) == pytest.approx(np.array(r["b"], float), abs=1e-12)
