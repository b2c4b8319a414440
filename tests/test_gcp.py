"""Control-point maps from partial sums, and back by Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.functions import affine as A
from terrella.functions import geobox as G
from terrella.operators import gcp


def images(spark, sizes):
    rng = np.random.default_rng(0)
    rows = []
    for i, n in enumerate(sizes):
        x, y = rng.uniform(0, 4000, n) + 1e6 * i, rng.uniform(0, 3000, n)
        u, v = (x - 1e6 * i) / 4000, y / 3000
        rows += [(i, float(a), float(b), float(500 + 10 * p - q + 0.6 * p * q * (n > 3)), float(-40 + 2 * p + 9 * q - 0.4 * p * q * (n > 3))) for a, b, p, q in zip(x, y, u, v)]
    return rows, spark.createDataFrame(rows, "image long, px double, py double, wx double, wy double").repartition(3)


def test_round_trips(spark):
    """3, 4, 8 and more points: exact at the points, and back within 1e-6 pixels; an equal fit by the other code."""
    rows, df = images(spark, [3, 4, 8, 9, 60])
    fits = gcp.fit_images(df, ("px", "py"), ("wx", "wy"))
    t = df.join(fits.withColumnsRenamed({c: f"f_{c}" for c in ("px", "py", "mx", "my", "scale", "terms")}), "image")
    wx, wy = gcp.evaluate(F.col("px"), F.col("py"), "f_")
    t = t.withColumns({"ux": wx, "uy": wy, "back": gcp.invert(F.col("wx"), F.col("wy"), "f_")})
    got = t.collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.ux - r.wx) < 1e-8 and abs(r.uy - r.wy) < 1e-8 and abs(r.back.x - r.px) < 1e-6 and abs(r.back.y - r.py) < 1e-6
    for r in fits.collect():
        own = np.array([q[1:] for q in rows if q[0] == r.image])
        px, py, mx, my, s, k = gcp.fit(own[:, :2], own[:, 2:])
        assert r.terms == k and np.allclose(r.px, px, atol=1e-7) and np.allclose(r.py, py, atol=1e-7) and (r.mx, r.my, r.scale) == pytest.approx((mx, my, s))


def test_points_that_fix_no_map(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 2.0, 2.0), (2, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 1.0, 2.0, 2.0), (2, 2.0, 2.0, 3.0, 3.0), (3, 5.0, 5.0, 0.0, 0.0), (3, 5.0, 5.0, 0.0, 0.0), (3, 5.0, 5.0, 0.0, 0.0), (4, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image long, px double, py double, wx double, wy double")
    got = {r.image: r.px for r in gcp.fit_images(df, ("px", "py"), ("wx", "wy")).collect()}
    assert got == {2: None, 3: None}
    u, _ = gcp.evaluate(F.lit(1.0), F.lit(1.0))
    assert gcp.fit_images(df, ("px", "py"), ("wx", "wy")).select(u.alias("u")).filter("u IS NOT NULL").count() == 0


def test_grids_over_control_points(spark):
    """A pixel of a cropped, zoomed and padded grid is where its control points' pixel is; a map with a new input is the old one."""
    _, df = images(spark, [12])
    fits = gcp.fit_images(df, ("px", "py"), ("wx", "wy"))
    g = G.pad(G.zoom_out(G.crop(G.geobox(3000, 4000, A.affine()), 100, 2900, 200, 3800), 4.0), 3)
    x, y = gcp.grid_to_world(g, F.lit(10.5), F.lit(20.25))
    u, v = gcp.evaluate(F.lit((10.5 - 3) * 4 + 200.0), F.lit((20.25 - 3) * 4 + 100.0))
    back = gcp.world_to_grid(g, F.col("x"), F.col("y"))
    r = fits.withColumns({"x": x, "y": y, "u": u, "v": v}).withColumn("back", back).first()
    assert (r.x, r.y) == pytest.approx((r.u, r.v), abs=1e-9) and (r.back.x, r.back.y) == pytest.approx((10.5, 20.25), abs=1e-6)
    p = fits.select(gcp.grid_points(g, F.lit(600.0), F.lit(500.0)).alias("p")).first().p
    assert (p.x, p.y) == pytest.approx((103.0, 103.0))
    new = fits.select("mx", "my", "scale", *(gcp.substituted(F.col(c), 2.0, 0.5, -3.0, 0.25).alias(c) for c in ("px", "py")))
    point = lambda a, b: (a / F.col("scale") + F.col("mx"), b / F.col("scale") + F.col("my"))
    one = new.select(*(c.alias(n) for c, n in zip(gcp.evaluate(*point(0.3, 0.7)), "xy"))).first()
    two = fits.select(*(c.alias(n) for c, n in zip(gcp.evaluate(*point(2 * 0.3 + 0.5, -3 * 0.7 + 0.25)), "xy"))).first()
    assert tuple(one) == pytest.approx(tuple(two))
    grid = gcp.on_grid(fits, F.lit([0, 1000]), F.lit([0, 5, 9])).select("x", "y", "wx", "wy").collect()
    assert {(r.x, r.y) for r in grid} == {(float(x), float(y)) for x in (0, 1000) for y in (0, 5, 9)}
