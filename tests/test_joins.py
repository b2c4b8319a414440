"""Spatial joins at edges and at sizes, against SQL over tables made for the case."""

import duckdb
from pyspark.sql import functions as F

from terrella.functions import bbox as B
from terrella.operators import join
from terrella.plans import registry


def test_points_on_the_edges_of_diamonds(spark, tmp_path):
    """Points that rounding alone puts in or out: of each diamond, all on its edges that the tables can state."""
    lon, lat = pow(7919, -1, 360000), pow(6101, -1, 160000)
    suppliers, points = [2, 299, 327, 1044, 2961], set()
    for sk in suppliers:
        # in thousandths from (-180, -80): as the query's tables have them
        left, bottom, w, h = sk * 113 % 3400 * 100 + 10000, sk * 71 % 1500 * 100 + 5000, (5 + sk % 11) * 1000, (5 + sk % 9) * 1000
        for x in range(0, w + 1):
            away = h * min(x, w - x)
            points |= {(left + x, bottom + h // 2 + s * away // w) for s in (1, -1) if away % w == 0}
    rows = [((x - 104729) * lon % 360000, y * lat % 160000, 0, 1, 1.0, 1.0) for x, y in sorted(points)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "supplier"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = dict(c.sql(registry.ORACLES["point_in_polygon_join"]).fetchall())
    got = {r["sk"]: r["n"] for r in registry.QUERIES["point_in_polygon_join"](spark, d).filter(F.col("n") > 0).collect()}
    assert got == want and 0 < sum(want.values()) < len(rows)


def test_rows_of_one_box_meet_as_one(spark, monkeypatch):
    """Copies of a box, in lists of bounded length, are tested once; the rows come out as they went in."""
    monkeypatch.setattr(join, "GATHER", 5)
    box = lambda n, k: F.struct((F.col(k) % n * 3.0).alias("left"), F.lit(0.0).alias("bottom"), (F.col(k) % n * 3.0 + 4).alias("right"), F.lit(2.0).alias("top"), F.lit(None).cast("string").alias("crs"))
    left = spark.range(300).select("id", (F.col("id") * 2).alias("v"), F.when(F.col("id") != 7, box(10, "id")).alias("a"))
    right = spark.range(20).toDF("k").select("k", box(20, "k").alias("b"))
    lists = join._gathered(left, "a").select(F.size("_rows").alias("n")).collect()
    assert sum(r["n"] for r in lists) == 299 and max(r["n"] for r in lists) < 20
    plain, gathered = (join.box_join(left, right, "a", "b", 2.5, B.interiors_meet, salt=2, gather=g) for g in (False, True))
    assert gathered.columns == plain.columns
    got = sorted(gathered.select("id", "v", "a.left", "k").collect())
    assert got == sorted(plain.select("id", "v", "a.left", "k").collect()) and len(got) > 600
    assert "_rows" in registry.QUERIES["spatial_join_salted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
