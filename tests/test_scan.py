"""Running totals over buckets against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.operators import scan, tiles


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_running_totals(spark, buckets):
    """A key that holds most rows, order values that repeat, nulls in key, order and value."""
    r = np.random.default_rng(0)
    rows = [(None if k == 3 else int(k), None if o > 95 else int(o), i, None if v == 0 else int(v)) for i, (k, o, v) in enumerate(zip(r.choice([1, 1, 1, 1, 2, 3], 600), r.integers(0, 100, 600), r.integers(0, 9, 600)))]
    df = spark.createDataFrame(rows, "k int, o int, i int, v int").repartition(4)
    got = scan.running_totals(df, {"t": F.col("v"), "n": F.lit(1)}, "o", ["k"], ["i"], buckets).collect()
    seen: dict = {}
    want = {}
    for k, o, i, v in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2])):
        t, n = seen.get(k, (0, 0))
        seen[k] = want[i] = (t + (v or 0), n + 1)
    assert {x.i: (x.t, x.n) for x in got} == want and len(got) == len(rows)
    one = {x.i: x.n for x in scan.running_totals(df, {"n": F.lit(1)}, "o", then=["i"], buckets=buckets).collect()}
    assert sorted(one.values()) == list(range(1, 601))
    assert scan.running_totals(df.limit(0), {"t": F.col("v")}, "o", ["k"]).count() == 0


def test_no_window_over_all_rows(spark):
    """Windows are by bucket, but for one over the buckets' sums."""
    df = spark.range(5000).select(F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    t = scan.running_totals(df, {"t": F.col("v")}, "o", buckets=8)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.split("\n") if "Window [" in line and "_bucket" not in line.split("windowspecdefinition(")[1].split(" ASC")[0]]
    assert plan.count("Window [") == 2 and len(whole) <= 1 and t.agg(F.max("t")).first()[0] == sum(i % 7 for i in range(5000))


def test_cropped_tilings(spark):
    chunks = {"a": [3, 5, 2, 7], "b": [1, 1, 9]}
    df = spark.createDataFrame([(k, i * 10, n) for k, v in chunks.items() for i, n in enumerate(v)], "k string, i int, n long")
    t = tiles.numbered_chunks(df, "k", "i", "n")
    assert {(r.k, r.number): (r.start, r.stop) for r in t.collect()} == {("a", 0): (0, 3), ("a", 1): (3, 8), ("a", 2): (8, 10), ("a", 3): (10, 17), ("b", 0): (0, 1), ("b", 1): (1, 2), ("b", 2): (2, 11)}
    c = tiles.crop_chunks(t, "k", 1, 3)
    assert {(r.k, r.number): (r.start, r.stop) for r in c.collect()} == {("a", 0): (0, 5), ("a", 1): (5, 7), ("b", 0): (0, 1), ("b", 1): (1, 10)}
    got = {(r.k, r.ty, r.tx): (r.y0, r.x1, r.height, r.width) for r in tiles.variable_tiles(t, c, "k").collect()}
    assert len(got) == 4 * 2 + 3 * 2 and got["a", 3, 1] == (10, 7, 7, 2)
