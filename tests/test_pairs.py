"""Closed forms of pairs against the arrangement, and where they are used: spread over tasks, without geometries."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.operators import kernels, overlay, pairs
from terrella.plans import registry


def shape(kind, *rings):
    return {"type": kind, "crs": None, "parts": [[np.array(r, float) for r in rings]]}


def rectangle(l, b, r, t):
    return [(l, b), (r, b), (r, t), (l, t), (l, b)]


def size_of(g) -> float:
    rings = [r for part in g["parts"] for r in part]
    return sum(kernels.signed_area(r) for r in rings) if kernels._dim(g) == 2 else sum(np.hypot(*np.diff(r, axis=0).T).sum() for r in rings)


def stars(rng, n, corners=9):
    t = np.sort(rng.uniform(0, 2 * np.pi, (n, corners)), 1)
    r = rng.uniform(0.5, 4, (n, corners))
    c = np.stack([r * np.cos(t), r * np.sin(t)], -1) + rng.uniform(-3, 3, (n, 1, 2))
    return np.concatenate([c, c[:, :1]], 1)


def test_areas_in_boxes():
    rng = np.random.default_rng(4)
    rings, low = stars(rng, 60), rng.uniform(-4, 2, (60, 2))
    box = np.concatenate([low, low + rng.uniform(0.1, 4, (60, 2))], 1)
    got = pairs.areas_in_boxes(*(c for i in range(rings.shape[1]) for c in rings[:, i].T), *box.T)
    want = [size_of(overlay.combine(shape("Polygon", r), shape("Polygon", rectangle(*b)), overlay.INTERSECTION)) for r, b in zip(rings, box.tolist())]
    assert got == pytest.approx(want, abs=1e-9) and (got > 0).sum() > 20


@pytest.mark.parametrize("k", range(6))
def test_shares_in_rings(k):
    """Stars, and a ring of steps with lines along its edges: as the arrangement has it."""
    rng = np.random.default_rng(k)
    steps = np.array([(0, 0), (6, 0), (6, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2), (0, 0)], float)
    rings = np.concatenate([stars(rng, 20, 8), np.repeat(steps[None], 40, 0)])
    ends = np.concatenate([rng.uniform(-5, 5, (20, 2, 2)), rng.integers(-1, 8, (40, 2, 2))]).astype(float)
    ends[30:, 1, 1] = ends[30:, 0, 1]
    got = pairs.shares_in_rings(*(c for i in range(9) for c in rings[:, i].T), *(c for i in (0, 1) for c in ends[:, i].T))
    for share, ring, e in zip(got, rings, ends):
        far = float(np.hypot(*(e[1] - e[0])))
        want = size_of(overlay.combine(shape("Polygon", ring), shape("LineString", e), overlay.INTERSECTION)) if far else 0.0
        assert share * far == pytest.approx(want, abs=1e-9)


def test_crossings(spark):
    cases = [((0, 0, 4, 0, 2, -1, 2, 1), (2, 0)), ((0, 0, 4, 0, 4, 0, 4, 3), (4, 0)), ((0, 0, 4, 0, 4.001, -1, 4.001, 1), None), ((0, 0, 4, 0, 0, 1, 4, 1), None), ((0, 0, 3, 3, 0, 3, 3, 0), (1.5, 1.5))]
    df = spark.createDataFrame([(n, *map(float, c)) for n, (c, _) in enumerate(cases)], "n int, a double, b double, c double, d double, e double, f double, g double, h double")
    p, q, u, v = ((F.col(x), F.col(y)) for x, y in ("ab", "cd", "ef", "gh"))
    got = {r["n"]: r["m"] and tuple(r["m"]) for r in pairs.with_crossing(df, p, q, u, v, "m").collect()}
    assert got == {n: w for n, (_, w) in enumerate(cases)}


def test_nulls(spark):
    df = spark.sql("select 0D l, 0D b, 2D r, cast(null as double) t union all select 0D, 0D, 2D, 3D")
    l, b, r, t = (F.col(c) for c in "lbrt")
    got = df.select("t", pairs.area_in_box([(l, b), (r, b), (r, t), (l, t), (l, b)], F.struct("l", "b", "r", "t").cast("struct<left:double,bottom:double,right:double,top:double>")).alias("a")).collect()
    assert {(x["t"], x["a"]) for x in got} == {(None, None), (3.0, 6.0)}


def queried(spark, d, name, customers, suppliers):
    spark.createDataFrame([(k, 1) for k in customers], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey long").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return registry.QUERIES[name](spark, d), c.sql(registry.ORACLES[name])


@pytest.mark.parametrize("name", ["polygon_overlay", "polygon_intersection", "box_relations", "line_meetings", "lines_by_polygons"])
def test_pairs_are_spread(spark, tmp_path, name):
    """A file of one partition is worked on by all cores, and pairs carry no geometries to Python."""
    got, want = queried(spark, str(tmp_path), name, range(300), range(60))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "parts" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.fetchall())
