"""Spatial joins: each box is dealt to the cells of a grid it touches, rows meet by equal cell, an exact test decides.

The pair is reported in the one cell that holds the lower left corner of the two boxes' intersection, so no duplicates
have to be removed afterwards. Hot cells are left to adaptive skew handling, or split by ``salt``: the left side spreads
over that many copies of the right side's rows of the cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bbox as B


def _cells(df: DataFrame, box: str, cell: float, prefix: str) -> DataFrame:
    b = F.col(box)
    at = lambda v: F.floor(v / cell)
    w = df.withColumn(f"{prefix}cy", F.explode(F.sequence(at(b["bottom"]), at(b["top"]))))
    return w.withColumn(f"{prefix}cx", F.explode(F.sequence(at(b["left"]), at(b["right"]))))


def spread(df: DataFrame) -> DataFrame:
    """Rows over four tasks a core: few bytes come as one partition, and work on them is in pairs, not in bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows of one box that meet the other side as one.
GATHER = 1000


def _gathered(df: DataFrame, box: str) -> DataFrame:
    """``box`` and ``_rows``, the other columns of rows that have the same box: as many rows as keep each under about ``GATHER``."""
    others = [c for c in df.columns if c != box]
    t = df.filter(F.col(box).isNotNull())
    sizes = t.groupBy(F.col(box).alias("_sb")).agg(F.ceil(F.count(F.lit(1)) / GATHER).alias("_hands"))
    t = t.join(sizes, F.col(box).eqNullSafe(F.col("_sb"))).withColumn("_h", F.pmod(F.xxhash64(*others), F.col("_hands")))
    return t.groupBy(box, "_h").agg(F.collect_list(F.struct(*others)).alias("_rows"))


def box_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float, test: Callable[[Column, Column], Column] = B.overlaps, salt: int = 1, gather: bool = False) -> DataFrame:
    """Inner join of rows whose boxes satisfy a test that implies overlap. Column names must differ between the sides.

    With ``gather``, rows of the left side with the same box are tested as one and told apart after: where boxes come again, tests
    are fewer by as much.
    """
    if gather:
        pairs = box_join(_gathered(left, left_box), right, left_box, right_box, cell, test, salt).select("*", F.explode("_rows").alias("_row"))
        return pairs.select(*(F.col(c) if c == left_box else F.col(f"_row.{c}") for c in left.columns), *right.columns)
    a, b = _cells(spread(left), left_box, cell, "_l"), _cells(right, right_box, cell, "_r")
    on = (F.col("_lcy") == F.col("_rcy")) & (F.col("_lcx") == F.col("_rcx"))
    if salt > 1:
        a = a.withColumn("_ls", F.pmod(F.xxhash64(*(F.col(c) for c in left.columns if c == "_h" or not c.startswith("_"))), F.lit(salt)).cast("int"))
        b = b.withColumn("_rs", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on = on & (F.col("_ls") == F.col("_rs"))
    x, y = F.col(left_box), F.col(right_box)
    first = (F.floor(F.greatest(x["left"], y["left"]) / cell) == F.col("_lcx")) & (F.floor(F.greatest(x["bottom"], y["bottom"]) / cell) == F.col("_lcy"))
    out = a.join(b, on & first & test(x, y))
    return out.drop("_lcy", "_lcx", "_rcy", "_rcx", "_ls", "_rs")


def box_semi_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float, key: str, test: Callable[[Column, Column], Column] = B.overlaps) -> DataFrame:
    """Rows of the left side with a partner; key identifies them."""
    return left.join(box_join(left.select(key, left_box), right.select(right_box), left_box, right_box, cell, test).select(key).distinct(), key, "left_semi")


def box_anti_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float, key: str, test: Callable[[Column, Column], Column] = B.overlaps) -> DataFrame:
    return left.join(box_join(left.select(key, left_box), right.select(right_box), left_box, right_box, cell, test).select(key).distinct(), key, "left_anti")


def point_in_polygon_join(points: DataFrame, polygons: DataFrame, x: str, y: str, geom: str, cell: float, at_edge: Column | None = None) -> DataFrame:
    """Pairs of a point and a polygon that contains it: a point is in one cell, a polygon in those its box touches.

    A cell that no edge of the polygon meets lies inside it or outside: inside, its points need no test; outside, it is
    dropped before the join. Other cells keep the edges that a ray to the right from one of their points can cross. Cells of
    about the size of a few polygons' edges serve best. Points on an edge are outside; with ``at_edge``, a test over the columns
    of both sides, it decides for the points that are within rounding of an edge.
    """
    from ..functions import geometry as Geo
    from ..functions.scalar import let

    p = points.withColumn("_lcy", F.floor(F.col(y) / cell)).withColumn("_lcx", F.floor(F.col(x) / cell))
    q = _cells(polygons.withColumn("_b", Geo.boundingbox(F.col(geom))).withColumn("_e", Geo.edges(F.col(geom))), "_b", cell, "_r")
    # a little more than the cell, as a point at its edge may be dealt to it by rounding
    left, bottom, pad = F.col("_rcx") * cell, F.col("_rcy") * cell, 1e-9 * cell + 1e-12
    place = B.bbox(left - pad, bottom - pad, left + (cell + pad), bottom + (cell + pad))
    q = q.withColumn("_s", let(F.struct(place.alias("c"), F.col("_e").alias("e")), lambda v: _cell_state(v["c"], v["e"]))).filter("_s.state >= 0").drop("_b", "_e")
    if at_edge is not None:
        q = q.withColumn("_s", F.struct(F.col("_s.state").alias("state"), F.transform("_s.edges", Geo.ray_edge).alias("edges")))
    met = p.join(q, (F.col("_lcy") == F.col("_rcy")) & (F.col("_lcx") == F.col("_rcx")))
    # one CASE, so the optimiser cannot put the ring test before the state
    edges, at, within = F.col("_s.edges"), (F.col(x), F.col(y)), F.when(F.col("_s.state") == 1, F.lit(True))
    if at_edge is None:
        within = within.otherwise(Geo.inside(edges, *at))
    else:
        within = within.when(F.exists(edges, lambda e: Geo.ray_near(e, *at)), at_edge).otherwise(F.size(F.filter(edges, lambda e: Geo.ray_crossed(e, *at))) % 2 == 1)
    met = met.filter(within)
    return met.drop("_lcy", "_lcx", "_rcy", "_rcx", "_s")


def _cell_state(cell: Column, edges: Column) -> Column:
    """struct(state, edges): 1 for a cell inside, -1 for one outside, without edges, and 0 for one that edges meet, with those that matter in it."""
    from ..functions import geometry as Geo
    from ..functions.scalar import let

    none = F.slice(edges, 1, 0)

    def judge(v: Column) -> Column:
        mid = lambda a, b: (cell[a] + cell[b]) / 2
        whole = F.when(Geo.inside(edges, mid("left", "right"), mid("bottom", "top")), 1).otherwise(-1)
        return F.when(v, F.struct(F.lit(0).alias("state"), F.filter(edges, ahead).alias("edges"))).otherwise(F.struct(whole.alias("state"), none.alias("edges")))

    def ahead(e: Column) -> Column:
        p, r = e["p"], e["q"]
        return (F.least(p["y"], r["y"]) <= cell["top"]) & (F.greatest(p["y"], r["y"]) >= cell["bottom"]) & (F.greatest(p["x"], r["x"]) >= cell["left"])

    return let(F.exists(edges, lambda e: Geo.edge_meets_box(e, cell)), judge)
