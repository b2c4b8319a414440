"""Exact scalar tables for the Column builders."""

import math

import pytest
from pyspark.sql import functions as F

from terrella.functions import affine as A
from terrella.functions import bbox as B
from terrella.functions import crs as C
from terrella.functions import geobox as G
from terrella.functions import geometry as Geo
from terrella.functions import roi
from terrella.functions import scalar as S
from terrella.values import Affine, Anchor, Resolution, Shape2d, res_, shape_, xy_, yx_


def value(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    ("a", "b", "res", "off", "tol", "want"),
    [
        (20, 30, 10, 0.0, 1e-6, (20, 1)), (20, 30.5, 10, 0.0, 1e-6, (20, 2)), (20, 30, 10, 0.3, 1e-6, (13, 2)), (20, 30, -10, 0.0, 1e-6, (30, 1)),
        (19.5, 30, -10, 0.0, 1e-6, (30, 2)), (20, 30, -10, 0.3, 1e-6, (33, 2)), (19.5, 30, 10, None, 1e-6, (19.5, 2)), (0.95, 10.12, 1, 0.0, 0.1, (1, 10)), (0.95, 10.05, 1, 0.0, 0.1, (1, 9)),
    ],
)
def test_snap_grid(spark, a, b, res, off, tol, want):
    got = value(spark, S.snap_grid(F.lit(float(a)), F.lit(float(b)), float(res), off, tol))
    assert (round(got["origin"], 9), got["n"]) == want


@pytest.mark.parametrize(("x", "want"), [(1.3, (1, 0.3)), (0.99, (1, -0.01)), (100.6, (101, -0.4)), (-1.5, (-1, -0.5)), (2.45, (2, 0.45)), (math.inf, (math.inf, 0))])
def test_split_float(spark, x, want):
    got = value(spark, S.split_float(F.lit(x)))
    assert (got["whole"], round(got["frac"], 9)) == want


def test_alignment(spark):
    assert value(spark, S.align_up(F.lit(17), 16)) == 32
    assert value(spark, S.align_down(F.lit(31), 16)) == 16
    for n in range(12):
        for d in (-1, 0, 1):
            x = 2**n + d
            up = 1 if x <= 1 else 2 ** math.ceil(math.log2(x))
            assert value(spark, S.align_up_pow2(F.lit(x).cast("long"))) == up
            if x > 0:
                assert value(spark, S.align_down_pow2(F.lit(x).cast("long"))) == 2 ** int(math.log2(x))


def test_snap_scale(spark):
    for x, want in ((2.0000001, 2.0), (0.5000000001, 0.5), (1 / 3 + 1e-9, 1 / 3), (0.7, 0.7), (0.0, 0.0), (-0.25, -0.25)):
        assert value(spark, S.snap_scale(F.lit(x))) == pytest.approx(want, abs=1e-12)


def test_bins(spark):
    assert value(spark, S.bin_index(F.lit(10.0), 10.0, 20.0)) == -1
    assert value(spark, S.bin_index(F.lit(10.0), 10.0, 20.0, -1)) == 1
    assert tuple(value(spark, S.bin_edges(F.lit(1), 10.0, 20.0, -1))) == (10.0, 20.0)
    assert S.bin_from_sample(1, 10.0, 20.0, -1) == (10.0, 20.0, -1)


def test_edge_index(spark):
    got = [tuple(p) for p in value(spark, S.edge_index(3, 2, True))]
    assert got == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 0), (1, 0), (0, 0)]


@pytest.mark.parametrize(
    ("case", "want"),
    [((100, 20, 1, 10), (10, 30, 0, 20)), ((100, 20, -2, 90), (50, 90, 0, 20)), ((10, 10, 1, 11), (10, 10, 0, 0)), ((20, 100, 0.1, 0), (0, 10, 0, 100)), ((100, 100, 1, -10), (0, 90, 10, 100))],
)
def test_axis_overlap(spark, case, want):
    assert tuple(value(spark, A.axis_overlap(*(F.lit(float(x)) for x in case)))) == want


@pytest.mark.parametrize(
    ("m", "want"),
    [(Affine(1, 0.1), "the axes turn"), (Affine.scale(2.5), "the scale is no whole number"), (Affine.scale(2, 4), "the axes differ in scale"), (Affine.translation(0.3, 0), "the shift is no whole number of pixels"), (Affine.translation(3, 4), None), (Affine.scale(3), None)],
)
def test_paste(spark, m, want):
    assert value(spark, A.paste_problem(A.literal(m))) == want


def test_affine_inverse(spark):
    m = Affine(2, 0.5, 10, -1, 3, -7)
    got = value(spark, A.multiply(A.literal(m), A.inverse(A.literal(m))))
    assert [round(v, 12) + 0.0 for v in got] == [1, 0, 0, 0, 1, 0]


def test_decompose(spark):
    m = Affine.rotation(30) * Affine(1, 0.25) * Affine.scale(3, -2)
    got = value(spark, A.decompose(A.literal(m)))
    assert [round(v, 9) for v in (got["sx"], got["sy"], got["shear"])] == [3, -2, 0.25]


def test_roi(spark):
    s = lambda a, b: roi.span(F.lit(a), F.lit(b))
    assert tuple(value(spark, roi.intersect(s(1, 30), s(20, 40)))) == (20, 30)
    assert tuple(value(spark, roi.intersect(s(1, 10), s(20, 40)))) == (10, 10)
    assert tuple(value(spark, roi.intersect(s(4, 7), s(0, 1)))) == (4, 4)
    assert tuple(value(spark, roi.pad(s(1, 5), 10, F.lit(9)))) == (0, 9)
    assert tuple(value(spark, roi.normalise(F.lit(None).cast("int"), F.lit(-3), F.lit(20)))) == (0, 17)
    for a, b in (((0, 5), (3, 9)), ((3, 9), (0, 5)), ((0, 2), (5, 6)), ((5, 6), (0, 2))):
        x = value(spark, roi.intersect3(s(*a), s(*b)))
        line = list(range(20))
        assert line[a[0] : a[1]][x["a"][0] : x["a"][1]] == line[b[0] : b[1]][x["b"][0] : x["b"][1]] == line[x["ab"][0] : x["ab"][1]]


def test_boxes(spark):
    b = B.bbox(-10.1, 2.3, 10.9, 2.4, "EPSG:4326")
    assert tuple(value(spark, B.round_out(b)))[:4] == (-11, 2, 11, 3)
    df = spark.createDataFrame([(0.0, 1.0, 10.0, 20.0), (5.0, 6.0, 11.0, 22.0)], "l double, b double, r double, t double").withColumn("x", B.bbox("l", "b", "r", "t", "EPSG:3857"))
    assert tuple(df.agg(B.union_agg(F.col("x")).alias("u")).collect()[0]["u"]) == (0, 1, 11, 22, "EPSG:3857")
    assert tuple(df.agg(B.intersection_agg(F.col("x")).alias("u")).collect()[0]["u"])[:4] == (5, 6, 10, 20)
    mixed = df.withColumn("x", B.bbox("l", "b", "r", "t", F.when(F.col("l") > 0, F.lit("EPSG:3857")).otherwise(F.lit("EPSG:4326"))))
    with pytest.raises(Exception, match="different reference systems"):
        mixed.agg(B.union_agg(F.col("x"))).collect()


@pytest.mark.parametrize(("lon", "lat", "want"), [(-180.0, -30.0, 32701), (0.33, 10.0, 32631), (180.0, 10.0, 32660)])
def test_utm_zone(spark, lon, lat, want):
    assert value(spark, C.utm_zone(F.lit(lon), F.lit(lat))) == want == C.utm_epsg(lon, lat)


@pytest.mark.parametrize(("box", "want"), [((0, 10, 7, 20), 32631), ((5, 10, 8, 20), 32632)])
def test_utm_of_box(spark, box, want):
    assert value(spark, C.utm_for_box(*(F.lit(float(v)) for v in box))) == want


def test_units_per_degree(spark):
    for lon in (0.0, 20.0, 30.0, 180.0, -180.0):
        assert abs(value(spark, C.units_per_degree(3857, F.lit(lon), F.lit(0.0))) - 111319.49) < 0.5


@pytest.mark.parametrize("target", [3857, 6933, 3577, 5070, 32631, 32755, "sinusoidal"])
def test_projection_round_trip(spark, target):
    area = C.crs(target).area
    lon, lat = (area[0] + area[2]) / 2 + 0.7, (area[1] + area[3]) / 2 + 0.3
    x, y = C.transform(*C.transform(F.lit(lon), F.lit(lat), 4326, target), target, 4326)
    assert value(spark, x) == pytest.approx(lon, abs=1e-6)
    assert value(spark, y) == pytest.approx(lat, abs=1e-6)


def test_projection_nan_and_unknown(spark):
    x, y = C.transform(F.lit(float("nan")), F.lit(1.0), 4326, 3857)
    assert math.isnan(value(spark, x)) and math.isnan(value(spark, y))
    with pytest.raises(C.UnsupportedCRS):
        C.crs("EPSG:99999")
    assert C.norm_crs("utm", (0.33, 10.0)).epsg == 32631 and C.norm_crs("utm-s", (0.33, 10.0)).epsg == 32731
    assert C.crs(4326) == "EPSG:4326" and C.crs(3857).units == ("metre", "metre") and C.crs(4326).dimensions == ("latitude", "longitude")


def test_utm_known_point(spark):
    """The equator at the central meridian, and a degree east of it (Krueger, to the millimetre)."""
    x, y = C.transform(F.lit(3.0), F.lit(0.0), 4326, 32631)
    assert value(spark, x) == pytest.approx(500000, abs=1e-6) and value(spark, y) == pytest.approx(0, abs=1e-6)
    x, _ = C.transform(F.lit(4.0), F.lit(0.0), 4326, 32631)
    assert value(spark, x) == pytest.approx(611280.593, abs=0.5)


def test_geobox_ops(spark):
    df = spark.range(1).select(G.geobox(100, 1000, A.literal(Affine(10, 0, 12340, 0, -10, 316770)), "EPSG:3857").alias("g")).cache()
    g = F.col("g")
    once = df.select(g, G.flipx(g).alias("fx"), G.flipy(g).alias("fy"), G.right(g).alias("r"), G.bottom(g).alias("bt"), G.zoom_out(g, 2.0).alias("z"), G.translate_pix(g, 3, -4).alias("t"), G.pad(g, 1, 2).alias("p"), G.pad_wh(g, 16).alias("w")).cache()
    got = once.select(
        "g", G.flipx(F.col("fx")).alias("a"), G.flipy(F.col("fy")).alias("b"), G.left(F.col("r")).alias("c"), G.top(F.col("bt")).alias("d"), G.zoom_to(F.col("z"), (100, 1000)).alias("e"),
        G.overlap_roi(g, F.col("t")).alias("roi"), F.col("p.ny").alias("pad"), F.col("w.nx").alias("wide"),
    ).first()
    assert got["a"] == got["b"] == got["c"] == got["d"] == got["e"] == got["g"]
    assert tuple(got["roi"]) == (0, 96, 3, 1000) and (got["pad"], got["wide"]) == (104, 1008)
    assert value(spark, G.flipx(G.flipx(G.geobox(5, 4, A.literal(Affine(2, 0, 1, 0, -2, 9)), None))))["m"]["c"] == 1


def test_geobox_from_bbox(spark):
    df = spark.range(1).select(B.bbox(0.3, 0.3, 9.6, 4.5, "EPSG:4326").alias("b"))
    g = df.select(G.from_bbox(F.col("b"), (1.0, -1.0), anchor=Anchor.CENTER).alias("g")).first()["g"]
    assert g["m"]["c"] == -0.5 and g["nx"] == 11


def test_geobox_to_crs(spark):
    """Over a column, as grids come in practice."""
    df = spark.range(1).select(G.geobox(50, 60, A.literal(Affine(0.01, 0, 10, 0, -0.01, 5)), "EPSG:4326").alias("g"))
    box = df.select(G.footprint_box(F.col("g"), 4326, 3857).alias("b")).first()["b"]
    assert box["left"] == pytest.approx(10 * 111319.490793, abs=1e-3) and box["crs"] == "EPSG:3857"
    assert G.to_crs(F.col("g"), 4326, 4326) is not None


def test_geometry(spark):
    sq = Geo.box(10.0, 10.0, 30.0, 30.0, "EPSG:4326")
    assert value(spark, Geo.area(sq)) == 400 and value(spark, Geo.length(sq)) == 80 and tuple(value(spark, Geo.centroid(sq))) == (20, 20)
    ring = [(p["x"], p["y"]) for p in value(spark, Geo.densify(Geo.coords([(0, 0), (10, 0)]), 4.0, compat=False))]
    assert ring == [(0, 0), (4, 0), (8, 0), (10, 0)]
    assert value(spark, Geo.wkt(Geo.line([(0, 0), (1, 2)]))) == "LINESTRING (0.0 0.0, 1.0 2.0)"
    assert value(spark, Geo.contains_point(Geo.polygon([(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], None, [(3, 3), (3, 6), (6, 6), (6, 3), (3, 3)]), F.lit(4.0), F.lit(4.0))) is False
    assert tuple(value(spark, Geo.interpolate(Geo.line([(0, 0), (3, 0), (3, 4)]), 5.0))) == (3, 2)
    bounds = value(spark, Geo.lonlat_bounds(Geo.line([(179.0, 0.0), (-179.0, 1.0)], "EPSG:4326"), 4326))
    assert (bounds["left"], bounds["right"]) == (179, 181)


def test_values():
    assert xy_(1, 2).yx == (2, 1) and yx_(1, 2).xy == (2, 1) and Resolution(3).xy == (3, -3) and shape_((2, 3)).wh == (3, 2)
    assert Shape2d(4, 6) == (6, 4) and Shape2d(5, 7).shrink2() == (3, 2)
    with pytest.raises(ValueError):
        xy_(1)
    with pytest.raises(ValueError):
        res_((1, 2))
