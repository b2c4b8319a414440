"""Tilings, joins, kernels, rasters, fits and files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrella.functions import bbox as B
from terrella.functions import color
from terrella.functions import geometry as Geo
from terrella.operators import cog, gcp, join, kernels, raster, tiles
from terrella.sources import geojson, images
from terrella.streaming import bounds


def one(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0]["v"]


def test_diamond_tiles(spark):
    grid = tiles.GridSpec("EPSG:4326", (10, 10), (0.1, -0.1), (10.0, 10.0))
    d = spark.range(1).select(Geo.polygon([(10.5, 11.5), (11.5, 12.5), (12.5, 11.5), (11.5, 10.5), (10.5, 11.5)], "EPSG:4326").alias("g"))
    got = {(r["ix"], r["iy"]) for r in grid.tiles_of_polygons(d, F.col("g")).collect()}
    assert got == {(0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)} | ({(0, 0), (2, 2)} & got)


@pytest.mark.parametrize("zoom", [0, 1, 3])
def test_web_tiles_map_to_themselves(spark, zoom):
    grid = tiles.GridSpec.web_tiles(zoom)
    n = 2**zoom
    ids = spark.range(n * n).select((F.col("id") % n).alias("ix"), F.floor(F.col("id") / n).alias("iy"))
    b = grid.tile_bbox(F.col("ix"), F.col("iy"))
    r = ids.select("ix", "iy", grid.idx_bounds(b, 1e-6).alias("s")).collect()
    assert all((x["s"]["x0"], x["s"]["x1"], x["s"]["y0"], x["s"]["y1"]) == (x["ix"], x["ix"] + 1, x["iy"], x["iy"] + 1) for x in r)


def test_tile_shapes(spark):
    t = tiles.fixed_tiles(spark, 10, 20, 3, 7).filter("ty = 3 and tx = 2").collect()[0]
    assert tuple(t) == (3, 2, 9, 10, 14, 20) and tiles.chunks(10, 3) == (3, 3, 3, 1) and tiles.chunks(20, 7) == (7, 7, 6)
    assert one(spark, tiles.chunk_length(F.lit(-1), 10, 3)) == 1
    with pytest.raises(Exception, match="no such tile"):
        one(spark, tiles.chunk_length(F.lit(4), 10, 3))
    with pytest.raises(Exception, match="outside"):
        one(spark, tiles.locate(F.lit(10), F.lit(0), 10, 20, 3, 7))


def test_box_join_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, x double, y double, w double, h double")
    a = df.select("i", B.bbox("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("a"))
    b = df.filter("i < 60").select(F.col("i").alias("j"), B.bbox("y", "x", F.col("y") + F.col("h"), F.col("x") + F.col("w")).alias("b"))
    for salt in (1, 3):
        got = sorted(tuple(r) for r in join.box_join(a, b, "a", "b", 4.0, salt=salt).select("i", "j").collect())
        want = sorted((i, j) for i, x, y, w, h in rows for j, p, q, s, t in rows[:60] if x <= q + t and q <= x + w and y <= p + s and p <= y + h)
        assert got == want


def test_relations(spark):
    box = lambda a, b, c, d: Geo.box(float(a), float(b), float(c), float(d))
    cases = {"touches": box(10, 0, 20, 10), "overlaps": box(5, 5, 15, 15), "disjoint": box(11, 11, 12, 12), "contains": box(2, 2, 3, 3), "within": box(-1, -1, 11, 11), "equals": box(0, 0, 10, 10)}
    for want, other in cases.items():
        assert one(spark, kernels.relate(box(0, 0, 10, 10), other)) == want


def test_hull_simplify_clip_delaunay():
    pts = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [1, 3]], float)
    assert len(kernels.hull(pts)) == 5
    assert len(kernels.simplify_ring(np.array([[0, 0], [1, 0.01], [2, 0], [3, 5]], float), 0.1)) == 3
    a, b = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float), np.array([[2, 2], [6, 2], [6, 6], [2, 6], [2, 2]], float)
    r = kernels.clip_convex(a, b)
    assert abs((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 == 4
    t = kernels.delaunay(pts)
    area = sum(abs(np.cross(np.append(pts[j] - pts[i], 0), np.append(pts[k] - pts[i], 0))[2]) / 2 for i, j, k in t)
    assert area == pytest.approx(16)
    assert not kernels.is_simple(np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], float)) and kernels.is_simple(a)


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic", "lanczos"])
def test_warp_identity_and_constant(how):
    a = np.arange(48, dtype="float64").reshape(6, 8)
    assert np.allclose(raster.warp(a, (6, 8), (1, 0, 0, 0, 1, 0), how), a)
    assert np.allclose(raster.warp(np.full((9, 9), 5.0), (4, 4), (1.5, 0, 0.3, 0, 1.5, 0.2), how), 5)


def test_warp_reducers_and_types():
    a = np.arange(16, dtype="int16").reshape(4, 4)
    assert raster.warp(a, (2, 2), (2, 0, 0, 0, 2, 0), "max").tolist() == [[5, 7], [13, 15]]
    assert raster.warp(a.astype(float), (2, 2), (2, 0, 0, 0, 2, 0), "average").tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert raster.warp(a > 3, (4, 4), (1, 0, 0, 0, 1, 0), "bilinear").dtype == bool
    assert np.isnan(raster.warp(a.astype(float), (1, 1), (1, 0, 99, 0, 1, 0))).all()
    with pytest.raises(ValueError):
        raster.resampling("bogus")


def test_assemble():
    out = raster.assemble({(0, 0): np.ones((2, 3), "uint8"), (1, 1): np.full((1, 2), 7, "uint8")}, ((2, 1), (3, 2)))
    assert out.tolist() == [[1, 1, 1, 0, 0], [1, 1, 1, 0, 0], [0, 0, 0, 7, 7]]


def test_chunked_equals_whole(spark):
    src = np.random.default_rng(0).random((20, 24)).astype("float32")
    m = (1.0, 0.0, 2.0, 0.0, 1.0, 1.0)
    rows = []
    for ty in range(2):
        for tx in range(3):
            y0, y1, x0, x1 = ty * 9, min(18, ty * 9 + 9), tx * 8, min(20, tx * 8 + 8)
            for sy in range(4):
                for sx in range(4):
                    a0, a1, b0, b1 = sy * 5, sy * 5 + 5, sx * 6, sx * 6 + 6
                    if a0 < y1 + 1 and a1 > y0 + 1 and b0 < x1 + 2 and b1 > x0 + 2:
                        rows.append((1, ty, tx, y0, y1, x0, x1, a0, a1, b0, b1, bytearray(src[a0:a1, b0:b1].tobytes())))
    deps = spark.createDataFrame(rows, "raster long, ty int, tx int, y0 int, y1 int, x0 int, x1 int, sy0 int, sy1 int, sx0 int, sx1 int, data binary")
    whole = raster.warp(src, (18, 20), m)
    for r in raster.reproject_tiles(deps, m, (20, 24), "float32").collect():
        y0, x0 = r["ty"] * 9, r["tx"] * 8
        part = np.frombuffer(r["data"], "float32").reshape(min(18, y0 + 9) - y0, min(20, x0 + 8) - x0)
        assert np.array_equal(part, whole[y0 : y0 + 9, x0 : x0 + 8])


def test_rasterize(spark):
    g = {"type": "Polygon", "crs": None, "parts": [[[{"x": x, "y": y} for x, y in ((1, 1), (1, 3), (3, 3), (3, 1), (1, 1))]]]}
    got = raster.rasterize(tiles.fixed_tiles(spark, 4, 4, 4, 4), g, (1, 0, 0, 0, 1, 0)).collect()[0]["data"]
    assert np.frombuffer(got, np.uint8).reshape(4, 4).tolist() == [[0, 0, 0, 0], [0, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 0]]


def test_gcp_fit():
    rng = np.random.default_rng(1)
    for n in (3, 4, 12):
        a = rng.uniform(-5, 5, (n, 2))
        px, py, mx, my, s, k = gcp.fit(a, a * [2, 3] + [1, -1])
        m = gcp.terms((a[:, 0] - mx) * s, (a[:, 1] - my) * s, k)
        assert np.allclose(m @ px, a[:, 0] * 2 + 1, atol=1e-6) and np.allclose(m @ py, a[:, 1] * 3 - 1, atol=1e-6)
    with pytest.raises(ValueError):
        gcp.fit(np.zeros((2, 2)), np.zeros((2, 2)))


def test_cog_layout_and_file(spark, tmp_path):
    assert cog.tile_side(17) == 32 and cog.tile_side(512, 40) == 48 and [cog.halvings(n, 512) for n in (512, 513, 1025, 1026, 2048)] == [0, 1, 1, 2, 2] and cog.predictor("float32") == 3 and cog.predictor("uint8") == 2
    shape, tile, levels = cog.cog_spec((100, 100), (16, 16))
    assert levels == 3 and shape == (104, 104) and cog.Layout((100, 50), (16, 16)).chunked == (7, 4)
    with pytest.raises(IndexError):
        cog.Layout((10, 10), (16, 16)).flat_index(0, 1, 0)
    a = np.arange(32 * 32, dtype="uint16").reshape(32, 32)
    rows = [(0, 0, y, x, 16, 16, bytearray(a[y * 16 : y * 16 + 16, x * 16 : x * 16 + 16].tobytes())) for y in range(2) for x in range(2)]
    t = cog.compress_tiles(spark.createDataFrame(rows, "ifd int, plane int, ty int, tx int, h int, w int, data binary"), "uint16", (16, 16))
    path = str(tmp_path / "a.tif")
    size = cog.write_cog(t, path, cog.layouts((32, 32), (16, 16), 0), "uint16", cog.geo_tags((10, 0, 0, 0, -10, 0), 3857, False))
    data = open(path, "rb").read()
    assert len(data) == size and data[:4] == b"II\x2b\x00"
    import struct
    import zlib

    n, at = struct.unpack_from("<Q", data, 16)[0], 24
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from("<HHQ", data, at + 20 * i)
        where = struct.unpack_from("<Q", data, at + 20 * i + 12)[0]
        tags[tag] = (kind, count, where)
    offs, sizes = (struct.unpack_from("<4Q", data, tags[t][2]) for t in (324, 325))
    tile0 = np.frombuffer(zlib.decompress(data[offs[3] : offs[3] + sizes[3]]), "uint16").reshape(16, 16)
    assert np.array_equal(np.cumsum(tile0, 1, dtype="uint16"), a[16:, 16:])


def test_parts_plan():
    assert cog.Parts(min_size=10).plan([4, 4, 4, 20, 1]) == [(0, 3), (3, 4), (4, 5)]


def test_geojson_round_trip(spark, tmp_path):
    g = spark.range(2).select(F.col("id"), Geo.polygon([(0, 0), (0, 2), (2, 2), (0, 0)], "EPSG:4326").alias("g"))
    geojson.write(g, "g", str(tmp_path / "out"))
    back = geojson.read(spark, str(tmp_path / "out"))
    assert back.count() == 2 and back.select(Geo.area(F.col("geometry")).alias("a")).first()["a"] == 2
    p = one(spark, geojson.parse(F.lit('{"type":"Point","coordinates":[1,2,3]}')))
    assert (p["parts"][0][0][0]["x"], p["parts"][0][0][0]["y"]) == (1, 2)


def test_png_and_colour(spark):
    data = images.png(np.zeros((2, 3, 4), np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and images.compress(np.zeros((2, 2), np.uint8), as_data_url=True).startswith("data:image/png;base64,")
    with pytest.raises(NotImplementedError):
        images.compress(np.zeros((2, 2), np.uint8), "jpeg")
    assert color.guess_rgb(["nbart_red", "nbart_green", "nbart_blue", "nir"]) == ("nbart_red", "nbart_green", "nbart_blue")
    c = one(spark, color.rgba(F.lit(-1), F.lit(5), F.lit(6), 0, 10, nodata=-1))
    assert tuple(c) == (0, 0, 0, 0)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(20).select((F.col("id") % 4).cast("double").alias("x"), F.lit(0.5).alias("y"), F.timestamp_seconds(F.col("id")).alias("ts")).write.parquet(src)
    s = spark.readStream.schema("x double, y double, ts timestamp").parquet(src)
    grid = tiles.GridSpec("EPSG:4326", (10, 10), (0.1, -0.1))
    q = bounds.tile_counts(s, grid, "x", "y", "ts", "1 minute", "1 minute").writeStream.outputMode("complete").format("memory").queryName("tile_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.sql("select * from tile_counts").collect()) == 20


@pytest.mark.parametrize("cell", [0.3, 1.0, 40.0])
def test_points_in_polygons_by_cells(spark, cell):
    """Cells inside, outside and crossed: the same pairs as every point with every polygon; holes, and points on edges and cell edges."""
    rng = np.random.default_rng(6)
    shapes = []
    for i in range(12):
        t, r = np.sort(rng.uniform(0, 2 * np.pi, 9)), rng.uniform(0.5, 3, 9)
        ring = np.stack([rng.uniform(-5, 5) + r * np.cos(t), rng.uniform(-5, 5) + r * np.sin(t)], 1)
        shapes.append((i, [[[(float(x), float(y)) for x, y in [*ring, ring[0]]]]]))
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    shapes.append((12, [[square(-6.0, 6.0), square(-3.0, 3.0)]]))
    xy = np.concatenate([rng.uniform(-8, 8, (400, 2)), rng.integers(-7, 8, (100, 2))])
    polys = spark.createDataFrame([(i, ("Polygon", None, parts)) for i, parts in shapes], "k int, g struct<type:string,crs:string,parts:array<array<array<struct<x:double,y:double>>>>>")
    pts = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(xy)], "n int, x double, y double")
    got = {(r.n, r.k) for r in join.point_in_polygon_join(pts, polys, "x", "y", "g", cell).collect()}
    want = set()
    for i, parts in shapes:
        inside = kernels.place(xy, {"type": "Polygon", "crs": None, "parts": [[np.array(r) for r in p] for p in parts]}, 0.0) > 0
        want |= {(int(n), i) for n in np.flatnonzero(inside)}
    assert got == want and len(want) > 300
