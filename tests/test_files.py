"""Multipart streams and GeoTIFF files written and read back."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from terrella.operators import cog, multipart
from terrella.sources import geotiff

DATA = bytes(np.random.default_rng(1).integers(0, 256, 103).astype(np.uint8))


@pytest.mark.parametrize("cuts", [[], [30, 50], [1, 2, 3, 99], list(range(1, 103)), [10, 20, 30], [103, 103], [0, 9, 11]])
def test_any_split_gives_the_same_parts(spark, tmp_path, cuts):
    edges = [0, *cuts, 103]
    pieces = spark.createDataFrame([(a, bytearray(DATA[a:b])) for a, b in zip(edges, edges[1:])], "offset long, data binary").repartition(3)
    sink = multipart.FileSink(str(tmp_path / "out"), least=10)
    parts = multipart.write(pieces, 103, sink)
    assert (tmp_path / "out").read_bytes() == DATA and not os.path.exists(sink.unfinished)
    assert parts == [(i, len(DATA[i * 10 : i * 10 + 10]), f"{zlib.crc32(DATA[i * 10 : i * 10 + 10]):08x}") for i in range(11)]


def test_limits_of_parts(spark, tmp_path):
    assert multipart.part_size(103, multipart.FileSink("x", least=1, count=10)) == 11
    with pytest.raises(ValueError, match="don't fit"):
        multipart.part_size(103, multipart.FileSink("x", least=1, most=10, count=10))
    for rows in ([(0, b"abc"), (4, b"ef")], [(0, b"abc"), (2, b"cdef")], [(0, b"abc")]):
        sink = multipart.FileSink(str(tmp_path / "bad"), least=2)
        with pytest.raises(Exception, match="gap|bytes up to"):
            multipart.write(spark.createDataFrame([(o, bytearray(d)) for o, d in rows], "offset long, data binary"), 6, sink)
        assert not (tmp_path / "bad").exists()
    assert multipart.write(spark.createDataFrame([], "offset long, data binary"), 0, multipart.FileSink(str(tmp_path / "none"))) == []


def image(dtype, shape, planes=1):
    a = np.random.default_rng(4).normal(0, 50, (planes, *shape)).cumsum(-1)
    return a.astype(dtype) if np.dtype(dtype).kind != "u" else np.abs(a).astype(dtype)


def written(spark, path, a, tile, levels=0, tags=None, nodata=None, skip=()):
    """A file of planes, each level every second pixel of the one before, and the levels' pixels."""
    planes, shape = a.shape[0], a.shape[1:]
    lay = cog.layouts(shape, tile, levels, planes)
    each, rows = [a], []
    for _ in range(levels):
        each.append(each[-1][:, ::2, ::2][:, : max(1, each[-1].shape[1] >> 1), : max(1, each[-1].shape[2] >> 1)])
    for i, v in enumerate(lay):
        for s, y, x in v.tidx():
            t = np.ascontiguousarray(each[i][s, y * tile[0] : (y + 1) * tile[0], x * tile[1] : (x + 1) * tile[1]])
            if (i, s, y, x) not in skip:
                rows.append((i, s, y, x, *t.shape, bytearray(t.tobytes())))
    df = cog.compress_tiles(spark.createDataFrame(rows, "ifd int, plane int, ty int, tx int, h int, w int, data binary"), a.dtype.name, tile)
    size = cog.write_cog(df, multipart.FileSink(path, least=512), lay, a.dtype.name, tags or [], nodata=nodata)
    assert os.path.getsize(path) == size
    return each


def assembled(rows, shape, dtype):
    out = {}
    for r in rows:
        plane = out.setdefault((r.level, r.plane), np.zeros(shape[r.level], dtype))
        if r.data is not None:
            plane[r.y : r.y + r.height, r.x : r.x + r.width] = np.frombuffer(bytes(r.data), r.dtype).reshape(r.height, r.width)
    return out


@pytest.mark.parametrize(("dtype", "planes"), [("uint8", 1), ("int16", 3), ("uint32", 1), ("float32", 2), ("float64", 1)])
def test_files_read_back(spark, tmp_path, dtype, planes):
    path = str(tmp_path / "a.tif")
    each = written(spark, path, image(dtype, (77, 90), planes), (16, 32), 2, cog.geo_tags((10.0, 0, 500.0, 0, -10.0, 900.0), 32633, False), nodata=-9.0)
    shapes = [e.shape[1:] for e in each]
    got = assembled(geotiff.tiles(spark, path).collect(), shapes, dtype)
    assert len(got) == 3 * planes and all((got[i, s] == each[i][s]).all() for i in range(3) for s in range(planes))
    first, second, _ = geotiff.images(spark, path).orderBy("level").collect()
    assert (first.ny, first.nx, first.tile_y, first.tile_x, first.planes, first.dtype, first.nodata, first.epsg, first.compression) == (77, 90, 16, 32, planes, dtype, -9.0, 32633, 8)
    assert tuple(first.m) == (10.0, 0.0, 500.0, 0.0, -10.0, 900.0) and second.epsg == 32633 and second.m.a == pytest.approx(20.0) and second.m.c == 500.0


def test_pruning_by_level_and_bounds(spark, tmp_path):
    """Tiles out of the box or of other levels are in no partition; pushed filters prune alike."""
    path = str(tmp_path / "b.tif")
    a = image("int16", (128, 128))
    written(spark, path, a, (16, 16), 1, cog.geo_tags((1.0, 0, 0.0, 0, -1.0, 128.0), 3857, False), skip={(0, 0, 7, 0)})
    reader = geotiff.TileReader(str(tmp_path), {"level": "0", "bbox": "20,40,40,70"})
    want = {(ty, tx) for ty in range(8) for tx in range(8) if tx * 16 < 40 and tx * 16 + 16 > 20 and 128 - ty * 16 > 40 and 112 - ty * 16 < 70}
    assert {(p.ty, p.tx) for r in reader.partitions() for p in r.pieces} == want and len(want) == 6
    got = geotiff.tiles(spark, path, 0, (20, 40, 40, 70)).collect()
    assert {(r.ty, r.tx) for r in got} == want and {r.level for r in got} == {0}
    assert all((np.frombuffer(bytes(r.data), "int16").reshape(16, 16) == a[0, r.y : r.y + 16, r.x : r.x + 16]).all() for r in got)
    seen = geotiff.tiles(spark, path).filter((F.col("level") == 0) & (F.col("left") < 40) & (F.col("right") > 20) & (F.col("bottom") < 70) & (F.col("top") > 40))
    assert {(r.ty, r.tx) for r in seen.collect()} == want
    pushed = geotiff.TileReader(str(tmp_path), {})
    filters = [D.EqualTo(("level",), 0), D.LessThan(("left",), 40.0), D.GreaterThan(("right",), 20.0), D.LessThan(("bottom",), 70.0), D.GreaterThan(("top",), 40.0), D.EqualTo(("dtype",), "int16")]
    assert list(pushed.pushFilters(filters)) == filters and {(p.ty, p.tx) for r in pushed.partitions() for p in r.pieces} == want
    gone = geotiff.tiles(spark, path, 0).filter("data IS NULL").collect()
    assert [(r.ty, r.tx) for r in gone] == [(7, 0)] and geotiff.tiles(spark, path, 5).count() == 0


def classic(order, tags, data):
    """A plain TIFF file: header, pixel data, one directory."""
    kinds = {2: "s", 3: "H", 4: "I", 12: "d"}
    body = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(data)) + data
    table, extra = struct.pack(order + "H", len(tags)), b""
    base = len(body) + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags):
        raw = values if kind == 2 else struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", base + len(extra))
        extra += raw if len(raw) > 4 else b""
        table += struct.pack(order + "HHI", tag, kind, len(values)) + value
    return body + table + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_strips_and_control_points(spark, tmp_path, order):
    """A striped file of three samples a pixel in either byte order, with control points instead of an affine."""
    a = image("uint16", (7, 5), 3).transpose(1, 2, 0)
    raw = a.astype(np.dtype("uint16").newbyteorder(order)).tobytes()
    points = [(0, 0, 0, 10.0, 20.0, 0), (5, 0, 0, 11.0, 20.5, 0), (0, 7, 0, 10.5, 19.0, 0), (5, 7, 0, 11.5, 19.5, 0)]
    tags = [(256, 3, [5]), (257, 3, [7]), (258, 3, [16] * 3), (259, 3, [1]), (277, 3, [3]), (278, 3, [4]), (273, 4, [8, 8 + 4 * 30]), (279, 4, [120, 90]), (339, 3, [1] * 3)]
    tags += [(33922, 12, [v for p in points for v in p]), (34735, 3, [1, 1, 0, 1, 2048, 0, 1, 4326])]
    (tmp_path / "c.tif").write_bytes(classic(order, tags, raw))
    got = assembled(geotiff.tiles(spark, str(tmp_path)).collect(), [(7, 5)], "uint16")
    assert all((got[0, s] == a[:, :, s]).all() for s in range(3))
    row = geotiff.images(spark, str(tmp_path)).first()
    assert row.m is None and row.epsg == 4326 and [tuple(g) for g in row.gcps] == [(p[0], p[1], p[3], p[4]) for p in points]
