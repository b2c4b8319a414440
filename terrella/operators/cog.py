"""Tiled GeoTIFF layout and writing: layout on the driver, tiles compressed on executors, offsets by prefix sums."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import multipart

TYPES = {"uint8": (1, 8), "uint16": (1, 16), "uint32": (1, 32), "int8": (2, 8), "int16": (2, 16), "int32": (2, 32), "float32": (3, 32), "float64": (3, 64)}


@dataclass(frozen=True)
class Layout:
    """A level of a tiled image: shape, tile shape, planes."""

    shape: tuple[int, int]
    tile: tuple[int, int]
    planes: int = 1

    @property
    def chunked(self) -> tuple[int, int]:
        return ceil(self.shape[0] / self.tile[0]), ceil(self.shape[1] / self.tile[1])

    @property
    def num_tiles(self) -> int:
        return self.planes * self.chunked[0] * self.chunked[1]

    def flat_index(self, plane: int, y: int, x: int) -> int:
        ny, nx = self.chunked
        if not (0 <= plane < self.planes and 0 <= y < ny and 0 <= x < nx):
            raise IndexError((plane, y, x))
        return (plane * ny + y) * nx + x

    def tidx(self):
        return ((s, y, x) for s in range(self.planes) for y in range(self.chunked[0]) for x in range(self.chunked[1]))


def tile_side(block: int, dim: int = 0) -> int:
    """Side of a tile: whole units of 16 pixels that hold the block, or the image where that is smaller (dim 0: unknown)."""
    wanted = sorted((block, dim))[0] if dim > 0 else block
    return wanted + -wanted % 16


def halvings(dim: int, block: int) -> int:
    """How often dim is halved, rounding down, until one block holds it: the least n with dim < (block + 1) * 2**n."""
    return (dim // (block + 1)).bit_length()


def cog_spec(shape: tuple[int, int], tile: tuple[int, int], max_pad: int | None = None) -> tuple[tuple[int, int], tuple[int, int], int]:
    """Padded shape, tile and overview levels such that each level halves exactly."""
    tile = (tile_side(tile[0]), tile_side(tile[1]))
    levels = max(halvings(n, t) for t, n in zip(tile, shape))
    if max_pad is not None:
        while levels and any(-n % 2**levels > max_pad for n in shape):
            levels -= 1
    unit = 2**levels
    return (ceil(shape[0] / unit) * unit, ceil(shape[1] / unit) * unit), tile, levels


def layouts(shape: tuple[int, int], tile: tuple[int, int], levels: int, planes: int = 1) -> list[Layout]:
    return [Layout((max(1, shape[0] >> i), max(1, shape[1] >> i)), tile, planes) for i in range(levels + 1)]


def predictor(kind: str, wanted: bool | int | None = None) -> int:
    if wanted is False:
        return 1
    if isinstance(wanted, int) and not isinstance(wanted, bool):
        return wanted
    return 3 if np.dtype(kind).kind == "f" else 2


def encode_tile(a: np.ndarray, tile: tuple[int, int], level: int = 6, pred: int = 2, fill: float = 0) -> bytes:
    """Pad to the tile, difference along rows (2) or by byte plane (3), deflate."""
    if a.shape != tile:
        p = np.full(tile, fill, a.dtype)
        p[: a.shape[0], : a.shape[1]] = a
        a = p
    if pred == 2 and a.dtype.kind in "iu":
        u = a.view(f"u{a.itemsize}")
        a = np.concatenate([u[:, :1], u[:, 1:] - u[:, :-1]], 1)
        raw = a.tobytes()
    elif pred == 3 and a.dtype.kind == "f":
        planes = a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(*a.shape, a.itemsize).transpose(0, 2, 1).reshape(a.shape[0], -1)
        raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], 1).tobytes()
    else:
        raw = a.tobytes()
    return zlib.compress(raw, level)


def packed(tiles: DataFrame, values: str, dtype: str) -> DataFrame:
    """Tiles whose pixels are an array of numbers, row by row, with raw payload as ``data``."""

    @F.arrow_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        flat, n = v.flatten().to_numpy(zero_copy_only=False).astype(dtype), [len(x) for x in v]
        return pa.array([a.tobytes() for a in np.split(flat, np.cumsum(n)[:-1])] if n else [], pa.binary())

    return tiles.withColumn("data", run(F.col(values))).drop(values)


def compress_tiles(tiles: DataFrame, dtype: str, tile: tuple[int, int], level: int = 6, pred: int | None = None) -> DataFrame:
    """Rows (ifd, plane, ty, tx, h, w, data) with raw payload to the same with compressed payload and its size."""
    p = predictor(dtype) if pred is None else pred

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([encode_tile(np.frombuffer(d, dtype).reshape(a, b), tile, level, p) for d, a, b in zip(data, h, w)])

    return tiles.withColumn("data", run("data", "h", "w")).withColumn("size", F.octet_length("data").cast("long"))


def offsets(tiles: DataFrame, by: list[str], order: list[Column], size: str = "size", start: int = 0) -> DataFrame:
    """Byte offset of each tile within its file, in write order; empty tiles are at 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return tiles.withColumn("offset", F.when(F.col(size) > 0, F.sum(size).over(w) - F.col(size) + start).otherwise(F.lit(0)).cast("long"))


def write_order() -> list[Column]:
    """Smallest overview first, then planes, rows, columns."""
    return [F.col("ifd").desc(), F.col("plane"), F.col("ty"), F.col("tx")]


def geo_tags(m: tuple[float, ...], epsg: int | None, geographic: bool) -> list[tuple[int, int, list]]:
    """Pixel scale and tie point (or the matrix when rotated), and the key directory."""
    a, b, c, d, e, f = m
    tags: list[tuple[int, int, list]] = [(33550, 12, [a, -e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, c, f, 0.0])] if b == 0 and d == 0 else [(34264, 12, [a, b, 0.0, c, d, e, 0.0, f, *[0.0] * 7, 1.0])]
    keys = [1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1]
    if epsg:
        keys += [2048 if geographic else 3072, 0, 1, epsg]
    return [*tags, (34735, 3, [1, 1, 0, len(keys) // 4, *keys])]


def gdal_metadata(stats: list[dict[str, float]]) -> str:
    rows = [f'  <Item name="STATISTICS_{k.upper()}" sample="{i}">{v:.10g}</Item>' for i, s in enumerate(stats) for k, v in s.items()]
    return "\n".join(["<GDALMetadata>", *rows, "</GDALMetadata>"])


def bigtiff(levels: list[Layout], dtype: str, tables: list[tuple[list[int], list[int]]], tags: list[tuple[int, int, list]], pred: int, nodata: float | None = None, metadata: str | None = None) -> bytes:
    """Header and directories of a little-endian BigTIFF; tables give each level's tile offsets (from the end of the header) and sizes."""
    fmt, bits = TYPES[dtype]
    text = lambda s: list(s.encode() + b"\0")

    def entries(i: int, shift: int) -> list[tuple[int, int, list]]:
        v = levels[i]
        off, size = tables[i]
        out = [(254, 4, [1 if i else 0]), (256, 4, [v.shape[1]]), (257, 4, [v.shape[0]]), (258, 3, [bits] * v.planes), (259, 3, [8]), (262, 3, [1]), (277, 3, [v.planes]), (284, 3, [2 if v.planes > 1 else 1]), (317, 3, [pred]), (322, 4, [v.tile[1]]), (323, 4, [v.tile[0]]), (324, 16, [o + shift if n else 0 for o, n in zip(off, size)]), (325, 16, size), (339, 3, [fmt] * v.planes)]
        if not i:
            out += tags
            if nodata is not None:
                out.append((42113, 2, text(f"{nodata:g}")))
            if metadata:
                out.append((42112, 2, text(metadata)))
        return sorted(out)

    def build(shift: int) -> bytes:
        code = {2: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
        out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
        for i in range(len(levels)):
            e = entries(i, shift)
            tail = len(out) + 8 + 20 * len(e) + 8
            extra = bytearray()
            out += struct.pack("<Q", len(e))
            for tag, kind, values in e:
                data = struct.pack(f"<{len(values)}{code[kind]}", *values)
                out += struct.pack("<HHQ", tag, kind, len(values))
                if len(data) <= 8:
                    out += data.ljust(8, b"\0")
                else:
                    out += struct.pack("<Q", tail + len(extra))
                    extra += data + b"\0" * (-len(data) % 8)
            out += struct.pack("<Q", tail + len(extra) if i + 1 < len(levels) else 0) + extra
        return bytes(out)

    return build(len(build(0)))


class Parts:
    """Runs of pieces that make up the parts of a stream whose pieces are not to be cut; see ``multipart`` for cut ones."""

    def __init__(self, min_size: int = 5 << 20, max_size: int = 5 << 30, max_parts: int = 10_000):
        self.min_size, self.max_size, self.max_parts = min_size, max_size, max_parts

    def plan(self, sizes: list[int]) -> list[tuple[int, int]]:
        """Runs (first, last + 1) of pieces that make up the parts, each of min_size or more but the last."""
        out, start, held = [], 0, 0
        for i, n in enumerate(sizes):
            held += n
            if held >= self.min_size:
                out.append((start, i + 1))
                start, held = i + 1, 0
        if start < len(sizes):
            out.append((start, len(sizes)))
        if len(out) > self.max_parts:
            raise ValueError("too many parts: raise min_size")
        return out


def write_cog(tiles: DataFrame, path: str | multipart.Sink, levels: list[Layout], dtype: str, tags: list[tuple[int, int, list]], pred: int | None = None, nodata: float | None = None) -> int:
    """Write compressed tiles (ifd, plane, ty, tx, data, size) as one file, or to a sink; returns its size.

    The driver takes the table of sizes, which the header states, and makes the header; tiles are written by the tasks.
    """
    p = predictor(dtype) if pred is None else pred
    spark = tiles.sparkSession
    sizes = {(r["ifd"], r["plane"], r["ty"], r["tx"]): r["size"] for r in tiles.select("ifd", "plane", "ty", "tx", "size").collect()}
    at, places = 0, {}
    for i in range(len(levels) - 1, -1, -1):
        for t in levels[i].tidx():
            n = sizes.get((i, *t), 0)
            places[(i, *t)] = (at if n else 0, n)
            at += n
    tables = [([places[(i, *t)][0] for t in v.tidx()], [places[(i, *t)][1] for t in v.tidx()]) for i, v in enumerate(levels)]
    head = bigtiff(levels, dtype, tables, tags, p, nodata)
    # a row per tile, as the header has
    at_tile = spark.createDataFrame([(*k, len(head) + start) for k, (start, n) in places.items() if n] or [(-1, 0, 0, 0, 0)], "ifd int, plane int, ty int, tx int, offset long")
    body = tiles.select("ifd", "plane", "ty", "tx", "data").join(at_tile, ["ifd", "plane", "ty", "tx"]).select("offset", "data")
    first = spark.createDataFrame([(0, bytearray(head))], "offset long, data binary")
    multipart.write(first.unionByName(body), len(head) + at, multipart.FileSink(path) if isinstance(path, str) else path)
    return len(head) + at
