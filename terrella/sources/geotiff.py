"""GeoTIFF as a Spark data source: a row per tile or strip, or, by option ``what="images"``, a row per image of a file.

Planning reads the directories of files, no pixels: a partition is a run of byte ranges of one file of about ``PART_BYTES``.
Options and pushed filters on level, plane and bounds drop tiles before that, so their bytes are never read. Classic and big
files of either byte order, tiles and strips, planes apart or together, no compression or deflate, differencing by rows or
byte planes are read; other codecs raise. Paths are local ones or URIs that Arrow can open, and must be reachable from the
driver and all executors.

Defined cases: a tile of no bytes has null data; tiles at the edge are cut to the image; a file without georeference has null
affine and bounds by pixels, rows counted downwards from 0.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..session import ship

PART_BYTES, HEAD = 32 << 20, 1 << 16
#: Kinds of values in a directory: letter and size (fixed values).
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SAMPLES = {1: "uint", 2: "int", 3: "float"}
AFFINE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
TILES = f"path string, level int, plane int, ty int, tx int, y int, x int, height int, width int, left double, bottom double, right double, top double, dtype string, nodata double, epsg int, m {AFFINE}, data binary"
IMAGES = f"path string, level int, ny int, nx int, tile_y int, tile_x int, planes int, dtype string, nodata double, epsg int, m {AFFINE}, compression int, predictor int, gcps array<struct<px:double,py:double,wx:double,wy:double>>, bytes long"


def _filesystem(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The file, or the .tif and .tiff files under a folder, in order of name."""
    from pyarrow import fs

    system, at = _filesystem(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    lead = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(lead + i.path for i in found if i.type == fs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))


class Ranges:
    """Byte ranges of a file; its first bytes are read once."""

    def __init__(self, path: str):
        system, at = _filesystem(path)
        self.file = system.open_input_file(at)
        self.head = self.file.read_at(HEAD, 0)

    def __call__(self, start: int, n: int) -> bytes:
        return self.head[start : start + n] if start + n <= len(self.head) else self.file.read_at(n, start)


def directories(read: Ranges) -> Iterator[dict[int, tuple]]:
    """Tags of each directory of a file."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    version = struct.unpack(order + "H", read(2, 2))[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), read(8, 8) if big else read(4, 4))[0]
    count, entry, word = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    while at:
        n = struct.unpack(order + count, read(at, struct.calcsize("=" + count)))[0]
        at += struct.calcsize("=" + count)
        width = struct.calcsize("=" + entry) + word
        table = read(at, n * width + word)
        tags = {}
        for i in range(n):
            row = table[i * width : (i + 1) * width]
            tag, kind, size = struct.unpack(order + entry, row[:-word])
            if kind not in KINDS:
                continue
            code = KINDS[kind]
            form = f"{order}{size}s" if code == "s" else order + code * size if len(code) > 1 else f"{order}{size}{code}"
            bytes_ = struct.calcsize(form)
            tags[tag] = struct.unpack(form, row[-word:][:bytes_] if bytes_ <= word else read(struct.unpack(order + ("Q" if big else "I"), row[-word:])[0], bytes_))
        tags[0] = (order,)
        yield tags
        at = struct.unpack(order + ("Q" if big else "I"), table[n * width :][:word])[0]


@dataclass
class Image:
    """What a directory says about one level of a file."""

    path: str
    level: int
    tags: dict[int, tuple] = field(repr=False)

    def one(self, tag: int, default: Any = None) -> Any:
        return self.tags.get(tag, (default,))[0]

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(257), self.one(256)

    @property
    def tile(self) -> tuple[int, int]:
        return (self.one(323), self.one(322)) if 322 in self.tags else (min(self.one(278, self.shape[0]), self.shape[0]), self.shape[1])

    @property
    def planes(self) -> int:
        return self.one(277, 1)

    @property
    def apart(self) -> bool:
        return self.one(284, 1) == 2 and self.planes > 1

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{SAMPLES[self.one(339, 1)]}{self.one(258, 1)}")

    @property
    def nodata(self) -> float | None:
        text = self.one(42113, b"").split(b"\0")[0].strip()
        return float(text) if text else None

    @property
    def keys(self) -> dict[int, int]:
        k = self.tags.get(34735, ())
        return {k[i]: k[i + 3] for i in range(4, len(k) - 3, 4) if k[i + 1] == 0}

    @property
    def epsg(self) -> int | None:
        code = self.keys.get(3072) or self.keys.get(2048)
        return code if code and code != 32767 else None

    @property
    def gcps(self) -> list[dict[str, float]] | None:
        t = self.tags.get(33922, ())
        if len(t) <= 6 or 33550 in self.tags or 34264 in self.tags:
            return None
        return [{"px": t[i], "py": t[i + 1], "wx": t[i + 3], "wy": t[i + 4]} for i in range(0, len(t), 6)]

    @property
    def affine(self) -> tuple[float, ...] | None:
        """World from pixel corners; a file that places pixel middles is moved by half a pixel."""
        if 34264 in self.tags:
            t = self.tags[34264]
            m = (t[0], t[1], t[3], t[4], t[5], t[7])
        elif 33550 in self.tags and 33922 in self.tags:
            (sx, sy), (i, j, _, x, y) = self.tags[33550][:2], self.tags[33922][:5]
            m = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        else:
            return None
        if self.keys.get(1025) == 2:
            a, b, c, d, e, f = m
            m = (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2)
        return m

    @property
    def grid(self) -> tuple[int, int]:
        return tuple(ceil(n / t) for n, t in zip(self.shape, self.tile))


def images_of(path: str, read: Ranges | None = None) -> list[Image]:
    """The levels of a file, masks left out; a reduced image has the first one's place in the world, with its own resolution."""
    found = [t for t in directories(read or Ranges(path)) if not (t.get(254, (0,))[0] & 4)]
    out = [Image(path, i, t) for i, t in enumerate(found)]
    for i in out[1:]:
        for tag in (34735, 42113):
            if tag in out[0].tags:
                i.tags.setdefault(tag, out[0].tags[tag])
        m = out[0].affine
        if m and not i.affine:
            sy, sx = (n / k for n, k in zip(out[0].shape, i.shape))
            a, b, c, d, e, f = m
            i.tags[34264] = (a * sx, b * sy, 0.0, c, d * sx, e * sy, 0.0, f)
            i.tags[34735] = tuple(v for k in zip(*[iter(i.tags.get(34735, (1, 1, 0, 0)))] * 4) if k[0] != 1025 for v in k)  # moved already
    return out


class Piece(NamedTuple):
    """A tile: its image, place and byte range."""

    level: int
    plane: int
    ty: int
    tx: int
    start: int
    size: int
    bounds: tuple[float, float, float, float]


def bounds_of(image: Image, ty: int, tx: int) -> tuple[float, float, float, float]:
    (h, w), (ny, nx) = image.tile, image.shape
    corners = [(x, y) for x in (tx * w, min(nx, (tx + 1) * w)) for y in (ty * h, min(ny, (ty + 1) * h))]
    a, b, c, d, e, f = image.affine or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    xs, ys = zip(*((a * x + b * y + c, d * x + e * y + f) for x, y in corners))
    return min(xs), min(ys), max(xs), max(ys)


def pieces_of(image: Image) -> Iterator[Piece]:
    starts, sizes = (image.tags.get(t, image.tags.get(s)) for t, s in ((324, 273), (325, 279)))
    gy, gx = image.grid
    for k in range((image.planes if image.apart else 1) * gy * gx):
        plane, at = divmod(k, gy * gx)
        ty, tx = divmod(at, gx)
        yield Piece(image.level, plane, ty, tx, starts[k], sizes[k], bounds_of(image, ty, tx))


def decode_tile(image: Image, piece: Piece, data: bytes) -> list[tuple[int, np.ndarray]]:
    """Planes of a tile, cut to the image, in the machine's byte order."""
    codec, predictor, kind = image.one(259, 1), image.one(317, 1), image.dtype
    if codec in (8, 32946):
        data = zlib.decompress(data)
    elif codec != 1:
        raise NotImplementedError(f"TIFF compression {codec}")
    (h, w), samples = image.tile, 1 if image.apart else image.planes
    rows = len(data) // (w * samples * kind.itemsize)  # the last strip is shorter
    if predictor == 3:
        raw = np.frombuffer(data, np.uint8).reshape(rows, -1, samples)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, w * samples)
        a = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, w, samples)
    else:
        a = np.frombuffer(data, kind.newbyteorder(image.one(0))).reshape(rows, w, samples)
        if predictor == 2:
            a = np.cumsum(a.astype(kind).view(f"u{kind.itemsize}"), axis=1, dtype=f"u{kind.itemsize}").view(kind)
    ny, nx = (min(t, n - i * t) for t, n, i in zip((h, w), image.shape, (piece.ty, piece.tx)))
    return [(piece.plane + s, np.ascontiguousarray(a[:ny, :nx, s]).astype(kind)) for s in range(samples)]


@dataclass
class Run(InputPartition):
    """Tiles of one file that a task reads."""

    path: str
    pieces: list[Piece]


COMPARE = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}
PLACES = {"level": 0, "plane": 1, "ty": 2, "tx": 3}
BOUNDS = {"left": 0, "bottom": 1, "right": 2, "top": 3}


class TileReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.tests = path, []
        if "level" in options:
            self.tests.append((EqualTo, "level", int(options["level"])))
        if "bbox" in options:
            left, bottom, right, top = map(float, options["bbox"].split(","))
            self.tests += [(LessThan, "left", right), (GreaterThan, "right", left), (LessThan, "bottom", top), (GreaterThan, "top", bottom)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of a tile's place or bounds with a value drop tiles; Spark applies all filters again."""
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in (*PLACES, *BOUNDS):
                self.tests.append((type(f), f.attribute[0], f.value))
            yield f

    def wanted(self, p: Piece, apart: bool = True) -> bool:
        """Whether a tile can pass; planes stored together pass together."""
        of = lambda n: p[PLACES[n]] if n in PLACES else p.bounds[BOUNDS[n]]
        return all(COMPARE[kind](of(n), v) for kind, n, v in self.tests if apart or n != "plane")

    def runs(self, path: str) -> list[Run]:
        out: list[Run] = []
        held = 0
        for image in images_of(path):
            for p in pieces_of(image):
                if self.wanted(p, image.apart or image.planes == 1):
                    if not out or held + p.size > PART_BYTES:
                        out.append(Run(path, []))
                        held = 0
                    out[-1].pieces.append(p)
                    held += p.size
        return out

    def partitions(self) -> list[Run]:
        with ThreadPoolExecutor(16) as pool:
            return [r for found in pool.map(self.runs, files_of(self.path)) for r in found]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not isinstance(partition, Run):  # no tile is wanted
            return
        read = Ranges(partition.path)
        images = {i.level: i for i in images_of(partition.path, read)}
        for p in partition.pieces:
            i = images[p.level]
            (h, w), m = i.tile, i.affine
            ny, nx = (min(t, n - k * t) for t, n, k in zip((h, w), i.shape, (p.ty, p.tx)))
            found = decode_tile(i, p, read(p.start, p.size)) if p.size else [(p.plane + s, None) for s in range(1 if i.apart else i.planes)]
            for plane, a in found:
                yield (p and partition.path, p.level, plane, p.ty, p.tx, p.ty * h, p.tx * w, ny, nx, *p.bounds, i.dtype.name, i.nodata, i.epsg, m, None if a is None else a.tobytes())


class ImageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Run]:
        return [Run(p, []) for p in files_of(self.path)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not isinstance(partition, Run):
            return
        for i in images_of(partition.path):
            gcps = [tuple(g.values()) for g in i.gcps] if i.gcps else None
            yield (partition.path, i.level, *i.shape, *i.tile, i.planes, i.dtype.name, i.nodata, i.epsg, i.affine, i.one(259, 1), i.one(317, 1), gcps, sum(i.tags.get(325, i.tags.get(279))))


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return IMAGES if self.options.get("what") == "images" else TILES

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        return ImageReader(path) if self.options.get("what") == "images" else TileReader(path, self.options)


def _registered(spark: SparkSession):
    """The session's reader, with the source known and filters pushed to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    return spark.read


def tiles(spark: SparkSession, path: str, level: int | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Tiles of a file or folder: of one level, and of those whose bounds overlap a box in the files' system."""
    r = _registered(spark).format("geotiff")
    if level is not None:
        r = r.option("level", level)
    if bbox:
        r = r.option("bbox", ",".join(map(repr, map(float, bbox))))
    return r.load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Grid, system, control points, nodata and block layout of every image of a file or folder."""
    return _registered(spark).format("geotiff").option("what", "images").load(path)


def pixels(tiles: DataFrame) -> DataFrame:
    """A row per pixel of tiles: path, level, plane, y, x, value; pixels of nodata and not-a-number, and tiles without data, have none."""
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, level, plane, y, x, h, w, kind, nodata, data in zip(*(c.to_pylist() for c in b.columns)):
                if data is None:
                    continue
                a = np.frombuffer(data, kind).astype(np.float64)
                keep = np.flatnonzero(~np.isnan(a) if nodata is None else ~np.isnan(a) & (a != nodata))
                n, (dy, dx) = len(keep), np.divmod(keep.astype(np.int32), np.int32(w))
                columns = [pa.array([path] * n, pa.string()), *(pa.array(np.full(n, v, np.int32)) for v in (level, plane)), pa.array(dy + np.int32(y)), pa.array(dx + np.int32(x)), pa.array(a[keep])]
                yield pa.record_batch(columns, ["path", "level", "plane", "y", "x", "value"])

    return tiles.select("path", "level", "plane", "y", "x", "height", "width", "dtype", "nodata", "data").mapInArrow(rows, "path string, level int, plane int, y int, x int, value double")
