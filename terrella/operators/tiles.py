"""Tilings: regular grids in the world, fixed and variable tiles of a pixel plane, and which tiles something falls in."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import affine as A
from ..functions import bbox as B
from ..functions import geobox as G
from ..functions.scalar import bin_index, let
from .join import spread
from .scan import running_totals


@dataclass(frozen=True)
class GridSpec:
    """Infinite regular tiles in a reference system: tile shape in pixels (rows, columns), resolution (x, y), origin, directions."""

    crs: str
    tile_shape: tuple[int, int]
    resolution: tuple[float, float]
    origin: tuple[float, float] = (0.0, 0.0)
    flipx: bool = False
    flipy: bool = False

    @property
    def tile_size(self) -> tuple[float, float]:
        """World size (x, y) of a tile."""
        return abs(self.resolution[0]) * self.tile_shape[1], abs(self.resolution[1]) * self.tile_shape[0]

    @property
    def alignment(self) -> tuple[float, float]:
        return self.origin[0] % abs(self.resolution[0]), self.origin[1] % abs(self.resolution[1])

    @property
    def directions(self) -> tuple[int, int]:
        return -1 if self.flipx else 1, -1 if self.flipy else 1

    @classmethod
    def web_tiles(cls, zoom: int, npix: int = 256) -> GridSpec:
        """Slippy-map tiles: square, from the top left corner, rows downwards."""
        size = G.web_tile_size(zoom)
        half = math.pi * 6378137.0
        return cls("EPSG:3857", (npix, npix), (size / npix, -size / npix), (-half, half - size), flipy=True)

    @classmethod
    def from_sample_tile(cls, bounds: tuple[float, float, float, float], shape: tuple[int, int], index: tuple[int, int] = (0, 0), crs: str = "EPSG:4326", flipx: bool = False, flipy: bool = False) -> GridSpec:
        left, bottom, right, top = bounds
        dx, dy = right - left, top - bottom
        sx, sy = -1 if flipx else 1, -1 if flipy else 1
        return cls(crs, shape, (dx / shape[1], -dy / shape[0]), (left - sx * index[0] * dx, bottom - sy * index[1] * dy), flipx, flipy)

    def pt2idx(self, x: Column, y: Column) -> Column:
        """struct(ix, iy) of the tile under a point."""
        (sx, sy), (ox, oy), (dx, dy) = self.tile_size, self.origin, self.directions
        return F.struct(bin_index(x, sx, ox, dx).alias("ix"), bin_index(y, sy, oy, dy).alias("iy"))

    def tile_bbox(self, ix: Column, iy: Column) -> Column:
        (sx, sy), (ox, oy), (dx, dy) = self.tile_size, self.origin, self.directions
        left, bottom = ix * dx * sx + ox, iy * dy * sy + oy
        return B.bbox(left, bottom, left + sx, bottom + sy, self.crs)

    def tile_geobox(self, ix: Column, iy: Column) -> Column:
        b = self.tile_bbox(ix, iy)
        rx, ry = self.resolution
        m = A.affine(rx, 0.0, b["left"] if rx > 0 else b["right"], 0.0, ry, b["bottom"] if ry > 0 else b["top"])
        return G.geobox(self.tile_shape[0], self.tile_shape[1], m, self.crs)

    def idx_bounds(self, b: Column, tol: float = 1e-8) -> Column:
        """struct(x0, x1, y0, y1), half open, of the tiles that share an inner part of a box."""
        lo = self.pt2idx(b["left"] + tol, b["bottom"] + tol)
        hi = self.pt2idx(b["right"] - tol, b["top"] - tol)
        span = lambda k: (F.least(lo[k], hi[k]), F.greatest(lo[k], hi[k]) + 1)
        (x0, x1), (y0, y1) = span("ix"), span("iy")
        return F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))

    def explode_tiles(self, df: DataFrame, b: Column) -> DataFrame:
        """A row per (row, tile its box shares an inner part with): adds ix, iy."""
        w = df.withColumn("_span", self.idx_bounds(b))
        w = w.withColumn("iy", F.explode(F.sequence(F.col("_span.y0"), F.col("_span.y1") - 1)))
        return w.withColumn("ix", F.explode(F.sequence(F.col("_span.x0"), F.col("_span.x1") - 1))).drop("_span")

    def tiles_of_polygons(self, df: DataFrame, geom: Column) -> DataFrame:
        """A row per (row, tile that is not disjoint from its polygon): bounding-box range first, exact test on what is left."""
        from ..functions import geometry as Geo
        from .kernels import intersects

        w = self.explode_tiles(df.withColumn("_g", geom), Geo.boundingbox(F.col("_g")))
        w = w.withColumn("_b", Geo.from_bbox(self.tile_bbox(F.col("ix"), F.col("iy"))))
        return w.filter(intersects(F.col("_g"), F.col("_b"))).drop("_g", "_b")

    def geojson(self, df: DataFrame) -> DataFrame:
        """Of rows with ix, iy: a GeoJSON feature per tile."""
        from ..functions import geometry as Geo

        name = F.concat(F.lit('{"type":"Feature","properties":{"idx":['), F.col("ix").cast("string"), F.lit(","), F.col("iy").cast("string"), F.lit(']},"geometry":'))
        return df.withColumn("feature", F.concat(name, Geo.geojson(Geo.from_bbox(self.tile_bbox(F.col("ix"), F.col("iy")))), F.lit("}")))


def fixed_tiles(spark: SparkSession, ny: int, nx: int, th: int, tw: int) -> DataFrame:
    """Tiles of a plane: ty, tx, y0, y1, x0, x1; the last row and column may be smaller."""
    rows, cols = -(-ny // th), -(-nx // tw)
    t = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("ty"), (F.col("id") % cols).cast("int").alias("tx"))
    return t.select("ty", "tx", *tile_slices(F.col("ty"), F.col("tx"), ny, nx, th, tw))


def tile_slices(ty: Column, tx: Column, ny: int, nx: int, th: int, tw: int) -> list[Column]:
    return [
        (ty * th).alias("y0"), F.least(F.lit(ny), (ty + 1) * th).alias("y1"), (tx * tw).alias("x0"), F.least(F.lit(nx), (tx + 1) * tw).alias("x1"),
    ]


def locate(y: Column, x: Column, ny: int, nx: int, th: int, tw: int) -> Column:
    """struct(ty, tx) of a pixel; an error outside the plane."""
    ok = (y >= 0) & (y < ny) & (x >= 0) & (x < nx)
    bad = F.raise_error(F.lit("pixel outside the plane")).cast("int")
    return F.struct(F.when(ok, F.floor(y / th).cast("int")).otherwise(bad).alias("ty"), F.when(ok, F.floor(x / tw).cast("int")).otherwise(bad).alias("tx"))


def chunk_length(i: Column, n: int, t: int) -> Column:
    """Length of tile i along an axis; negative i counts from the end, others are an error."""
    count = -(-n // t)
    k = F.when(i < 0, i + count).otherwise(i)
    return F.when((k < 0) | (k >= count), F.raise_error(F.lit("no such tile")).cast("int")).when(k < count - 1, F.lit(t)).otherwise(F.lit(n - t * (count - 1)))


def chunks(n: int, t: int) -> tuple[int, ...]:
    return tuple(min(t, n - i) for i in range(0, n, t))


def offsets(chunk_table: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """start and stop of variable chunks, by key, in order of a number; a tiling of any length is spread over tasks (``scan``)."""
    return running_totals(chunk_table, {"stop": F.col(size)}, order, [key]).withColumn("start", F.col("stop") - F.col(size))


def numbered_chunks(chunk_table: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """``offsets`` with the number of each chunk from 0."""
    t = running_totals(chunk_table, {"stop": F.col(size), "_n": F.lit(1)}, order, [key])
    return t.withColumns({"start": F.col("stop") - F.col(size), "number": (F.col("_n") - 1).cast("int")}).drop("_n")


def crop_chunks(numbered: DataFrame, key: str, first: Column | int, last: Column | int) -> DataFrame:
    """Chunks ``first`` to ``last``, the latter excluded, of every tiling as a tiling of their own: numbers and offsets begin at 0."""
    first, last = (c if isinstance(c, Column) else F.lit(c) for c in (first, last))
    kept = numbered.filter((F.col("number") >= first) & (F.col("number") < last))
    low = kept.groupBy(F.col(key).alias("_k")).agg(F.min("number").alias("_n"), F.min("start").alias("_s"))
    t = kept.join(low, F.col(key).eqNullSafe(F.col("_k")))
    return t.withColumns({"number": F.col("number") - F.col("_n"), "start": F.col("start") - F.col("_s"), "stop": F.col("stop") - F.col("_s")}).drop("_k", "_n", "_s")


def variable_tiles(rows: DataFrame, cols: DataFrame, key: str) -> DataFrame:
    """Tiles (ty, tx, y0, y1, x0, x1, height, width) of the tilings whose axes two numbered chunk tables describe."""
    axis = lambda t, a, k: t.select(F.col(key).alias(k), F.col("number").alias(f"t{a}"), F.col("start").alias(f"{a}0"), F.col("stop").alias(f"{a}1"))
    t = axis(rows, "y", key).join(axis(cols, "x", "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    return t.withColumns({"height": F.col("y1") - F.col("y0"), "width": F.col("x1") - F.col("x0")})


def locate_variable(p: Column, sizes: tuple[int, ...]) -> Column:
    """Chunk number of a pixel among literal variable chunks."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    return F.when((p < 0) | (p >= total), F.raise_error(F.lit("pixel outside the plane")).cast("int")).otherwise(F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= p)))


def tile_range(b: Column, ny: int, nx: int, th: int, tw: int) -> Column:
    """struct(ty0, ty1, tx0, tx1), inclusive, of tiles under a pixel box; clamped, so a box outside takes an edge tile."""
    def axis(lo: Column, hi: Column, n: int, t: int) -> tuple[Column, Column]:
        a = F.least(F.greatest(F.floor(lo), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
        z = F.least(F.greatest(F.ceil(hi), F.lit(1).cast("long")), F.lit(n).cast("long")) - 1
        return F.floor(a / t).cast("int"), F.floor(z / t).cast("int")

    (y0, y1), (x0, x1) = axis(b["bottom"], b["top"], ny, th), axis(b["left"], b["right"], nx, tw)
    return F.struct(y0.alias("ty0"), y1.alias("ty1"), x0.alias("tx0"), x1.alias("tx1"))


def clip_tiles(selection: DataFrame, by: list[str]) -> DataFrame:
    """Tile ids (ty, tx) re-based to the smallest selected ones of their group."""
    w = Window.partitionBy(*by) if by else None
    if w is not None:
        return selection.withColumn("cy", F.col("ty") - F.min("ty").over(w)).withColumn("cx", F.col("tx") - F.min("tx").over(w))
    low = selection.agg(F.min("ty").alias("_y"), F.min("tx").alias("_x"))
    return selection.crossJoin(F.broadcast(low)).select("*", (F.col("ty") - F.col("_y")).alias("cy"), (F.col("tx") - F.col("_x")).alias("cx")).drop("_y", "_x")  # one row each side of an aggregate


def grid_intersect_linear(dst: DataFrame, m: Column, src: tuple[int, int, int, int]) -> DataFrame:
    """Source tiles (sy, sx) each destination tile (y0, y1, x0, x1) reads under m: X_src = m X_dst. No join: ranges are computed."""
    ny, nx, th, tw = src
    b = B.round_out(B.transform(B.bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), m))
    r = dst.withColumn("_r", tile_range(b, ny, nx, th, tw))
    r = r.withColumn("sy", F.explode(F.sequence(F.col("_r.ty0"), F.col("_r.ty1"))))
    return r.withColumn("sx", F.explode(F.sequence(F.col("_r.tx0"), F.col("_r.tx1")))).drop("_r")


def grid_intersect(dst: DataFrame, grid: Column, source: Column, target_crs, source_crs, src: tuple[int, int, int, int], per_side: int = 5) -> DataFrame:
    """Source tiles (sy, sx) that each row's destination tile ``grid`` meets, the systems and shapes being any.

    A tile's edge is mapped to the source's pixels. The tiles under its bounding box are generated by row, without a join,
    and decided exactly; a destination tile off the source image, or off its projection, meets none.
    """
    from ..functions import geometry as Geo
    from ..functions import reproject as R

    ny, nx, th, tw = src
    plane = B.bbox(F.lit(0), F.lit(0), F.lit(nx), F.lit(ny))
    facts = lambda g: F.struct(Geo.boundingbox(g).alias("b"), Geo.edges(g).alias("e"))
    # generated rather than projected: the optimiser would move the filter below a projection and compute the footprint again there
    out = spread(dst).withColumn("_g", F.explode(F.array(let(R.tile_footprint(grid, source, target_crs, source_crs, per_side), facts))))
    out = out.filter(B.overlaps(F.col("_g.b"), plane)).withColumn("_r", tile_range(F.col("_g.b"), ny, nx, th, tw))
    out = out.withColumn("sy", F.explode(F.sequence(F.col("_r.ty0"), F.col("_r.ty1")))).withColumn("sx", F.explode(F.sequence(F.col("_r.tx0"), F.col("_r.tx1"))))
    y0, y1, x0, x1 = tile_slices(F.col("sy"), F.col("sx"), ny, nx, th, tw)
    return out.filter(Geo.edges_meet_box(F.col("_g.e"), B.bbox(x0, y0, x1, y1))).drop("_g", "_r")


def tiles_of(selection: DataFrame, y: tuple[Column, Column], x: tuple[Column, Column], ny: int, nx: int, th: int, tw: int) -> DataFrame:
    """Tiles (ty, tx) that a half-open pixel region of each row touches; an empty region, none."""
    hit = selection.filter((y[1] > y[0]) & (x[1] > x[0]))
    hit = hit.withColumn("_r", tile_range(B.bbox(x[0], y[0], x[1], y[1]), ny, nx, th, tw))
    return hit.withColumn("ty", F.explode(F.sequence(F.col("_r.ty0"), F.col("_r.ty1")))).withColumn("tx", F.explode(F.sequence(F.col("_r.tx0"), F.col("_r.tx1")))).drop("_r")
