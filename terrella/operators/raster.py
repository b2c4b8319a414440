"""Rasters as pixel rows (raster, y, x, value) for what SQL reduces, and as tile rows with binary payload for kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine as A
from ..functions.scalar import finite

#: Names of resampling methods (fixed values).
METHODS = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "min", "max", "med", "q1", "q3")
REDUCERS = {
    "average": F.avg, "min": F.min, "max": F.max, "med": lambda v: F.percentile(v, F.lit(0.5)), "q1": lambda v: F.percentile(v, F.lit(0.25)), "q3": lambda v: F.percentile(v, F.lit(0.75)),
}


def resampling(name: str) -> str:
    if name.lower() not in METHODS:
        raise ValueError(f"no such resampling: {name}")
    return name.lower()


def is_nearest(name: str) -> bool:
    return resampling(name) == "nearest"


def valid(v: Column, nodata: float | None = None) -> Column:
    """The value, or null where it is NaN or nodata."""
    ok = ~F.isnan(v.cast("double"))
    return F.when(ok if nodata is None else ok & (v != nodata), v)


def fill_value(dst_nodata: float | None, src_nodata: float | None, floating: bool) -> float | int:
    return dst_nodata if dst_nodata is not None else src_nodata if src_nodata is not None else float("nan") if floating else 0


def stats(pixels: DataFrame, by: list[str], value: str = "value", nodata: float | None = None) -> DataFrame:
    """minimum, maximum, mean, population deviation and valid percentage; one pass with map-side combine."""
    v = valid(F.col(value), nodata)
    return pixels.groupBy(*by).agg(
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), (F.count(v) * 100.0 / F.count(F.lit(1))).alias("valid_percent")
    )


def overview(pixels: DataFrame, by: list[str], factor: int = 2, how: str = "average", value: str = "value") -> DataFrame:
    """Shrink by a whole factor: pixel (y, x) takes its factor x factor block."""
    how = resampling(how)
    y, x = F.floor(F.col("y") / factor).cast("int"), F.floor(F.col("x") / factor).cast("int")
    grouped = pixels.withColumn("y", y).withColumn("x", x)
    if how == "nearest":
        at = pixels.filter((F.col("y") % factor == factor // 2) & (F.col("x") % factor == factor // 2))
        return at.select(*by, y.alias("y"), x.alias("x"), F.col(value))
    if how == "mode":  # the smallest among equally frequent values
        counts = grouped.groupBy(*by, "y", "x", value).agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy(*by, "y", "x").agg((F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))).alias("_m")).select(*by, "y", "x", F.col("_m.v").alias(value))
    if how not in REDUCERS:
        raise ValueError(f"{how} needs neighbours: use warp")
    return grouped.groupBy(*by, "y", "x").agg(REDUCERS[how](F.col(value)).alias(value))


def pyramid(pixels: DataFrame, by: list[str], levels: int, how: str = "average", value: str = "value") -> list[DataFrame]:
    """Overviews, each from the one before."""
    out, now = [], pixels
    for _ in range(levels):
        now = overview(now, by, 2, how, value)
        out.append(now)
    return out


def reproject_nearest(dst: DataFrame, src: DataFrame, m: Column, by: list[str], shape: tuple[int, int], value: str = "value", fill: float | None = None) -> DataFrame:
    """Each destination pixel (y, x) takes the source pixel under its centre: an equi-join on computed indices. m: dst to src."""
    u, v = A.apply(m, F.col("x") + 0.5, F.col("y") + 0.5)
    ny, nx = shape
    placed = dst.withColumn("_sy", F.floor(v).cast("int")).withColumn("_sx", F.floor(u).cast("int"))
    s = src.select(*by, F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value))
    out = placed.join(s, [*by, "_sy", "_sx"], "left").drop("_sy", "_sx")
    return out if fill is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def mask(pixels: DataFrame, inside: Column, value: str = "value", invert: bool = False) -> DataFrame:
    """Values outside a predicate become null."""
    return pixels.withColumn(value, F.when(~inside if invert else inside, F.col(value)))


def crop(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """A window, re-based; the filter reaches the scan."""
    w = pixels.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return w.withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def rasterize(tiles: DataFrame, geom: dict, m: tuple[float, ...], all_touched: bool = False) -> DataFrame:
    """Of tiles (ty, tx, y0, y1, x0, x1): a boolean payload, true for pixels whose centre is in a polygon, or that it touches at all."""
    from .kernels import _segments, place

    a, b, c, d, e, f = m

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = _segments(geom)
        for frame in frames:
            data = []
            for t in frame.itertuples():
                yy, xx = np.mgrid[t.y0 : t.y1, t.x0 : t.x1] + 0.5
                pts = np.stack([a * xx.ravel() + b * yy.ravel() + c, d * xx.ravel() + e * yy.ravel() + f], 1)
                hit = place(pts, geom) > 0
                if all_touched and len(seg):
                    inv = np.linalg.inv(np.array([[a, b], [d, e]]))
                    for s in seg:
                        p, q = inv @ (s[:2] - [c, f]), inv @ (s[2:] - [c, f])
                        n = int(np.abs(q - p).max() * 8) + 2
                        cells = np.floor(p + (q - p) * np.linspace(0, 1, n)[:, None]).astype(int)
                        ok = (cells[:, 0] >= t.x0) & (cells[:, 0] < t.x1) & (cells[:, 1] >= t.y0) & (cells[:, 1] < t.y1)
                        hit[(cells[ok, 1] - t.y0) * (t.x1 - t.x0) + cells[ok, 0] - t.x0] = True
                data.append(hit.astype(np.uint8).tobytes())
            yield frame.assign(data=data)

    return tiles.mapInPandas(run, "ty int, tx int, y0 int, y1 int, x0 int, x1 int, data binary")


def _weights(t: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and weights of a separable kernel at fractions t from the pixel centre to the left."""
    if how == "bilinear":
        return np.array([0, 1]), np.stack([1 - t, t], -1)
    if how == "lanczos":
        o = np.arange(-2, 4)
        z = t[..., None] - o
        w = np.sinc(z) * np.sinc(z / 3) * (np.abs(z) < 3)
        return o, w / w.sum(-1, keepdims=True)
    o = np.array([-1, 0, 1, 2])
    z = np.abs(t[..., None] - o)
    if how == "cubic":
        w = np.where(z <= 1, 1.5 * z**3 - 2.5 * z**2 + 1, np.where(z < 2, -0.5 * z**3 + 2.5 * z**2 - 4 * z + 2, 0))
    else:
        w = np.where(z <= 1, (4 - 6 * z**2 + 3 * z**3) / 6, np.where(z < 2, (2 - z) ** 3 / 6, 0))
    return o, w


def warp(src: np.ndarray, shape: tuple[int, int], m: tuple[float, ...], how: str = "nearest", nodata: float | None = None, fill: float | None = None) -> np.ndarray:
    """Resample a plane onto a shape under the affine m from destination to source pixels.

    Weights of missing pixels are spread over the others; a pixel without any is filled. Booleans pass through 0..255 and
    are true above 127; int8 passes through int16.
    """
    how = resampling(how)
    kind = src.dtype
    work = src.astype(np.float64) * 255 if kind == bool else src.astype(np.float64)
    empty = np.nan if fill is None and kind.kind == "f" else fill if fill is not None else nodata if nodata is not None else 0
    a, b, c, d, e, f = m
    yy, xx = np.mgrid[: shape[0], : shape[1]] + 0.5
    u, v = a * xx + b * yy + c, d * xx + e * yy + f
    ny, nx = src.shape
    ok = ~np.isnan(work) if nodata is None else ~np.isnan(work) & (work != nodata)
    inside = (u >= 0) & (u < nx) & (v >= 0) & (v < ny)
    if how == "nearest":
        iy, ix = np.clip(np.floor(v).astype(int), 0, ny - 1), np.clip(np.floor(u).astype(int), 0, nx - 1)
        out, good = work[iy, ix], inside & ok[iy, ix]
    elif how in ("bilinear", "cubic", "cubic_spline", "lanczos"):
        fu, fv = np.floor(u - 0.5), np.floor(v - 0.5)
        ox, wx = _weights(u - 0.5 - fu, how)
        oy, wy = _weights(v - 0.5 - fv, how)
        total, weight = np.zeros(shape), np.zeros(shape)
        for i, dy in enumerate(oy):
            for j, dx in enumerate(ox):
                iy, ix = (fv + dy).astype(int), (fu + dx).astype(int)
                there = (iy >= 0) & (iy < ny) & (ix >= 0) & (ix < nx)
                iy, ix = np.clip(iy, 0, ny - 1), np.clip(ix, 0, nx - 1)
                w = wy[..., i] * wx[..., j] * (there & ok[iy, ix])
                total += w * np.where(ok[iy, ix], work[iy, ix], 0)
                weight += w
        good = inside & (np.abs(weight) > 1e-9)
        out = np.divide(total, weight, out=np.zeros(shape), where=good)
    else:
        out, good = np.zeros(shape), np.zeros(shape, bool)
        op = {"average": np.mean, "min": np.min, "max": np.max, "med": np.median, "q1": lambda z: np.quantile(z, 0.25), "q3": lambda z: np.quantile(z, 0.75), "mode": lambda z: (lambda k: k[0][k[1].argmax()])(np.unique(z, return_counts=True))}[how]
        for y in range(shape[0]):
            for x in range(shape[1]):
                cx, cy = [a * (x + i) + b * (y + j) + c for i in (0, 1) for j in (0, 1)], [d * (x + i) + e * (y + j) + f for i in (0, 1) for j in (0, 1)]
                y0, y1, x0, x1 = max(int(np.floor(min(cy) + 1e-9)), 0), min(int(np.ceil(max(cy) - 1e-9)), ny), max(int(np.floor(min(cx) + 1e-9)), 0), min(int(np.ceil(max(cx) - 1e-9)), nx)
                z = work[y0:y1, x0:x1][ok[y0:y1, x0:x1]]
                if len(z):
                    out[y, x], good[y, x] = op(z), True
    out = np.where(good, out, empty)
    if kind == bool:
        return out > 127
    if kind.kind in "iu":
        info = np.iinfo(kind)
        return np.clip(np.rint(out), info.min, info.max).astype(kind)
    return out.astype(kind)


def assemble(blocks: dict[tuple[int, int], np.ndarray], chunks: tuple[tuple[int, ...], tuple[int, ...]], fill: float | None = None, dtype=None) -> np.ndarray:
    """A dense plane of sparse (ty, tx) blocks; missing ones are filled (NaN for floats, 0 for integers)."""
    kind = np.dtype(dtype) if dtype is not None else np.result_type(*(b.dtype for b in blocks.values())) if blocks else np.dtype("float32")
    y, x = (np.concatenate([[0], np.cumsum(c)]) for c in chunks)
    out = np.full((y[-1], x[-1]), (np.nan if kind.kind == "f" else 0) if fill is None else fill, kind)
    for (ty, tx), b in blocks.items():
        out[y[ty] : y[ty + 1], x[tx] : x[tx + 1]] = b
    return out


def reproject_tiles(deps: DataFrame, m: tuple[float, ...], src_shape: tuple[int, int], dtype: str, how: str = "nearest", nodata: float | None = None, fill: float | None = None) -> DataFrame:
    """Chunked warp: rows (raster, ty, tx, y0, y1, x0, x1, sy0, sy1, sx0, sx1, data), a destination tile with each source tile it reads.

    A group holds one destination tile's few sources, whatever the raster's size.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        t = frame.iloc[0]
        r = frame.dropna(subset=["data"])
        kind = np.dtype(dtype)
        shape = (int(t.y1 - t.y0), int(t.x1 - t.x0))
        a, b, c, d, e, f = m
        if r.empty:
            out = np.full(shape, fill_value(fill, nodata, kind.kind == "f"), kind)
        else:
            y0, y1, x0, x1 = int(r.sy0.min()), int(r.sy1.max()), int(r.sx0.min()), int(r.sx1.max())
            plane = np.full((y1 - y0, x1 - x0), fill_value(nodata, None, kind.kind == "f"), kind)
            for s in r.itertuples():
                plane[int(s.sy0) - y0 : int(s.sy1) - y0, int(s.sx0) - x0 : int(s.sx1) - x0] = np.frombuffer(s.data, kind).reshape(int(s.sy1 - s.sy0), int(s.sx1 - s.sx0))
            local = (a, b, a * t.x0 + b * t.y0 + c - x0, d, e, d * t.x0 + e * t.y0 + f - y0)
            out = warp(plane, shape, local, how, nodata, fill)
        return pd.DataFrame({"raster": [t.raster], "ty": [int(t.ty)], "tx": [int(t.tx)], "data": [out.tobytes()]})

    return deps.groupBy("raster", "ty", "tx").applyInPandas(run, "raster long, ty int, tx int, data binary")


def fixed_point(v: Column, top: int = 65535) -> Column:
    return F.least(F.greatest(v * top + 0.5, F.lit(0.0)), F.lit(float(top))).cast("int")


def from_fixed_point(v: Column, top: int = 65535) -> Column:
    return v / F.lit(float(top))


def axis_affine(pixels: DataFrame, by: list[str], index: str, value: str) -> DataFrame:
    """resolution and offset of a coordinate axis, per group."""
    from ..functions.scalar import axis_fit

    res, off = axis_fit(F.col(value), F.col(index))
    return pixels.groupBy(*by).agg(res.alias("resolution"), off.alias("offset"))


def spatial_dims(names: list[str], relaxed: bool = False) -> tuple[str, str] | None:
    """Names of the y and x columns: known pairs first, the last two if relaxed."""
    for pair in (("y", "x"), ("latitude", "longitude"), ("lat", "lon")):
        if all(p in names for p in pair):
            return pair
    return (names[-2], names[-1]) if relaxed and len(names) > 1 else None


def finite_only(pixels: DataFrame, value: str = "value") -> DataFrame:
    return pixels.filter(finite(F.col(value)))
