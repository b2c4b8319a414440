"""Running bounds and tile counts of a stream of points: the batch expressions, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bbox as B
from ..operators.tiles import GridSpec


def tile_counts(points: DataFrame, grid: GridSpec, x: str, y: str, time: str, every: str, late: str) -> DataFrame:
    """Points per tile and tumbling window; state is dropped once the watermark passes."""
    idx = grid.pt2idx(F.col(x), F.col(y))
    return points.withWatermark(time, late).withColumn("_t", idx).groupBy(F.window(time, every), F.col("_t.ix").alias("ix"), F.col("_t.iy").alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def running_bounds(boxes: DataFrame, box: str, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(B.union_agg(F.col(box)).alias("bounds"))
