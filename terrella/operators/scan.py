"""Running totals in order of a column over any number of rows, without a window that one task has to hold.

Rows are dealt to buckets by quantiles of the order; every bucket is summed, with map-side combine; a window over these sums,
at most ``BUCKETS`` of them per key, says what comes before each bucket; and windows within buckets say the rest. A key that
holds all rows is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order's values; relative error of the quantiles between them.
BUCKETS, ERROR = 1024, 1e-3


def dealt(df: DataFrame, order: str, buckets: int, name: str = "_bucket") -> DataFrame:
    """``df`` with the number of the bucket of ``order``, a number; nulls come last. Ranges are of about equal numbers of rows, ties stay together."""
    found = df.select(F.col(order).cast("double").alias("_order"))
    bounds = sorted(set(found.approxQuantile("_order", [i / buckets for i in range(1, buckets)], min(ERROR, 0.25 / buckets)))) if buckets > 1 else []
    inf = float("inf")
    splits = [-inf, *(b for b in bounds if abs(b) != inf), inf]
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0).cast("long"))
    cut = Bucketizer(splits=splits, inputCol="_order", outputCol="_cut", handleInvalid="keep")
    return cut.transform(df.withColumn("_order", F.col(order).cast("double"))).withColumn(name, F.coalesce(F.col("_cut").cast("long"), F.lit(len(splits)).cast("long"))).drop("_order", "_cut")


def running_totals(df: DataFrame, totals: dict[str, Column], order: str, by: list[str] | None = None, then: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` with, for each name in ``totals``, the sum of its column over the rows up to and with each, in order of ``order`` and ``then``, by ``by``.

    ``order`` is a number. Rows equal in all of these follow each other in any order. Null values add nothing.
    """
    by, then = by or [], then or []
    n = buckets or min(BUCKETS, 4 * df.sparkSession.sparkContext.defaultParallelism)
    t = dealt(df.withColumns({f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(totals.values())}), order, n)
    values = [f"_v{i}" for i in range(len(totals))]
    sums = t.groupBy(*by, "_bucket").agg(*(F.sum(v).alias(f"{v}s") for v in values))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(by)), F.col("_bucket").alias("_of"), *(F.coalesce(F.sum(f"{v}s").over(earlier), F.lit(0)).alias(f"{v}b") for v in values))
    within = Window.partitionBy(*by, "_bucket").orderBy(F.col(order).asc_nulls_last(), *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({f"{v}w": F.sum(v).over(within) for v in values})
    met = t.join(before, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(by)] + [F.col("_bucket") == F.col("_of")])
    return met.select(*df.columns, *((F.col(f"{v}b") + F.col(f"{v}w")).alias(name) for v, name in zip(values, totals)))
