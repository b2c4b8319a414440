"""Session plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

__all__ = ["crc_mod", "delete_path", "discard", "even_keys", "materialise", "parts_for", "row_key", "scratch", "shared_dir", "ship", "table_path", "trimmed"]

_OWN: list[str] = []
#: Tables by scope: the first one's stay until the driver exits, the others' until their ``scratch`` ends.
_SCOPES: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="terrella-shared-"))
    return f"file://{_OWN[0]}"


def table_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder, deleted when its scope ends; ``lasting``: when the scope around that ends."""
    path = f"{shared_dir(spark)}/terrella/{name}-{uuid.uuid4().hex}"
    _SCOPES[max(len(_SCOPES) - 1 - lasting, 0)].append((spark, path))
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for the lasting ones: what is returned must read those alone."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            delete_path(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` wrote for ``df`` before its scope ends."""
    delete_path(df.sparkSession, df._table)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, free: bool = False, lasting: bool = False, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    ``free``: the shuffle files behind it are large and of no more use; a collection lets Spark's cleaner delete them now.
    ``lasting``: the table outlives the ``scratch`` it is written in.
    """
    spark = df.sparkSession
    path = table_path(spark, name, lasting)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    del df
    if free:
        gc.collect()
        spark.range(0, 64, 1, 16).count()  # the scheduler's threads hold on to the last job until they see another
        spark._jvm.System.gc()
    return out


@atexit.register
def _sweep() -> None:
    for spark, path in _SCOPES[0]:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone already; nothing else to do at exit
            break


def trimmed(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` for ``mapInArrow``; at the end of a task the worker gives freed memory back, as it stays alive beside those of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def parts_for(spark: SparkSession, total_bytes: float, each: float) -> int:
    """Partitions of about ``each`` bytes, and at least two for every core."""
    return int(max(total_bytes // each + 1, 2 * spark.sparkContext.defaultParallelism, 1))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Integers k[0..n) of which each hashes to a partition of its own under ``repartition(n, col)``."""
    rows = (
        spark.range(0, 40 * n + 400).select(F.col("id").cast("int").alias("k")).withColumn("p", F.expr(f"pmod(hash(k), {n})"))
        .groupBy("p").agg(F.min("k").alias("k")).collect()
    )
    found = {r["p"]: r["k"] for r in rows}
    return [found.get(i, 40 * n + 400 + i) for i in range(n)]


def crc_mod(col, n: int):
    """crc32 of a column as text, modulo n; null ids count as the text 'null'."""
    return F.expr(f"pmod(crc32(cast(coalesce(cast({col} as string), 'null') as binary)), {n})")


def row_key(id_col: str, text_col: str):
    """A hash by which rows of one id, or without one, are told apart by their text."""
    return F.xxhash64(F.col(text_col), F.col(id_col).cast("long"))
