"""Session plumbing: workers must be able to import this package, and Arrow batches are bounded by bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Upper bound of one Arrow batch; very long rows make small batches instead of large ones.
BATCH_BYTES = 8 << 20
_BATCH = [BATCH_BYTES]


@contextmanager
def batch_bytes(most: int) -> Iterator[None]:
    """Plans made inside have Arrow batches of ``most`` bytes at most; the session keeps them until the next ``ship`` outside."""
    _BATCH.append(min(most, _BATCH[-1]))
    try:
        yield
    finally:
        _BATCH.pop()


def ship(spark: SparkSession) -> None:
    """On one machine, put the package on the workers' path; on a cluster, install it or submit it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for key, value in (("maxBytesPerBatch", _BATCH[-1]), ("maxRecordsPerBatch", 4000)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; a temporary one where that is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="terrella-")
    path = found.removeprefix("file://").rstrip("/")
    os.makedirs(path, exist_ok=True)
    return f"{path}/{name}-{uuid.uuid4().hex}"
