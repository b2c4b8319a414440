"""Multipart writing of one ordered byte stream by many tasks.

Where a piece of the stream goes is known from the sizes before it, so a part is a range of bytes and not a run of pieces:
pieces are cut at the ranges' edges, meet by part in one shuffle, and each part is written by the task that has it. All parts
have one size but the last, whatever the pieces; the driver sees what a sink says about each part, never their bytes. Tasks
that run again write the same bytes to the same part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(Protocol):
    """Where parts go; must be picklable. ``least`` and ``most`` bound the size of a part, ``count`` their number."""

    least: int
    most: int
    count: int

    def begin(self, total: int) -> None: ...

    def write(self, part: int, start: int, data: bytes) -> str: ...

    def finish(self, parts: list[tuple[int, int, str]]) -> None: ...


class FileSink:
    """A file on a file system that driver and executors mount: parts are written at their place, and the file appears when all are there."""

    def __init__(self, path: str, least: int = 5 << 20, most: int = 5 << 30, count: int = 10_000):
        self.path, self.least, self.most, self.count = path, least, most, count

    @property
    def unfinished(self) -> str:
        return f"{self.path}.unfinished"

    def begin(self, total: int) -> None:
        with open(self.unfinished, "wb") as f:
            f.truncate(total)

    def write(self, part: int, start: int, data: bytes) -> str:
        with open(self.unfinished, "r+b") as f:
            f.seek(start)
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return f"{zlib.crc32(data):08x}"

    def finish(self, parts: list[tuple[int, int, str]]) -> None:
        os.replace(self.unfinished, self.path)


def part_size(total: int, sink: Sink) -> int:
    size = max(sink.least, -(-total // sink.count), 1)
    if size > sink.most:
        raise ValueError(f"{total} bytes don't fit into {sink.count} parts of {sink.most}")
    return size


def write(pieces: DataFrame, total: int, sink: Sink) -> list[tuple[int, int, str]]:
    """Write pieces (``offset`` long, ``data`` binary) that cover 0 to ``total``; returns number, size and tag of each part.

    Empty pieces may stand anywhere. A gap or an overlap is an error, and leaves the sink unfinished.
    """
    size = part_size(total, sink)
    end = F.col("offset") + F.octet_length("data")
    t = pieces.select("offset", "data").filter(F.octet_length("data") > 0)
    t = t.withColumn("part", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((end - 1) / size))))
    start = F.greatest(F.col("offset"), F.col("part") * size)
    n = F.least(end, (F.col("part") + 1) * size) - start
    t = t.select("part", start.alias("start"), F.substring(F.col("data"), (start - F.col("offset") + 1).cast("int"), n.cast("int")).alias("data"))
    count = max(1, -(-total // size))
    tasks = min(count, 4 * pieces.sparkSession.sparkContext.defaultParallelism)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: int, held: list[bytes], at: int) -> pa.RecordBatch:
            expected = min(size, total - part * size)
            if at != part * size + expected:
                raise ValueError(f"part {part} has bytes up to {at}, not {part * size + expected}")
            data = b"".join(held)
            return pa.record_batch([pa.array([part]), pa.array([len(data)]), pa.array([sink.write(part, part * size, data)])], ["part", "size", "tag"])

        part, held, at = None, [], 0
        for b in batches:
            for p, s, d in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if part is not None:
                        yield done(part, held, at)
                    part, held, at = p, [], p * size
                if s != at:
                    raise ValueError(f"the stream has a gap or an overlap at {min(s, at)}")
                held.append(d)
                at += len(d)
        if part is not None:
            yield done(part, held, at)

    sink.begin(total)
    parts = t.repartition(tasks, "part").sortWithinPartitions("part", "start").mapInArrow(rows, "part long, size long, tag string").collect()
    found = sorted((r["part"], r["size"], r["tag"]) for r in parts)
    if [p for p, _, _ in found] != list(range(count if total else 0)):
        raise ValueError("the stream has a gap of whole parts")
    sink.finish(found)
    return found
