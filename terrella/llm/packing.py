"""Packing along a space-filling curve.

A document's vector is its hashed byte-trigram counts (square roots, unit length), projected to ``DIMS`` dimensions, which are
centred and scaled by their moments over all documents; the cell it falls in has a Hilbert key. Documents are
range-partitioned and sorted by that key with a hash of the id behind it (of the row number, where there is no id), so a
group of equal texts, however large, spreads over partitions. Bounds come from a sample of at most about ``SAMPLE`` rows
and only steer balance. Within a partition, documents follow one another into sequences of ``LENGTH`` ids, cut freely. The
last sequence of a partition is re-cut into powers of two, so no sequence is padded.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are packed as rows of their own; a null id
stays null; a text of any length is cut over as many sequences as it takes; ties of the whole key are ordered by id;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, parts_for, ship, trimmed
from .textkit import U, as_strings, mix, slices
from .tokens import word_ids

LENGTH, END = 4096, 2
BUCKETS, DIMS, BITS, TIE_BITS, SPAN = 512, 4, 9, 27, 3
SAMPLE, PART_BYTES, TOGETHER = 20_000, 16 << 20, 400
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MATRIX = np.random.default_rng(7).normal(0, 1, (BUCKETS, DIMS))


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer points, one row each (Skilling's transpose form, vectorised)."""
    x = [axes[:, i].astype(np.int64) for i in range(axes.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = x[0] ^ np.where(hit, p, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def projected(text: pa.Array) -> np.ndarray:
    """Each text's vector, projected; of its own bytes alone, so equal texts have equal vectors wherever they stand."""
    found = []
    for s in slices(text, lower=True):
        g = s.data.astype(np.uint16)
        g[:-2] = g[:-2] * np.uint16(2531) + g[1:-1] * np.uint16(337) + g[2:] * np.uint16(7)
        bucket = g % np.uint16(BUCKETS)  # of byte trigrams; the last two places of a row have none
        counts = np.stack([np.bincount(bucket[x : max(x, y - 2)], minlength=BUCKETS) for x, y in zip(s.offs[:-1].tolist(), s.offs[1:].tolist())])
        counts = np.sqrt(counts)
        norm = np.sqrt((counts**2).sum(1, keepdims=True))
        # to ten digits: a matrix product's last ones depend on how many rows it takes at once
        found.append(np.round(counts @ MATRIX / np.maximum(norm, 1e-9), 10))
    return np.concatenate(found) if found else np.zeros((0, DIMS))


def curve_keys(text: pa.Array, ids: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Hilbert key of each text's projected vector, within ``SPAN`` deviations of the mean, then bits of a hash of the id."""
    place = (projected(text) - mean) / scale
    cell = np.clip(((place + SPAN) * (1 << BITS) / (2 * SPAN)).astype(np.int64), 0, (1 << BITS) - 1)
    keys = hilbert(cell, BITS) if len(cell) else np.zeros(0, np.int64)
    return keys << TIE_BITS | (mix(ids.astype(U)) >> U(64 - TIE_BITS)).astype(np.int64)


class Sequences:
    """Cuts documents into the sequences of one partition."""

    def __init__(self, name: int):
        self.next, self.open, self.fill = name << 32, [], 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, data, total in pieces:
            self.rows.append((doc, start, len(data) // 4, zlib.crc32(data), total, self.next, offset))
            offset += len(data) // 4
        self.next += 1

    def add(self, doc: int | None, data: bytes) -> None:
        view, total, at = memoryview(data), len(data) // 4, 0
        while at < total:
            n = min(LENGTH - self.fill, total - at)
            self.open.append((doc, at, view[4 * at : 4 * (at + n)], total))
            at, self.fill = at + n, self.fill + n
            if self.fill == LENGTH:
                self._close(self.open)
                self.open, self.fill = [], 0

    def finish(self) -> None:
        """Sequences of power-of-two lengths, largest first, for what is left."""
        size, pieces = LENGTH, self.open
        while self.fill:
            size >>= 1
            if size > self.fill:
                continue
            taken, need = [], size
            while need:
                doc, start, data, total = pieces.pop(0)
                n = min(need, len(data) // 4)
                taken.append((doc, start, data[: 4 * n], total))
                if 4 * n < len(data):
                    pieces.insert(0, (doc, start + n, data[4 * n :], total))
                need -= n
            self._close(taken)
            self.fill -= size
        self.open = []

    def take(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = list(zip(*self.rows))
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence."""
    spark = docs.sparkSession
    ship(spark)

    @F.arrow_udf("array<double>")
    def vector(text: pa.Array) -> pa.Array:
        return pa.array(list(projected(text)), pa.list_(pa.float64()))

    @F.arrow_udf("long")
    def curve(text: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array(curve_keys(text, ids.to_numpy(), mean, scale))

    row = F.xxhash64(F.monotonically_increasing_id())
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.coalesce("doc_id", row))
    at = [F.col("v")[i] for i in range(DIMS)]
    moments = plain.select(vector("text").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, at)).alias("mean"), F.array(*map(F.stddev_pop, at)).alias("sd")).collect()[0]
    n = moments["n"]
    # rounded, as sums of floating numbers depend on their order
    mean, scale = np.round(np.array(moments["mean"] if n else [0.0] * DIMS), 6), np.maximum(np.round(np.array(moments["sd"] if n else [1.0] * DIMS), 6), 1e-6)
    sample = plain.sample(min(1.0, SAMPLE / max(n, 1)), seed=11).select(curve("text", "tie").alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).orderBy("k").collect()
    weight = np.cumsum([r["b"] + 200 for r in sample]) if sample else np.zeros(1)
    parts = parts_for(spark, weight[-1] * n / max(len(sample), 1), PART_BYTES)
    cuts = np.array([sample[i]["k"] for i in np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)] if sample else [], np.int64)
    names = np.array(even_keys(spark, parts), np.int64)

    @F.arrow_udf("struct<k: long, part: int>")
    def place(text: pa.Array, ids: pa.Array) -> pa.Array:
        k = curve_keys(text, ids.to_numpy(), mean, scale)
        return pa.StructArray.from_arrays([pa.array(k), pa.array(names[np.searchsorted(cuts, k, "right")].astype(np.int32))], ["k", "part"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, sequences = word_ids(tokenizer), None, None
        end = END.to_bytes(4, "little")
        for batch in batches:
            texts = as_strings(batch.column(2)).to_pylist()
            encoded = (x for i in range(0, len(texts), TOGETHER) for x in words.encode_many(texts[i : i + TOGETHER]))
            for part, doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded):
                if part != now:
                    if sequences:
                        sequences.finish()
                        if (out := sequences.take()) is not None:
                            yield out
                    now, sequences = part, Sequences(part)
                sequences.add(doc, data + end)
            if sequences and (out := sequences.take()) is not None:
                yield out
        if sequences:
            sequences.finish()
            if (out := sequences.take()) is not None:
                yield out

    placed = plain.withColumn("p", place("text", "tie")).select(F.col("p.part").alias("part"), F.col("p.k").alias("k"), "doc_id", "text")
    return placed.repartition(parts, "part").sortWithinPartitions("part", "k", "doc_id").select("part", "doc_id", "text").mapInArrow(trimmed(rows), SCHEMA)
