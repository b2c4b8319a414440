"""Vector code compression: product codes whose nearest entries are found by exponion search, in exact integers.

Components are scaled and floored to integers and a vector is cut into equal parts, each with a codebook of its own. The
search for a part starts at the entry it had in the round before, at squared distance d. By the triangle inequality an
entry as near as that lies within twice that distance of it, so only the head of that entry's list of neighbours, up to
squared distance 4 d, is scanned; equal distances go to the lower index. Squared distances are whole numbers: products run
in floating point only while every sum stays below 2**53, else in 64-bit integers.

Each round is one pass that writes vectors and codes to the shared folder and one that sums parts by entry in every task;
sums of tasks are added by Spark. The driver only ever holds the codebooks.

Defined cases: a vector that is null, empty, holds a null or non-finite component, has a length that ``parts`` doesn't
divide, or another length than the vector of the smallest id, is dropped. The first entries are those of the smallest ids,
equal ids in the order of their vectors, null ids last; with fewer vectors than ``entries`` the codebooks are smaller. Rows
that repeat count as often as they occur, also as first entries. Null labels are one label. An empty table gives an empty
result. Other columns, whatever their names, are ignored. Components of ``LIMIT`` or more after scaling are an error, as
their squared distances don't fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scratch, ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 28
#: Vectors that a task searches at a time.
ROWS = 1 << 15
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, both whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None].astype(np.int64) - c[None, :, j]) ** 2
    return out


class Neighbours:
    """Of every entry of a codebook, all entries by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        away = squared(entries, entries)
        self.order = np.argsort(away, axis=1, kind="stable")
        self.away = np.take_along_axis(away, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every row the nearest entry and its squared distance, searched from the entry ``start`` outwards."""
        own = ((x - self.entries[start]) ** 2).sum(1)
        found, best = start.astype(np.int64), own.copy()
        by = np.argsort(start, kind="stable")
        edges = np.flatnonzero(np.diff(start[by])) + 1
        for rows in np.split(by, edges):
            if not len(rows):
                continue
            a = start[rows[0]]
            reach = np.searchsorted(self.away[a], 4 * own[rows], "right")
            near = self.order[a, : reach.max()]
            d = squared(x[rows], self.entries[near])
            d[np.arange(len(near)) >= reach[:, None]] = np.iinfo(np.int64).max
            least = d.min(1)
            # of the nearest, the lowest index
            found[rows] = np.where(d == least[:, None], near, len(self.entries)).min(1)
            best[rows] = least
        return found, best


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of equally long binary values as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), kind)
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], np.dtype(kind), len(column) * width, first).reshape(len(column), width)


def _binary(m: np.ndarray) -> pa.Array:
    return pa.array(list(map(bytes, np.ascontiguousarray(m))), pa.binary())


def _scaled(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    v = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(v) and np.abs(v).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT} or more after scaling have no exact 64-bit distances")
    return v.astype(np.int64).reshape(-1, dim)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _assign(t: DataFrame, codebooks: np.ndarray, scale: int) -> DataFrame:
    """Rows with their nearest entries (``code``, two bytes a part) and the squared distance summed over parts; reads vectors, or the rows of a round before."""
    parts, _, width = codebooks.shape
    dim, fresh = parts * width, "v" not in t.columns
    label = t.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Neighbours(c) for c in codebooks]
        for rows in _joined(batches):
            first = rows.column("first" if fresh else "v").combine_chunks()
            if isinstance(first, pa.ChunkedArray):
                first = first.chunk(0) if first.num_chunks else pa.array([], first.type)
            x = _scaled(first, dim, scale) if fresh else _matrix(first, "<i4", dim).astype(np.int64)
            code = np.zeros((len(x), parts), np.uint16) if fresh else _matrix(rows.column("code"), "<u2", parts).copy()
            error = np.zeros(len(x), np.int64)
            for j, near in enumerate(lists):
                found, d = near.nearest(x[:, j * width : (j + 1) * width], code[:, j])
                code[:, j] = found
                error += d
            out = [rows.column("vec_id"), rows.column("label"), _binary(x.astype("<i4")), _binary(code.astype("<u2")), pa.array(error)]
            yield from pa.table(out, ["vec_id", "label", "v", "code", "error"]).to_batches()

    return t.mapInArrow(run, f"vec_id long, label {label}, v binary, code binary, error long")


def _sums(t: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts and components summed by entry: a bounded number of sums per task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for rows in _joined(batches):
            x, code = _matrix(rows.column("v"), "<i4", parts * width), _matrix(rows.column("code"), "<u2", parts)
            for j in range(parts):
                slot = code[:, j].astype(np.int64) + j * entries
                by = np.argsort(slot, kind="stable")
                at = np.flatnonzero(np.diff(slot[by], prepend=-1))
                if len(by):
                    total[slot[by[at]]] += np.add.reduceat(x[by, j * width : (j + 1) * width].astype(np.int64), at)
                count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        both = np.concatenate([count[used, None], total[used]], 1)
        slot, at = np.repeat(used, width + 1), np.tile(np.arange(width + 1), len(used))
        yield pa.record_batch([pa.array(slot.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(both.ravel())], ["slot", "at", "n"])

    added = t.select("v", "code").mapInArrow(run, "slot int, at int, n long").groupBy("slot", "at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((parts * entries, width + 1), np.int64)
    out[added["slot"], added["at"]] = added["n"]
    return out[:, 1:].reshape(parts, entries, width), out[:, 0].reshape(parts, entries)


def _vectors(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    v = F.col("first")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    t = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("first"))
    return t.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & sound)


def codebook_text(codebooks: np.ndarray) -> str:
    """All components in decimal, by part, entry and place in it."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def learn_and_encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label"
) -> tuple[DataFrame | None, np.ndarray | None]:
    """A table of vec_id, label, v (whole components, int32), code (uint16 per part) and error, and the codebooks by part and entry; None without vectors."""
    ship(vectors.sparkSession)
    t = _vectors(vectors, parts, id_col, vector_col, label_col)
    smallest = lambda df: [r[0] for r in df.orderBy(F.col("vec_id").asc_nulls_last(), "first").select("first").limit(entries).collect()]
    starts = smallest(t)
    if not starts:
        return None, None
    dim = len(starts[0])
    if any(len(s) != dim for s in starts):
        starts = smallest(t.filter(F.size("first") == dim))
    t = t.filter(F.size("first") == dim)
    whole = _scaled(pa.array(starts, pa.list_(pa.float64())), dim, scale)
    codebooks = np.ascontiguousarray(whole.reshape(len(whole), parts, dim // parts).transpose(1, 0, 2))
    with scratch():
        held = materialise(_assign(t, codebooks, scale), "codes", lasting=rounds == 0)
        for i in range(rounds):
            total, count = _sums(held, *codebooks.shape)
            codebooks = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], codebooks)
            after = materialise(_assign(held, codebooks, scale), "codes", lasting=i == rounds - 1)
            discard(held)
            held = after
    return held, codebooks


def decode(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that its code stands for."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _matrix(b.column(1), "<u2", parts)
            v = np.concatenate([codebooks[j][code[:, j]] for j in range(parts)], 1) / scale
            yield pa.record_batch([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def code_errors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: its code in hexadecimal, two digits a part, its error, the error summed over its label, and the digest of all codebooks."""
    held, codebooks = learn_and_encode(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    if held is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    # the low byte of each part's two
    code = F.concat(*(F.substring(F.hex("code"), 4 * j + 1, 2) for j in range(PARTS)))
    sums = held.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    return held.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", F.lower(code).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
