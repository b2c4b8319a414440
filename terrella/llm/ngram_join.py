"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Word n-grams are ordered by document frequency over the whole corpus, ties by hash; two sets with Jaccard index t or more
share an n-gram among the first n - ceil(t n) + 1 of each. N-grams of one document only can match nothing, so a posting
is made for the shared ones of a prefix alone, which rare-first order makes few.

Frequencies are counted exactly without a row per n-gram: each task packs its documents' n-gram hashes by chunk and hash
bucket, a bucket's task counts them and sends back, to each chunk, which of its entries other documents have and how
often. N-grams that many documents of one chunk have travel once per chunk with their count, so no bucket holds a row per
document of a frequent n-gram. Overlaps consist of shared entries only, so these are all that verification needs.
Documents with equal sets are one class throughout. Set elements are 48-bit hashes (a pair of unequal n-grams of one pair
of documents collides with probability below 1e-8).

Defined cases: a null or empty text, or one of white space, has an empty set, is linked with nothing and is its own
component; texts with fewer words than n have their whole sequence as the only element; repeated rows and rows of one id
are nodes by their sets, so each row gets the smallest id of its component; a row with a null id gets the smallest
other id reachable, or null; an empty table gives an empty result. The input should be a table scan or written table, as
packing relies on retried tasks reading the same rows. Texts of any length count whole. Grams of equal frequency are ordered by
their hash, and of a component the smallest id stays. Other columns are ignored by the report and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, runs, steps, unpack
from .common import even_keys, materialise, parts_for, row_key, ship, trimmed
from .linkage import link
from .textkit import Slice, U, mix, slices

CHUNK, CHUNK_DOCS, HOT = 600_000, 60_000, 32
PART_BYTES = 12 << 20
MARK = 65535


def document_sets(s: Slice, n: int) -> Iterator[np.ndarray]:
    """Of each row: the sorted distinct hashes of its word n-grams."""
    start, end, doc = s.words()
    h = s.hashes(start, end)
    first = np.searchsorted(doc, np.arange(s.n + 1))
    g = np.zeros(max(len(h) - n + 1, 0), U)
    for i in range(n):
        g = g * U(0xD1342543DE82EF95) + h[i : len(h) - n + 1 + i]
    g = mix(g)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            whole = np.array([b - a], U)
            for i in range(a, b):
                whole = whole * U(0xD1342543DE82EF95) + h[i]
            yield mix(whole * U(3) + U(1))
        else:
            yield np.zeros(0, U)


class Chunk:
    """Documents whose n-grams are packed together."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.rows: list[int] = []
        self.sets: list[np.ndarray] = []
        self.entries = 0

    def add(self, doc: int | None, row: int, elements: np.ndarray) -> None:
        self.ids.append(doc)
        self.rows.append(row)
        self.sets.append(elements)
        self.entries += len(elements)

    def full(self) -> bool:
        return self.entries >= CHUNK or len(self.ids) >= CHUNK_DOCS

    def messages(self, buckets: np.ndarray, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
        """Rows (bucket, chunk, kind, data): kind 0 is for the chunk itself, kind 1 for a bucket."""
        n = np.array([len(x) for x in self.sets], np.int64)
        with np.errstate(over="ignore"):
            one = np.array([np.add.reduce(mix(x)) if len(x) else 0 for x in self.sets], U) ^ mix(n.astype(U))
            two = np.array([np.bitwise_xor.reduce(mix(x ^ U(0xA5A5A5A5A5A5A5A5))) if len(x) else 0 for x in self.sets], U)
        everything = np.concatenate(self.sets) if self.sets else np.zeros(0, U)
        packed = np.sort((everything >> U(16)) << U(16) | np.repeat(np.arange(len(n), dtype=U), n))
        h, doc = packed >> U(16), (packed & U(MARK)).astype(np.uint16)
        start = runs(h)
        count = np.diff(np.append(start, len(h)))
        hot = count > HOT
        often = np.repeat(hot, count)
        null = np.array([x is None for x in self.ids], np.uint8)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        yield int(buckets[chunk % len(buckets)]), chunk, 0, pack(ids, null, np.array(self.rows, np.int64), n, one, two, steps(h[often]), doc[often])
        keep = ~often
        keep[start[hot]] = True
        hot_counts = np.zeros(len(h), np.uint32)
        hot_counts[start[hot]] = count[hot]
        doc = np.where(often, MARK, doc).astype(np.uint16)
        h, doc, hot_counts = h[keep], doc[keep], hot_counts[keep]
        edge = np.searchsorted(h, (np.arange(len(buckets) + 1, dtype=np.float64) * (2.0**48 / len(buckets))).astype(U))
        edge[-1] = len(h)
        for b, (x, y) in enumerate(zip(edge[:-1], edge[1:])):
            if y > x:
                yield int(buckets[b]), chunk, 1, pack(steps(h[x:y]), doc[x:y], hot_counts[x:y])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's frequencies: which entries of each chunk are shared, and by how many documents."""
    chunks: list[int] = []
    blobs: list[bytes] = []
    for batch in batches:
        for chunk, kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if kind == 0:
                yield pa.record_batch([pa.array([chunk]), pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["chunk", "kind", "data"])
            else:
                chunks.append(chunk)
                blobs.append(data)
    if not blobs:
        return
    columns = [unpack(b) for b in blobs]
    for c in columns:
        c[0] = np.cumsum(c[0], dtype=U)
    entry = np.sort(np.concatenate([c[0] for c in columns]))
    start = runs(entry)
    distinct, count = entry[start], np.diff(np.append(start, len(entry)))
    del entry
    for c in columns:
        at = np.flatnonzero(c[2])
        count[np.searchsorted(distinct, c[0][at])] += c[2][at].astype(np.int64) - 1
    shared, often = distinct[count > 1], count[count > 1].astype(np.uint32)
    if not len(shared):
        return
    for chunk, (h, doc, _) in zip(chunks, columns):
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        hit = shared[at] == h
        if hit.any():
            yield pa.record_batch([pa.array([chunk]), pa.array([1], pa.int32()), pa.array([pack(steps(h[hit]), doc[hit], often[at[hit]])], pa.binary())], ["chunk", "kind", "data"])


def _settle(share: tuple[int, int]):
    """Per chunk: its documents with their class, and of those with postings the prefix and all shared entries."""
    p, q = share

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        head: bytes = b""
        replies: list[bytes] = []

        def out() -> pa.RecordBatch:
            ids, null, row, n, one, two, hot_h, hot_doc = unpack(head)
            hot_h = np.cumsum(hot_h, dtype=U)
            parts = [unpack(r) for r in replies]
            h = np.concatenate([np.cumsum(x[0], dtype=U) for x in parts]) if parts else np.zeros(0, U)
            doc = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.uint16)
            df = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.uint32)
            marked = doc == MARK
            mh, mdf = h[marked], df[marked]
            order = np.argsort(mh)
            mh, mdf = mh[order], mdf[order]
            full_h = np.concatenate([h[~marked], hot_h])
            full_doc = np.concatenate([doc[~marked], hot_doc]).astype(np.int64)
            full_df = np.concatenate([df[~marked], mdf[np.searchsorted(mh, hot_h)] if len(hot_h) else np.zeros(0, np.uint32)])
            shared = np.bincount(full_doc, minlength=len(ids))
            alone = n - shared
            prefix = np.where(n > 0, n - -(-p * n // q) + 1, 0) - alone
            order = np.lexsort((full_h, full_df, full_doc))
            ranked, rdoc = full_h[order], full_doc[order]
            first = np.concatenate([[0], np.cumsum(shared)])
            keys: list[list[int] | None] = []
            payload: list[bytes | None] = []
            for i, (a, b, k) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), prefix.tolist())):
                if k <= 0 or b == a:
                    keys.append(None)
                    payload.append(None)
                    continue
                own = ranked[a : a + min(k, b - a)]
                keys.append(own.astype(np.int64).tolist())
                payload.append(pack(own, np.array([n[i], alone[i]], np.int64), steps(np.sort(ranked[a:b]))))
            node = mix(one ^ mix(two)).astype(np.int64)
            return pa.record_batch(
                [pa.array(ids, mask=null.astype(bool)), pa.array(row), pa.array(n), pa.array(node), pa.array(keys, pa.list_(pa.int64())), pa.array(payload, pa.binary())],
                ["doc_id", "row", "n", "node", "keys", "payload"],
            )

        for batch in batches:
            for chunk, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, head, replies = chunk, b"", []
                if kind == 0:
                    head = data
                else:
                    replies.append(data)
        if now is not None:
            yield out()

    return rows


def decode(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    out = []
    for data in payloads:
        keys, (n, alone), elements = unpack(data)
        out.append((keys, alone + np.arange(len(keys)), np.cumsum(elements, dtype=U), int(n)))
    return out


def prefixes(docs: DataFrame, n: int, share: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, row (``_row_key`` of ``docs``, or 0), set size, class, and prefix keys with shared entries where it has any."""
    spark = docs.sparkSession
    ship(spark)
    row = F.col("_row_key") if "_row_key" in docs.columns else F.lit(0).cast("long")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    size = (plain.sample(0.05, seed=5).agg(F.avg(F.octet_length("text")).alias("b")).collect()[0]["b"] or 1000.0) * plain.count()
    parts = parts_for(spark, size, PART_BYTES)
    buckets = np.array(even_keys(spark, parts), np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chunk = TaskContext.get().partitionId(), 0, Chunk()

        def out() -> pa.RecordBatch:
            found = list(zip(*chunk.messages(buckets, task << 24 | number)))
            return pa.record_batch([pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "chunk", "kind", "data"])

        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for s in slices(batch.column(1), lower=True):
                for i, elements in enumerate(document_sets(s, n)):
                    chunk.add(ids[s.first + i], keys[s.first + i], elements)
                if chunk.full():
                    yield out()
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield out()

    sent = plain.mapInArrow(trimmed(rows), "bucket int, chunk long, kind int, data binary")
    counted = sent.repartition(parts, "bucket").mapInArrow(trimmed(_count), "chunk long, kind int, data binary")
    return counted.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(trimmed(_settle(share)), "doc_id long, row long, n long, node long, keys array<long>, payload binary")


def _components(docs: DataFrame, n: int, share: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per input row with its class (null for an empty set), and the component of every class that has words."""
    table = materialise(prefixes(docs, n, share, id_col, text_col), "prefixes", free=True)
    items = materialise(table.filter("keys is not null").select("node", "keys", "payload").dropDuplicates(["node"]), "prefix-sets")
    pairs = items.select("node", F.explode("keys").alias("key"))
    groups = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    postings = materialise(pairs.join(groups, "key").select("key", "node", "k"), "postings")
    found = link(postings, items.select("node", "payload"), decode, share)
    classes = table.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return table.withColumn("node", F.when(F.col("n") > 0, F.col("node"))), classes


def jaccard_components(docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id of its component)."""
    table, classes = _components(docs, n, share, id_col, text_col)
    linked = classes.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("c"))
    named = classes.join(linked, "comp").select("node", "component_id")
    return table.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: of the smallest id, null ids last, then of the smallest ``row_key``.

    Of several rows equal in id and text any one stays; rows without words stay too.
    """
    table, classes = _components(docs.withColumn("_row_key", row_key(id_col, text_col)), n, share, id_col, text_col)
    rows = table.filter("node is not null").join(classes.select("node", "comp"), "node").select("comp", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row").alias("at"))
    rows = materialise(rows.groupBy("comp", "at").agg(F.count(F.lit(1)).alias("c")), "component-rows")
    kept = rows.groupBy("comp").agg(F.min("at").alias("kept"))
    gone = rows.join(kept, "comp").filter("at != kept or c > 1")
    gone = materialise(gone.select(F.col("at.doc_id").alias("_gone_id"), F.col("at.row").alias("_gone_row"), (F.col("at") == F.col("kept")).alias("_gone_but_one")), "gone-rows")
    same = (row_key(id_col, text_col) == gone["_gone_row"]) & F.col(id_col).cast("long").eqNullSafe(gone["_gone_id"])
    stay = docs.join(gone, same, "left_anti")
    several = gone.filter("_gone_but_one")
    if several.isEmpty():
        return stay
    again = docs.join(several, same, "left_semi").withColumn("_gone_key", row_key(id_col, text_col)).dropDuplicates(["_gone_key"])
    return stay.unionByName(again.select(*docs.columns))
