"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, distributed union-find; one line per component stays.

Every line with a word takes part, of any length and script, compared with A-Z in lower case and white space runs as one blank.
Equal lines are one node. A node's signature has ``BINS`` slots: its shingles of ``SHINGLE`` code points are hashed once, a
slot holds the least hash of its range, an empty slot borrows from the first full one in a random order of its own, so the
slots of short lines, of which few are full, are drawn independently too. ``BANDS`` bands of the slots collide with
probability 0.997 at the similarity wanted, more above. All nodes that share a band are verified exactly and linked.
Band keys are packed by chunk and hash bucket like the n-grams of the n-gram join; keys that many nodes of one chunk have
go straight to the postings, so no bucket holds a row per node of a frequent key. Of a component the line of the smallest
document id stays, in it the first.

Defined cases: a null or empty text is one line without words and keeps it; lines without words stay; a row is known
by its id and a hash of its text: rows equal in both are one document and lose the same lines, other rows of one id are told
apart, the smallest hash first; each row without an id is a document of its own, so of several equal ones the first keeps what
they keep and the others lose every line with a word; an empty table gives an empty result; other columns are kept by
``dedup`` and ignored else; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, runs, steps, unpack
from .common import discard, even_keys, materialise, parts_for, row_key, scratch, ship, trimmed
from .linkage import link
from .textkit import U, mix

MIN_WORDS, SHINGLE, SHARE = 1, 5, (80, 100)
#: 32 bands of 8 of 256 slots; pairs that share one are candidates: at similarity 0.8 with probability 0.997, at 0.3 of 0.002, at
#: 0.2 of 0.0001. Unlike lines of one language share a tenth of their shingles, so shorter bands make candidates of a number of
#: pairs that grows with the square of the input.
BINS, BANDS, ROWS = 256, 32, 8
PART_BYTES, FLUSH, CHUNK, HOT, LOWEST = 16 << 20, 8 << 20, 24_000, 32, -(1 << 63)
#: Bytes of lines whose signatures are made together.
BATCH = 60_000
_FACTORS = mix(np.arange(11, 11 + SHINGLE, dtype=U)) | U(1)
#: The order in which each slot (column) looks for a full one, as distances to it.
_LOOK = np.ascontiguousarray(np.random.default_rng(23).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1).T) - np.arange(BINS)


def normal(line: bytes) -> bytes | None:
    """The compared form, or None for a line without words."""
    words = line.lower().split()
    return b" ".join(words) if len(words) >= MIN_WORDS else None


def normals(text: bytes) -> list[bytes | None]:
    """The compared forms of all lines of a text."""
    if MIN_WORDS > 1 or b"  " in text or b"\t" in text or b"\r" in text or b"\v" in text or b"\f" in text:
        return list(map(normal, text.split(b"\n")))
    return [x.strip(b" ") or None for x in text.lower().split(b"\n")]


def node_of(text: bytes) -> int:
    return int(nodes_of([text])[0])


def nodes_of(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in texts]), "<i8")


def _shingles(texts: list[bytes]) -> np.ndarray:
    """Shingle hashes of lines one after the other, each as line << 48 | hash."""
    # a line of fewer code points than a shingle is filled up with what no text has
    filled = [t if len(t) >= 4 * SHINGLE else t.decode().ljust(SHINGLE, "\ud800").encode("utf-8", "surrogatepass") for t in texts]
    data, size = b"".join(filled), np.fromiter(map(len, filled), np.int64, len(filled))
    points = np.frombuffer(data, np.uint8)
    if not data.isascii():
        size = np.add.reduceat((points & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(U)
    g = points[: len(points) - SHINGLE + 1] * _FACTORS[0]
    part = np.empty_like(g)
    for i in range(1, SHINGLE):
        g += np.multiply(points[i : len(points) - SHINGLE + 1 + i], _FACTORS[i], out=part)
    g = mix(g)
    g >>= U(16)
    size[-1] -= SHINGLE - 1
    g |= np.repeat(np.arange(len(size), dtype=U) << U(48), size)
    inside = np.ones(len(g), bool)  # not the shingles that reach into the next line
    for i in range(1, SHINGLE):
        inside[np.cumsum(size)[:-1] - i] = False
    return g[inside]


def signatures(texts: list[bytes], sets: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Of at most 65,536 lines: sorted distinct 48-bit shingle hashes (if ``sets``), and the band keys (lines x BANDS)."""
    elements: list[np.ndarray] = []
    bands = np.empty((len(texts), BANDS), U)
    at, ends = 0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    while at < len(texts):  # few lines at a time, whose arrays stay in a core's cache
        end = max(at + 1, min(at + BATCH // 64, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH))))
        key = _shingles(texts[at:end])
        if sets:
            key.sort()
            key = key[runs(key)]
            elements += np.split(key & U((1 << 48) - 1), np.searchsorted(key, np.arange(1, end - at, dtype=U) << U(48)))
        bands[at:end] = _bands(key, end - at)
        at = end
    return elements, bands


def _bands(key: np.ndarray, lines: int) -> np.ndarray:
    """Band keys of lines from their shingles: the least hash of every slot, empty slots borrowed."""
    flat = np.full(lines * BINS, ~U(0))
    np.minimum.at(flat, (key >> U(40)).view(np.int64), key & U((1 << 40) - 1))
    full = flat != ~U(0)
    empty, step = np.flatnonzero(~full), 0
    source = np.arange(len(flat))
    slot = empty & (BINS - 1)
    while len(empty):
        other = _LOOK[step].take(slot)
        other += empty
        source[empty] = other
        still = np.flatnonzero(~full.take(other))
        empty, slot, step = empty.take(still), slot.take(still), step + 1
    table = flat.take(source).reshape(lines, BINS)
    bands = np.tile(mix(np.arange(1, BANDS + 1, dtype=U)), (lines, 1))
    for i in range(ROWS):
        bands *= U(0xD1342543DE82EF95)
        bands += table[:, i * BANDS : (i + 1) * BANDS]
    return mix(bands)


def decode(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Items of the linkage: bands as keys, without positions."""
    elements, bands = signatures(payloads)
    return [(b >> U(16), np.zeros(BANDS, np.int64), e, len(e)) for b, e in zip(bands, elements)]


def _firsts(which: list[int], places: tuple[np.ndarray, ...], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of n lines that come at (document, row, line), entry by entry ``which``: the least place of each, and where it is in the entries."""
    of = np.array(which, np.int64)
    at = np.empty(n, np.int64)
    at[of[::-1]] = np.arange(len(of))[::-1]
    several = np.flatnonzero(np.bincount(of, minlength=n)[of] > 1)
    order = several[np.lexsort((*(x[several] for x in places[::-1]), of[several]))]
    start = order[runs(of[order])]
    at[of[start]] = start
    return [x[at] for x in places], of


def _texts(sizes: np.ndarray, raw: np.ndarray) -> list[bytes]:
    data, end = raw.tobytes(), np.cumsum(sizes).tolist()
    return [data[x:y] for x, y in zip([0, *end], end)]


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Every distinct line that takes part, in chunks: chunk, size, places (node, first place and count, packed), data (texts, packed). docs: doc, row, text.

    A task's distinct lines go to the bucket of a hash of their text as one compressed blob.
    """
    size = (docs.sample(0.05, seed=5).agg(F.avg(F.octet_length("text")).alias("b")).collect()[0]["b"] or 1000.0) * docs.count()
    parts = parts_for(docs.sparkSession, size, PART_BYTES)
    buckets = np.array(even_keys(docs.sparkSession, parts), np.int64)

    def send(found: dict[bytes, int], which: list[int], entries: list[tuple]) -> pa.RecordBatch:
        texts = list(found)
        (doc, row, line), of = _firsts(which, tuple(map(np.concatenate, zip(*entries))), len(texts))
        count = np.bincount(of, minlength=len(texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        home = np.fromiter(map(zlib.crc32, texts), np.int64, len(texts)) % parts
        order = np.argsort(home, kind="stable")
        edge = np.searchsorted(home[order], np.arange(parts + 1))
        names, blobs = [], []
        for b, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            if y > x:
                own = order[x:y]
                names.append(int(buckets[b]))
                blobs.append(pack(doc[own], row[own], line[own], count[own], sizes[own], np.frombuffer(b"".join([texts[i] for i in own.tolist()]), np.uint8)))
        return pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        which: list[int] = []
        entries: list[tuple] = []
        held = 0
        for batch in batches:
            column = batch.column(2).cast(pa.large_binary())
            for i in range(0, len(column), 512):
                at, line, before = [], [], len(found)
                for k, text in enumerate(column.slice(i, 512).to_pylist(), i):
                    forms = normals(text or b"")
                    with_words = [j for j, x in enumerate(forms) if x is not None]
                    line += with_words
                    at.append(len(with_words))
                    which += [found.setdefault(x, len(found)) for x in forms if x is not None]
                doc, row = (np.repeat(batch.column(c).slice(i, 512).to_numpy(), at) for c in (0, 1))
                entries.append((doc, row, np.array(line, np.int64)))
                held += sum(map(len, islice(reversed(found), len(found) - before))) + 100 * (len(found) - before) + 24 * len(line)
                if held > FLUSH:
                    yield send(found, which, entries)
                    found, which, entries, held = {}, [], [], 0
        if found:
            yield send(found, which, entries)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        which: list[int] = []
        entries: list[tuple] = []
        for batch in batches:
            for data in batch.column(1).to_pylist():
                *entry, sizes, raw = unpack(data)
                entries.append(tuple(entry))
                which += [found.setdefault(t, len(found)) for t in _texts(sizes, raw)]
        if not found:
            return
        *places_, counts = map(np.concatenate, zip(*entries))
        (doc, row, line), of = _firsts(which, tuple(places_), len(found))
        count = np.bincount(of, counts, len(found)).astype(np.int64)
        task, texts = TaskContext.get().partitionId(), list(found)
        for i in range(0, len(texts), CHUNK):
            own, p = texts[i : i + CHUNK], slice(i, i + CHUNK)
            places = pack(nodes_of(own), doc[p], row[p], line[p], count[p])
            data = pack(np.fromiter(map(len, own), np.int64, len(own)), np.frombuffer(b"".join(own), np.uint8))
            yield pa.record_batch([pa.array([task << 24 | i // CHUNK]), pa.array([len(places) + len(data)]), pa.array([places], pa.binary()), pa.array([data], pa.binary())], ["chunk", "size", "places", "data"])

    return docs.mapInArrow(trimmed(split), "bucket int, data binary").repartition(parts, "bucket").mapInArrow(trimmed(merge), "chunk long, size long, places binary, data binary")


def band_groups(lines: DataFrame) -> DataFrame:
    """Of chunks of lines: (key, node, k) of band keys that k nodes have, k above 1, and of those nodes, with a null key, place, text and home key.

    Keys meet by hash bucket, what they find returns to the chunk, where the lines are. The home key is the one of a node that most nodes have.
    """
    spark = lines.sparkSession
    size = lines.agg(F.sum("size")).collect()[0][0] or 0
    parts = parts_for(spark, size * 2, PART_BYTES)
    buckets = np.array(even_keys(spark, parts), np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk, (key, place, 0) by bucket; a key that many of its nodes have as one (key, 0, count)."""
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, place = _keys_of(data)
                start = runs(key)
                count = np.diff(np.append(start, len(key)))
                hot = count > HOT
                marks = np.zeros(len(key), np.uint32)
                marks[start[hot]] = count[hot]
                keep = ~np.repeat(hot, count) | (marks > 0)
                key, place, marks = key[keep], place[keep], marks[keep]
                edge = np.searchsorted(key, np.array([i * 2**48 // parts for i in range(parts)], U))
                rows = [(int(buckets[b]), chunk, pack(steps(key[x:y]), place[x:y], marks[x:y])) for b, (x, y) in enumerate(zip(edge, [*edge[1:], len(key)])) if y > x]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "chunk", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk's entries, those whose key comes twice or stands for many."""
        chunks: list[int] = []
        found: list[list[np.ndarray]] = []
        for batch in batches:
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                c = unpack(data)
                c[0] = np.cumsum(c[0], dtype=U)
                chunks.append(chunk)
                found.append(c)
        if not found:
            return
        key = np.sort(np.concatenate([c[0] for c in found]))
        start = runs(key)
        key, count = key[start], np.diff(np.append(start, len(key)))
        for c in found:
            hot = np.flatnonzero(c[2])
            count[np.searchsorted(key, c[0][hot])] += c[2][hot].astype(np.int64) - 1
        key, count = key[count > 1], count[count > 1]
        mask = (1 << max(16, (64 * len(key)).bit_length())) - 1  # most keys come once, and few of those pass by their low bits
        low = np.zeros(mask + 1, bool)
        low[key & U(mask)] = True
        for chunk, (k, place, mark) in zip(chunks, found) if len(key) else ():
            some = np.flatnonzero(low.take((k & U(mask)).astype(np.intp)))
            k, place, mark = k[some], place[some], mark[some]
            at = np.minimum(np.searchsorted(key, k), len(key) - 1)
            hit = key[at] == k
            if hit.any():
                yield pa.record_batch([pa.array([chunk]), pa.array([1], pa.int32()), pa.array([pack(steps(k[hit]), place[hit], (mark[hit] > 0).astype(np.uint8), count[at[hit]])], pa.binary())], ["chunk", "kind", "data"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "k", "doc", "row", "line", "hk", "hkey", "text"]
        now, own, hits = None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            node, doc, row, line, _ = unpack(own[0])
            sizes, raw = unpack(own[1])
            key = np.concatenate([np.cumsum(h[0], dtype=U) for h in hits])
            place, mark, count = np.concatenate([h[1] for h in hits]), np.concatenate([h[2] for h in hits]).astype(bool), np.concatenate([h[3] for h in hits])
            if mark.any():  # keys that stand for many: all their places are found again here
                all_key, all_place = _keys_of(own[1])
                order = np.flatnonzero(mark)[np.argsort(key[mark])]
                at = np.minimum(np.searchsorted(key[order], all_key), len(order) - 1)
                again = key[order][at] == all_key
                key, place, count = np.concatenate([key[~mark], all_key[again]]), np.concatenate([place[~mark], all_place[again]]), np.concatenate([count[~mark], count[order][at[again]]])
            for i in range(0, len(key), 50_000):
                p = slice(i, i + 50_000)
                n = len(key[p])
                none = pa.nulls(n, pa.int64())
                yield pa.record_batch([pa.array(key[p].astype(np.int64)), pa.array(node[place[p]]), pa.array(count[p]), *[none] * 5, pa.nulls(n, pa.binary())], names)
            order = np.lexsort((key, count, place))
            last = np.append(runs(place[order])[1:], len(order)) - 1  # of every place the key of most nodes
            at, hk, hkey = place[order][last], count[order][last], key[order][last].astype(np.int64)
            texts = _texts(sizes, raw)
            for i in range(0, len(at), 5_000):
                p = slice(i, i + 5_000)
                none = pa.nulls(len(at[p]), pa.int64())
                yield pa.record_batch([none, pa.array(node[at[p]]), none, *(pa.array(c[at[p]]) for c in (doc, row, line)), pa.array(hk[p]), pa.array(hkey[p]), pa.array([texts[x] for x in at[p].tolist()], pa.binary())], names)

        for batch in batches:
            for chunk, kind, data, first in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    if hits:
                        yield from out()
                    now, own, hits = chunk, None, []
                if kind == 0:
                    own = first, data
                else:
                    hits.append(unpack(data))
        if hits:
            yield from out()

    met = lines.select("chunk", "data").mapInArrow(trimmed(send), "bucket int, chunk long, data binary").repartition(parts, "bucket").mapInArrow(trimmed(gather), "chunk long, kind int, data binary")
    both = met.withColumn("places", F.lit(None).cast("binary")).unionByName(lines.select("chunk", F.lit(0).alias("kind"), "data", "places"))
    return both.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(trimmed(name), "key long, node long, k long, doc long, row long, line long, hk long, hkey long, text binary")


def _keys_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 48-bit band keys of a chunk's lines, and the line's place of each."""
    texts = _texts(*unpack(data))
    keys = signatures(texts, sets=False)[1]
    packed = np.sort(keys.ravel() >> U(16) << U(16) | np.repeat(np.arange(len(texts), dtype=U), BANDS))
    return packed >> U(16), (packed & U(65535)).astype(np.uint16)


def repeated_lines(lines: DataFrame) -> DataFrame:
    """node, doc, row, line of distinct lines that occur more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                node, doc, row, line, count = unpack(data)
                at = count > 1
                yield pa.record_batch([pa.array(x[at]) for x in (node, doc, row, line)], ["node", "doc", "row", "line"])

    return lines.select("places").mapInArrow(trimmed(rows), "node long, doc long, row long, line long")


def places(docs: DataFrame) -> DataFrame:
    """doc, row, line, node of every line that takes part. docs: doc, row, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, line, keys = [], [], []
            for k, text in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
                forms = normals(text or b"")
                with_words = [j for j, x in enumerate(forms) if x is not None]
                at += [k] * len(with_words)
                line += with_words
                keys += [x for x in forms if x is not None]
            own = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(line, pa.int32()), pa.array(nodes_of(keys))], ["doc", "row", "line", "node"])

    return docs.mapInArrow(trimmed(rows), "doc long, row long, line int, node long")


def dropped_lines(docs: DataFrame, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the lowest long for null), row (``row_key``) and the sorted numbers of its lines that go; rows that keep all are absent."""
    ship(docs.sparkSession)
    plain = docs.select(_doc(id_col).alias("doc"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    lines = materialise(distinct_lines(plain), "lines", free=True, codec="none")  # its columns are compressed already
    groups = materialise(band_groups(lines), "line-groups", free=True)
    items = groups.filter("key is null")
    found = link(groups.filter("key is not null").select("key", "node", "k"), items.select("node", "hk", "hkey", F.col("text").alias("payload")), decode, share)
    marked = repeated_lines(lines).join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    marked = materialise(marked.unionByName(items.select("node", "doc", "row", "line").join(found, "node")).distinct(), "marked", free=True)
    discard(lines)
    discard(groups)
    kept = materialise(marked.groupBy("comp").agg(F.min(F.struct("doc", "row", "line")).alias("kept")), "kept")
    rule = marked.select("node", "comp").join(kept, "comp").select("node", F.col("kept.doc").alias("kdoc"), F.col("kept.row").alias("krow"), F.col("kept.line").alias("kline"))
    gone = places(plain).join(rule, "node").filter("doc != kdoc or row != krow or line != kline").select("doc", "row", "line").distinct()
    return gone.groupBy("doc", "row").agg(F.sort_array(F.collect_list("line")).alias("dropped"))


def _doc(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))


def _with_drops(docs: DataFrame, columns: list, id_col: str, text_col: str) -> DataFrame:
    """``columns`` of ``docs`` with ``_gone_lines``, the numbers of the lines that go, or null.

    Rows without id that are equal in text share a key: all but one of them lose every line with a word.
    """
    with scratch():
        gone = dropped_lines(docs, SHARE, id_col, text_col).select(F.col("doc").alias("_gone_doc"), F.col("row").alias("_gone_row"), F.col("dropped").alias("_gone_lines"))
        gone = materialise(gone, "dropped", free=True, lasting=True)
    row = row_key(id_col, text_col)
    nameless = F.col(id_col).cast("long").isNull()
    joined = docs.select(*columns, _doc(id_col).alias("_doc"), row.alias("_row"), nameless.alias("_nameless")).join(gone, (F.col("_doc") == gone["_gone_doc"]) & (F.col("_row") == gone["_gone_row"]), "left")
    joined = joined.drop("_doc", "_gone_doc", "_gone_row")
    equal = docs.filter(nameless & F.col(text_col).isNotNull()).groupBy(row.alias("_equal")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_equal")
    equal = materialise(equal, "equal-rows")
    if equal.isEmpty():
        return joined.drop("_row", "_nameless")

    @F.arrow_udf("array<int>")
    def worded(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [i for i, x in enumerate(normals(t.encode())) if x is not None] for t in text.to_pylist()], pa.list_(pa.int32()))

    # the lines with a word of such a text, once per text: its later rows lose them all
    all_lines = docs.filter(nameless).select(row.alias("_equal"), F.col(text_col).alias("_text")).join(equal, "_equal").groupBy("_equal").agg(F.first("_text").alias("_text"))
    all_lines = materialise(all_lines.select("_equal", worded("_text").alias("_all_lines")), "equal-lines")
    joined = joined.withColumn("_key", F.when(F.col("_nameless"), F.col("_row"))).join(all_lines, F.col("_key") == F.col("_equal"), "left")
    one = joined.filter("_equal is null").drop("_row", "_nameless", "_key", "_equal", "_all_lines")
    # the first of each task, then the first of those: a large group is not dealt to one task
    several = joined.filter("_equal is not null").withColumn("_task", F.spark_partition_id())
    several = several.withColumn("_nth", F.row_number().over(Window.partitionBy("_row", "_task").orderBy("_task")))
    several = materialise(several, "nameless")
    ahead = several.filter("_nth = 1").withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_task")))
    later = ahead.filter("_nth > 1").unionByName(several.filter("_nth > 1")).withColumn("_gone_lines", F.col("_all_lines"))
    return one.unionByName(ahead.filter("_nth = 1").unionByName(later).select(*one.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: number of lines, and the numbers (from 0) of those dropped."""

    @F.arrow_udf("long")
    def n_lines(text: pa.Array) -> pa.Array:
        return pc.add(pc.count_substring(text.fill_null(""), "\n").cast(pa.int64()), 1)

    found = _with_drops(docs, [F.col(id_col).cast("long").alias("doc_id"), n_lines(F.col(text_col)).alias("n_lines")], id_col, text_col)
    gone = F.col("_gone_lines")
    return found.select("doc_id", "n_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(gone, F.array().cast("array<int>")).alias("dropped"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; columns and their order stay."""

    @F.arrow_udf("string")
    def without(text: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for t, numbers in zip(text.to_pylist(), lines.to_pylist()):
            if numbers and t is not None:
                less = set(numbers)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in less)
            out.append(t)
        return pa.array(out, pa.string())

    joined = _with_drops(docs, docs.columns, id_col, text_col)
    joined = joined.withColumn(text_col, without(F.col(text_col), F.col("_gone_lines"))).drop("_gone_lines")
    if length_col and length_col in docs.columns:
        joined = joined.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return joined.select(*docs.columns)
