"""Token-id files: canonical length-limited Huffman codes of ids by their global counts, in independently decoded blocks.

A file is a folder of tables in the shared store: ``codes`` (one row: the code length of every id, which is all that a
canonical code needs), ``blocks`` (whole documents in ascending order, their ids as bits, and every ``STEP`` ids the number
of bits passed, as checkpoints) and ``parts`` (ids before each range of documents). Documents are put in order as texts, so
that ids are written once and encoded where they lie. Counts are summed in every task, then by Spark; the driver holds one
count per vocabulary entry and one sum per range, at most ``MAX_RANGES``. Decoding looks up ``max_bits`` bits at a time in a
table and runs along all checkpointed segments of a batch of blocks at once.

Defined cases: a null text is empty, and an empty document has the end id alone. Documents are in ascending order of ids,
null ids first, rows of one id by a hash of their texts; rows equal in both are interchangeable, and each has its own place
in the file. Long texts are encoded whole, and a document lies in one block. An empty table makes a file without blocks,
which reads as no rows. Other columns, whatever their names, are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import delete_path, parts_for, ship, table_path, trimmed
from .textkit import as_strings

#: Longest code in bits where the vocabulary allows it; ids from checkpoint to checkpoint; ids after which a block ends.
MAX_BITS, STEP, BLOCK = 20, 128, 1 << 16
#: Bytes of text in a range of documents, until there are so many ranges that they grow instead.
RANGE_BYTES, MAX_RANGES = 16 << 20, 100_000
#: White space of the pre-tokenizer's pattern (fixed values).
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BLANK = frozenset(SPACES)
CACHE, CACHE_CHARS = 300_000, 48


def _with(column: pa.Array, text: str) -> pa.Array:
    """Which rows contain a text; where all their bytes together don't, no row does."""
    raw, offs = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int64)
    if raw is None or bytes(raw[offs[column.offset] : offs[column.offset + len(column)]]).find(text.encode()) < 0:
        return pa.array(np.zeros(len(column), bool))
    return pc.match_substring(column, text)


class ByteIds:
    """Ids of a byte-level vocabulary file, cached by chunk: what came once is kept apart from what came again, as most kinds of chunks come once.

    The pre-tokenizer starts a piece at every blank before a character that is no white space, and at both ends of a line
    break between two such characters or of two of them. So chunks between these encode apart, and unknown ones are encoded
    in one text, with blanks or line breaks between them. Texts with other white space at such a place are cut by the
    pattern ``pieces`` instead, which keeps white space as the pre-tokenizer does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.opens, self.breaks = np.zeros(self.size, bool), np.zeros(self.size, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.breaks[vocabulary["Ċ"]] = True
        self.pieces = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
        # keys: a chunk behind a blank, \0 and a chunk at the start of a line or text, and the line break
        self.fixed = {"\0": b"", "\n": np.array([vocabulary["Ċ"]], self.kind).tobytes()}
        self.cache: dict[str, bytes] = dict(self.fixed)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str], blank: bool) -> list[bytes]:
        """Chunks each behind a blank, or each on a line of its own: encoded as one text, cut at tokens that open with a blank, or at line breaks."""
        if not chunks:
            return []
        text = " " + " ".join(chunks) if blank else "\n".join(chunks)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        at = np.flatnonzero((self.opens if blank else self.breaks)[ids])
        if len(at) != len(chunks) - (not blank):
            return self._ids([" " + c if blank else c for c in chunks])
        data, size = ids.tobytes(), self.kind.itemsize
        if blank:
            start, end = at, np.append(at[1:], len(ids))
        else:
            start, end = np.append(0, at + 1), np.append(at, len(ids))
        return [data[a:b] for a, b in zip((size * start).tolist(), (size * end).tolist())]

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of chunks that no cache has."""
        blank, lead = [k for k in keys if k[0] != "\0"], [k for k in keys if k[0] == "\0"]
        out = dict(zip(blank, self._joined(blank, True)))
        out.update(zip(lead, self._joined([k[1:] for k in lead], False)))
        return out

    def _whole(self, text: str) -> bytes:
        pieces = self.pieces(text)
        if len(self.plain) > CACHE:
            self.plain = {}
        missing = list({p for p in pieces if p not in self.plain})
        found = dict(zip(missing, self._ids(missing))) if missing else {}
        out = b"".join(found[p] if p in found else self.plain[p] for p in pieces)
        self.plain.update((p, x) for p, x in found.items() if len(p) <= CACHE_CHARS)
        return out

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of every text of a column: its chunks are cut and told apart as Arrow arrays, so Python sees each kind of chunk once."""
        column = as_strings(column)
        if not len(column):
            return []
        odd = pc.or_(pc.or_(_with(column, "\0"), _with(column, "\n\n\n")), pc.ends_with(column, "\n\n"))
        lines = pc.replace_substring(column, "\n", " \n \0")
        odd = pc.or_(odd, pc.or_(_with(lines, "  "), pc.ends_with(lines, " "))).to_numpy(zero_copy_only=False).copy()
        # a mark between a letter and a blank is a piece by itself
        lines = pc.replace_substring_regex(lines, "([A-Za-z])([.,;:!?]) ", "\\1 \0\\2 ")
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), lines, pa.scalar("", pa.large_string())), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        kind, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, keys))
        gaps = [i for i, f in enumerate(found) if f is None]
        young, old, new = self.young, self.old, set()
        for i in gaps:
            k = keys[i]
            if (f := young.get(k)) is None and (f := old.get(k)) is None:
                new.add(k)
            else:
                found[i] = self.cache[k] = f
        # chunks with white space at an end, and empty ones, cannot stand for themselves
        bad = {k for k in new if not k or k[-1] in BLANK or (k[1:2] if k[0] == "\0" else k[0]) in BLANK}
        learnt = self._learn(new - bad)
        if bad:
            odd |= np.logical_or.reduceat(np.array([k in bad for k in keys])[kind], offsets[:-1] - offsets[0])
        if new:
            for i in gaps:
                if found[i] is None:
                    found[i] = learnt.get(keys[i], b"")
        young.update(learnt)
        for k in [k for k in learnt if len(k) > CACHE_CHARS]:
            del young[k]
        if len(young) > CACHE:
            self.old, self.young = young, {}
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, dict(self.fixed)
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        out = joined.buffers()[2].to_pybytes() if joined.buffers()[2] else b""
        ends = np.frombuffer(joined.buffers()[1], np.int64)[offsets[1:] - offsets[0]].tolist()
        return [self._whole(column[i].as_py()) if o else out[a:b] for i, (o, a, b) in enumerate(zip(odd.tolist(), [0, *ends], ends))]


@lru_cache(maxsize=4)
def byte_ids(path: str) -> ByteIds:
    """One per worker process, so that its cache outlives a task."""
    return ByteIds(path)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of the best prefix code of at most ``max_bits`` bits (more where that many symbols need them), by package-merge; 0 for counts of 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, single = weights, [np.ones(n, bool)]
    for _ in range(max(max_bits, (n - 1).bit_length()) - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        level = both[by]
        single.append(by < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for items in reversed(single):
        k = int(np.count_nonzero(items[:take]))
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths: codes of one length follow each other in the order of ids, longer ones after shorter ones."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(self.lengths.max(initial=1)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        width = np.int64(1) << (self.bits - self.lengths[order])
        start = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = start >> (self.bits - self.lengths[order])
        self._order, self._width = order, width
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """The id whose code leads each value of ``bits`` bits."""
        if self._table is None:
            t = np.repeat(self._order, self._width)
            self._table = np.concatenate([t, np.zeros((1 << self.bits) - len(t), np.int64)]).astype(np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32)
        return self._table

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """Bits as big-endian words of 32, two words of padding behind them, and the bits of every ``step`` ids."""
        n = self.lengths[ids]
        at = np.cumsum(n) - n
        total = int(n.sum())
        word, shift = at >> 5, (64 - (at & 31) - n).astype(np.uint64)
        placed = self.codes[ids] << shift
        words = total // 32 + 3
        # places of codes do not overlap, so sums of whole numbers below 2**32 are their union, exact in a double
        high = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), minlength=words)
        low = np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
        return (high + low).astype(np.uint32).astype(">u4").tobytes(), np.add.reduceat(n, np.arange(0, len(n), step)).astype(np.uint32) if len(n) else np.zeros(0, np.uint32)

    def decode(self, words: np.ndarray, starts: np.ndarray, step: int) -> np.ndarray:
        """``step`` ids from each start (in bits): a row per step, a column per start."""
        wide = words.astype(np.uint64)
        window = np.append(wide[:-1] << np.uint64(32) | wide[1:], np.uint64(0))
        at, last = starts.astype(np.int64), 32 * len(words) - 64
        table, lengths, keep = self.table, self.lengths, np.uint64((1 << self.bits) - 1)
        out = np.empty((step, len(at)), table.dtype)
        for i in range(step):
            shift = (64 - self.bits - (at & 31)).astype(np.uint64)
            out[i] = table[(window[at >> 5] >> shift) & keep]
            at = np.minimum(at + lengths[out[i]], last)
        return out

    def segments(self, words: np.ndarray, first: np.ndarray, checkpoints: list[np.ndarray], counts: list[int], step: int = STEP) -> list[np.ndarray]:
        """Ids of blocks whose bits start at the words ``first``: all segments of all blocks are decoded side by side."""
        each = np.array([len(c) for c in checkpoints], np.int64)
        bits = np.concatenate([*checkpoints, np.zeros(0, np.uint32)]).astype(np.int64)
        before = np.cumsum(bits) - bits
        block = np.repeat(np.arange(len(each)), each)
        lead = np.cumsum(each) - each
        starts = before - before[np.minimum(lead, len(before) - 1)][block] + 32 * first[block] if len(bits) else bits
        ids = self.decode(words, starts, step).T
        return [ids[a : a + k].ravel()[:n] for a, k, n in zip(lead, each, counts)]

    def span(self, bits: bytes, checkpoints: np.ndarray, start: int, n: int, step: int = STEP) -> np.ndarray:
        """n ids from place ``start`` of a block on, without decoding what lies before the checkpoint."""
        a, b = start // step, (start + n + step - 1) // step
        before = np.cumsum(checkpoints.astype(np.int64)) - checkpoints
        return self.decode(np.frombuffer(bits, ">u4"), before[a:b], step).T.ravel()[start - a * step :][:n]


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in ascending order over ranges; a last key spreads rows that are equal otherwise."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(parts_for(docs.sparkSession, total, RANGE_BYTES), MAX_RANGES)
    by = [F.col("doc_id").asc_nulls_first(), F.col("mark").asc(), F.col("serial").asc()]
    t = t.withColumns({"mark": F.xxhash64("text"), "serial": F.monotonically_increasing_id()})
    return t.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("doc_id", "text")


def _tokenised(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Per document its range, the ids before it there, and its ids, the end id last; per range a last row with how often each id comes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = byte_ids(path)
        end = b"" if end_id is None else np.array([end_id], t.kind).tobytes()
        part, before, total = TaskContext.get().partitionId(), 0, np.zeros(t.size, np.int64)
        for b in batches:
            ids = [x + end for x in t.encode_column(b.column(1))]
            total += np.bincount(np.frombuffer(b"".join(ids), t.kind), minlength=t.size)
            n = np.array([len(x) for x in ids], np.int64) // t.kind.itemsize
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(at), b.column(0), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.record_batch([pa.array([part], pa.int32()), *(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.binary())), pa.array([pack(used.astype(np.int32), total[used])], pa.binary())], names)

    names = ["part", "before", "doc_id", "ids", "counts"]
    return docs.mapInArrow(trimmed(rows), "part int, before long, doc_id long, ids binary, counts binary")


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binary values, and where each row's begin in them."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.view(kind), (offs - offs[0]) // kind.itemsize


def _counted(counts: DataFrame, size: int) -> np.ndarray:
    """How often each id comes, from the ranges' counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield pa.record_batch([pa.array(x) for x in unpack(data)], ["id", "n"])

    found = counts.mapInArrow(rows, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["id"]] = found["n"]
    return out


BLOCKS = "part int, before long, n_ids long, doc_ids array<long>, counts array<int>, checkpoints binary, bits binary"


def _encoded(ids: DataFrame, lengths: np.ndarray, kind: np.dtype) -> DataFrame:
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in batches:
            part, before = (b.column(i).to_numpy() for i in (0, 1))
            flat, at = _flat(b.column(3), kind)
            n = np.diff(at)
            # a new block where rows do not follow each other, and wherever the ids so far pass a multiple of BLOCK
            new = np.ones(len(n), bool)
            new[1:] = (part[1:] != part[:-1]) | (before[1:] != before[:-1] + n[:-1]) | (at[1:-1] // BLOCK != at[:-2] // BLOCK)
            edges = [*np.flatnonzero(new).tolist(), len(n)]
            out = []
            for i, j in zip(edges, edges[1:]):
                bits, marks = code.encode(flat[at[i] : at[j]].astype(np.int64))
                out.append((int(part[i]), int(before[i]), int(at[j] - at[i]), b.column(2).slice(i, j - i).to_pylist(), n[i:j].tolist(), marks.astype("<u2").tobytes(), bits))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    return ids.mapInArrow(rows, BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token-id file of all texts under ``path``, ids by the vocabulary file ``tokenizer``, ``end_id`` after each document."""
    spark = docs.sparkSession
    ship(spark)
    if max_bits > 32:
        raise ValueError("codes have at most 32 bits")
    t = byte_ids(tokenizer)
    _tokenised(_ordered(docs, id_col, text_col), tokenizer, end_id).write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    lengths = code_lengths(_counted(ids.filter("counts is not null").select("counts"), t.size), max_bits)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    _encoded(ids.filter("counts is null").drop("counts"), lengths, t.kind).write.option("compression", "zstd").parquet(f"{path}/blocks")
    delete_path(spark, f"{path}/ids")
    sums = sorted(spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids")).collect())
    first, rows = 0, []
    for part, n in sums:
        rows.append((part, first))
        first += n
    spark.createDataFrame(rows, "part int, first long").coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document of a file."""
    ship(spark)
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codes").first()[0]), np.uint8)
    # a row per range of documents, MAX_RANGES at most
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")
    blocks = blocks.select((F.col("first") + F.col("before")).alias("start"), "n_ids", "doc_ids", "counts", "checkpoints", "bits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in batches:
            if not b.num_rows:
                continue
            start, n_ids = (b.column(i).to_numpy() for i in (0, 1))
            words, first = _flat(b.column(5), np.dtype(">u4"))
            marks, at = _flat(b.column(4), np.dtype("<u2"))
            found = code.segments(words, first[:-1], [marks[x:y] for x, y in zip(at, at[1:])], n_ids.tolist())
            for i, ids in enumerate(found):
                n = b.column(3)[i].values.to_numpy().astype(np.int64)
                inside = np.cumsum(n) - n
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(4 * inside, 4 * n.sum())), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
                yield pa.record_batch([b.column(2)[i].values, pa.array(start[i] + inside), pa.array(n), data], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a file, read it back: place, length and CRC-32 of every document's ids."""
    spark = docs.sparkSession
    path = table_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col=id_col, text_col=text_col)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
