"""WARC archives of pages and the external merge of their capture index.

``write_archives`` writes one gzip member per page into archives of bounded size, with each archive's capture run: its
captures sorted by URL key, timestamp and page. Archives are rows of a table in the shared folder, so Spark's commit
protocol covers retried tasks on any file system Spark can write; ``data`` is the exact content of a .warc.gz file, and
``export`` writes them out. ``merge_index`` merges all runs into one global order: captures are range-partitioned by the
whole sort key, so one URL with very many captures spreads over partitions, each partition sorts its share by run (Spark
sorts externally), and a loser tree merges the k runs, read through one cursor each. ``read_archives`` parses the archives again.

Of records with equal payloads of at least ``REVISIT_BYTES``, that of the smallest page id is the response and the others
revisit it.

Defined cases: a null html is an empty payload and always a response; a null url has the empty key; rows repeated with
the smallest id are all responses; a null id is never the one revisited unless all ids of the payload are null, in which case all
are responses; line breaks and controls in a url are percent-encoded; ties of key and time are ordered by page, archive
and offset; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts_for, ship

REVISIT_BYTES, ARCHIVE_BYTES, PART_BYTES = 100, 8 << 20, 16 << 20
#: Bytes given to the decompressor at once, rows of a run decoded at once, and bytes of a capture in a range, on average.
FEED, AHEAD, CAPTURE_BYTES = 16 << 10, 512, 200
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
RUN = "array<struct<urlkey: string, stamp: string, page_id: long, offset: long, length: long>>"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then the path; scheme, www. and default ports dropped; host in lower case."""
    rest = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower().removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path if host else ""


def record(page: int | None, url: str | None, stamp: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    kind = "response" if refers is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page}>", f"WARC-Date: {stamp}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; a response's digest and length are of the payload read, a revisit's those it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x == "<urn:x-page:None>" else int(x[len("<urn:x-page:") : -1])
    out = {"page_id": number(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "url": fields["warc-target-uri"], "warc_date": fields["warc-date"]}
    if out["record_type"] == "response":
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    return out | {"payload": None, "payload_bytes": length, "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:")}


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, end, content = zlib.decompressobj(31), at, []
        while not d.eof and end < len(data):
            content.append(d.decompress(view[end : end + FEED]))
            end = min(end + FEED, len(data))
        end -= len(d.unused_data)
        yield at, end - at, b"".join(content)
        at = end


class LoserTree:
    """Merges k sorted iterables: every inner node holds the loser of its match, the winner is replayed along one path."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """An exhausted run loses to all; equal heads go to the earlier run."""
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # while building: wait here for the opponent
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (item := self.head[w := self.tree[0]]) is not None:
            yield item
            self.head[w] = next(self.runs[w], None)
            self._play(w)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, stamp, digest, and of revisits the response's page id."""
    typed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    light = typed.select("page_id", "digest", F.octet_length("payload").alias("n")).filter(F.col("n") >= REVISIT_BYTES).select("page_id", "digest").distinct()
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    revisits = light.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    return typed.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", F.col("first").alias("refers"))


def write_archives(pages: DataFrame, level: int = 3) -> DataFrame:
    """A table of archives: name, content, capture run."""
    ship(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        run: list[tuple] = []
        at = 0

        def close() -> pa.RecordBatch:
            run.sort(key=lambda x: (x[0], x[1], x[2] is None, x[2] or 0, x[3]))
            kinds = pa.list_(pa.struct([("urlkey", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
            names = ("urlkey", "stamp", "page_id", "offset", "length")
            return pa.record_batch([pa.array([f"pages-{task:06d}-{number:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary()), pa.array([[dict(zip(names, x)) for x in run]], kinds)], ["archive", "data", "run"])

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                stamp = (EPOCH + timedelta(seconds=(page or 0) % 1_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = c.compress(record(page, url, stamp, payload, digest, refers)) + c.flush()
                run.append((url_key(url), stamp, page, at, len(data)))
                parts.append(data)
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    parts, run, at, number = [], [], 0, number + 1
        if parts:
            yield close()

    return classify(pages).mapInArrow(rows, f"archive string, data binary, run {RUN}")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives, in archive order."""
    ship(archives.sparkSession)
    schema = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [{"archive": archive, "offset": at} | parse(content) for at, _, content in members(data.as_py())]
                if found:
                    yield pa.record_batch([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names)

    return archives.select("archive", "data").mapInArrow(rows, schema)


def _cursor(chunks: list[pa.RecordBatch]) -> Iterator[tuple]:
    """Captures of one sorted run as sort keys, a few rows decoded at a time; chunks are let go as they are used up."""
    chunks.reverse()
    while chunks:
        chunk = chunks.pop()
        for i in range(0, chunk.num_rows, AHEAD):
            for u, s, p, a, o, n in zip(*(c.to_pylist() for c in chunk.slice(i, AHEAD).columns)):
                yield u, s, p is None, p or 0, a, o, n


def merge_index(archives: DataFrame) -> DataFrame:
    """All captures in global order of URL key, timestamp, page, with ``capture``: the place, from 1, in the history of its URL key.

    ``position`` grows along the order: the number of the range above its lowest 40 bits, the place in the range in these. Ranges have about ``PART_BYTES``
    of captures. A task holds its range as Arrow columns, one cursor per run, and merges them by the loser tree.
    """
    spark = archives.sparkSession
    ship(spark)
    n = archives.agg(F.sum(F.size("run"))).collect()[0][0] or 0
    entries = archives.select("archive", F.explode("run").alias("e")).select("archive", "e.*")
    keys = ["urlkey", "stamp", "page_id", "archive", "offset"]
    dealt = entries.repartitionByRange(parts_for(spark, n * CAPTURE_BYTES, PART_BYTES), *keys).sortWithinPartitions("archive", *keys[:3], "offset").select(*keys, "length")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            names = batch.column(3)
            cut = [0, *(i for i in range(1, batch.num_rows) if names[i] != names[i - 1]), batch.num_rows] if batch.num_rows else [0]
            for x, y in zip(cut, cut[1:]):
                runs.setdefault(names[x].as_py(), []).append(batch.slice(x, y - x))
        part, nth, url, capture, out = TaskContext.get().partitionId(), 0, None, 0, []
        fields = ["part", "nth", "capture", "urlkey", "stamp", "page_id", "archive", "offset", "length"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for u, s, null, p, a, o, n in LoserTree(_cursor(r) for r in runs.values()):
            capture, url = capture + 1 if u == url else 1, u
            out.append((part, nth, capture, u, s, None if null else p, a, o, n))
            nth += 1
            if len(out) == 10_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)

    merged = materialise(dealt.mapInArrow(rows, "part int, nth long, capture long, urlkey string, stamp string, page_id long, archive string, offset long, length long"), "merged")
    # a history that goes on in later ranges: what the earlier ranges have of it is added
    ends = merged.groupBy("part").agg(F.min("urlkey").alias("lo"), F.max("urlkey").alias("hi")).select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("urlkey"))
    pieces = merged.groupBy("part", "urlkey").agg(F.max("capture").alias("n")).join(ends, ["part", "urlkey"])
    earlier = pieces.select("part", "urlkey", (F.sum("n").over(Window.partitionBy("urlkey").orderBy("part")) - F.col("n")).alias("earlier")).filter("earlier > 0")
    return merged.join(earlier, ["part", "urlkey"], "left").withColumn("capture", F.col("capture") + F.coalesce("earlier", F.lit(0))).withColumn("position", F.shiftleft(F.col("part").cast("long"), 40) + F.col("nth")).drop("earlier", "part", "nth")


def capture_histories(pages: DataFrame) -> DataFrame:
    """Write, read back and order: one row per page with its record's facts and its place in the merged index."""
    archives = materialise(write_archives(pages), "archives", free=True)
    records = read_archives(archives).select("archive", "offset", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return merge_index(archives).join(records, ["archive", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "stamp", "capture", "archive", "offset", "length", "position"
    )


def export(archives: DataFrame, folder: str) -> int:
    """Write every archive as a file of its own under a folder all executors share; how many there were."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                attempt = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(attempt) as f:
                    f.write(data.as_buffer())
                system.move(attempt, f"{base}/{name}")
            yield pa.record_batch([batch.column(0)], ["archive"])

    return archives.select("archive", "data").mapInArrow(rows, "archive string").count()
