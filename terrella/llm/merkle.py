"""Document fingerprints: a Merkle tree over passages, paragraphs and sections.

Leaves are passages: sentences, cut within lines after . ! or ? before white space, and after a word whose checksum says so
where sentences have more than six words. A paragraph is a line; a section is a run of paragraphs up to a blank line or a paragraph whose
digest says so, so edits do not move later boundaries. Each node's digest is of its level and its children's digests. The
fingerprint names the root's digest, which settles equality, then every section with the digests of its leaves, in which
two fingerprints show where they differ. Likeness is twice the shared leaves over all leaves of both (as multisets).

Defined cases: a null text equals an empty one (a tree without leaves; two such have likeness 1); repeated rows and equal
ids are ordered by a hash of the text and each follows the other; null ids come first in the order; the last row is followed by the
first, a single row by itself; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, parts_for, ship
from .textkit import as_strings

LEAF, PART_BYTES, LOWEST = 4, 16 << 20, -(1 << 63)
#: Rows of which the bounds of ranges are taken; they steer balance alone.
SAMPLE = 20_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_CUT = re.compile(r"(?<=[.!?])[ \t]+")


def _digest(level: bytes, data: bytes) -> bytes:
    return hashlib.sha256(level + data).digest()


def passages(line: str) -> list[str]:
    """Sentences of a line, of more than six words cut further where a word's checksum says so, and after twelve words."""
    out = []
    for s in _CUT.split(line):
        words = s.split(" ")
        if len(words) <= 6:
            out.append(s)
            continue
        first = 0
        for i, w in enumerate(words, 1):
            n = i - first
            if n >= 12 or n >= 3 and not crc32(w.encode()) & 3:
                out.append(" ".join(words[first:i]))
                first = i
        if first < len(words):
            out.append(" ".join(words[first:]))
    return out


class Tree:
    """Digests of a text's root and sections, and of the leaves of each section."""

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list[bytes]]] = []
        leaves: list[bytes] = []
        nodes: list[bytes] = []
        memo: dict[str, tuple[list[bytes], bytes]] = {}
        for line in text.split("\n") if text else []:
            found = memo.get(line)
            if found is None:
                own = [_digest(b"p", p.encode()) for p in passages(line)]
                found = memo[line] = ([x[:LEAF] for x in own], _digest(b"g", b"".join(own)))
            leaves += found[0]
            nodes.append(found[1])
            if not line or found[1][0] % 8 == 0:
                self.sections.append((_digest(b"s", b"".join(nodes)), leaves))
                leaves, nodes = [], []
        if nodes:
            self.sections.append((_digest(b"s", b"".join(nodes)), leaves))
        self.root = _digest(b"r", b"".join(s for s, _ in self.sections))

    def fingerprint(self) -> str:
        """root:section.leaves/section.leaves/... in lower-case hex; a section shows its first 4 bytes."""
        return self.root.hex() + ":" + "/".join(f"{s[:4].hex()}.{b''.join(leaves).hex()}" for s, leaves in self.sections)


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[str]]]]:
    root, _, rest = fingerprint.partition(":")
    cut = lambda x: [x[i : i + 2 * LEAF] for i in range(0, len(x), 2 * LEAF)]
    return root, [(s.split(".")[0], cut(s.split(".")[1])) for s in rest.split("/") if s]


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 1 for equal roots, else shared leaves twice over all leaves; below 1 whenever roots differ."""
    (ra, sa), (rb, sb) = parse(a), parse(b)
    if ra == rb:
        return 1.0
    ca, cb = Counter(x for _, s in sa for x in s), Counter(x for _, s in sb for x in s)
    n = ca.total() + cb.total()
    return min(2 * (ca & cb).total() / n, 1 - 1 / (2 * n)) if n else 0.0


def differing(a: str, b: str) -> list[int]:
    """Numbers of a's sections that b has not, by walking down only where roots differ."""
    (ra, sa), (rb, sb) = parse(a), parse(b)
    if ra == rb:
        return []
    have = Counter((s, *leaves) for s, leaves in sb)
    out = []
    for i, (s, leaves) in enumerate(sa):
        key = (s, *leaves)
        have[key] -= 1
        if have[key] < 0:
            out.append(i)
    return out


def _like(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    ca, cb = Counter(x for _, s in a.sections for x in s), Counter(x for _, s in b.sections for x in s)
    n = ca.total() + cb.total()
    return min(2 * (ca & cb).total() / n, 1 - 1 / (2 * n)) if n else 0.0


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by as many of the other text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint and nothing else."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def tree(text: pa.Array) -> pa.Array:
        return pa.array([Tree(t).fingerprint() for t in as_strings(text).to_pylist()], pa.string())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), tree(F.col(text_col)).alias("fingerprint"))


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edit by the next in id order, and their likenesses.

    Rows are range-partitioned by id and a hash of the text, so many rows of one id, or without one, are spread. The first row of every partition also goes to the one before (the very first to the
    last), so each partition holds the successor of each of its rows. Only bounds and first ids reach the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()[0]
    parts = parts_for(spark, size["b"] or 0, PART_BYTES)
    sample = plain.select("k", "h").sample(min(1.0, SAMPLE / max(size["n"], 1)), seed=3).collect()
    pair = np.dtype([("k", np.int64), ("h", np.int64)])
    sample = np.sort(np.array([(r["k"], r["h"]) for r in sample], pair))
    cuts = np.unique(sample[[i * len(sample) // parts for i in range(1, parts)]]) if len(sample) else sample

    def part_in_order(k: pa.Array, h: pa.Array) -> np.ndarray:
        at = np.empty(len(k), pair)
        at["k"], at["h"] = k.to_numpy(), h.to_numpy()
        return np.searchsorted(cuts, at, "right")

    @F.arrow_udf("int")
    def part_of(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(part_in_order(k, h).astype(np.int32))

    least = plain.select("k", "h").groupBy(part_of("k", "h").alias("part")).agg(F.min(F.struct("k", "h")).alias("at")).orderBy("part").collect()
    before = {tuple(r["at"]): least[i - 1]["part"] for i, r in enumerate(least)}
    keys = np.array(even_keys(spark, max(parts, len(cuts) + 1)), np.int64)

    @F.arrow_udf("array<struct<part: int, tail: boolean>>")
    def homes(k: pa.Array, h: pa.Array) -> pa.Array:
        own = part_in_order(k, h)
        out = []
        for p, *v in zip(own.tolist(), k.to_pylist(), h.to_pylist()):
            v = tuple(v)
            out.append([{"part": int(keys[p]), "tail": False}] + ([{"part": int(keys[before[v]]), "tail": True}] if v in before else []))
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("tail", pa.bool_())])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def line(doc: int, text: str, tree: Tree, other: str, other_tree: Tree) -> tuple:
            new = edited(text, other)
            t = Tree(new)
            return (None if doc == LOWEST else doc, len(text), hashlib.sha256(new.encode()).hexdigest(), tree.fingerprint(), t.fingerprint(), _like(tree, t), _like(tree, other_tree))

        for batch in batches:
            out = []
            for part, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == part:
                    tree = Tree(text)
                    out.append(line(held[1], held[2], held[3], text, tree))
                    held = None if tail else (part, doc, text, tree)
                elif not tail:
                    held = (part, doc, text, Tree(text))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names)

    # Rows of equal first id and text share a partition; of its copies in the partition before, the first in order is used.
    placed = plain.withColumn("home", F.explode(homes("k", "h"))).select(F.col("home.part").alias("part"), F.col("home.tail").alias("tail"), "k", "h", "text")
    placed = placed.repartition(len(keys), "part").sortWithinPartitions("part", "tail", "k", "h", "text")
    return placed.select("part", "tail", "k", "text").mapInArrow(rows, SCHEMA)
