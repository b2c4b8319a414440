"""Linking similar sets that share a key, and connected components of links.

Items share keys (prefix n-grams, signature bands). Each item has one home block: of its keys the one with most items,
whose group is dealt into blocks of about ``BLOCK`` items by hash. First all pairs within blocks are decided, for large groups
in two independent dealings, and components formed. A group of near copies, however large, is then mostly one component,
inside which no pair needs deciding any more. Last, the items of keys that have several components left visit the other blocks
of those keys' groups, so every remaining pair that shares a key is decided: once, as a pair that was in one block before is
left out. Large components have blocks of their own, and two blocks of one large component never meet; a block with many
visitors is copied, each copy taking a share of them. So the work is linear in a group's size plus the pairs that truly
stay apart, no group has to fit in a task, and no pair is left out.

A pair is decided by length, position in the shared keys, the suffix filter (counts of elements by hash range bound the
difference from below), then the exact overlap, by merging for few pairs or one matrix product for many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import runs
from .common import discard, materialise, parts_for, trimmed

BLOCK, LARGE, RANGES, PART_BYTES = 256, 64, 32, 8 << 20
#: Pairs decided one by one, rows decoded together, and pairs of one key above which they are a matrix of their own.
SMALL, HELD, PAIRS = 40, 1500, 1024
Decode = Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]


class Items:
    """Decoded items of one block: keys with positions, sorted elements, and set sizes."""

    def __init__(self, nodes: list[int], decoded: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], comps: list[int], met: list[list[int | None]]):
        self.nodes, self.comps = nodes, comps
        #: In which earlier blocks each item was; a missing one is unlike all others.
        self.met = [np.array([-1 - i if x is None else x & (1 << 63) - 1 for i, x in enumerate(m)], np.int64).reshape(-1) for m in met]
        self.keys = [d[0] for d in decoded]
        self.positions = [d[1] for d in decoded]
        self.elements = [d[2] for d in decoded]
        self.size = np.array([d[3] for d in decoded], np.int64)

    @cached_property
    def left(self) -> list[np.ndarray]:
        return [n - p - 1 for n, p in zip(self.size.tolist(), self.positions)]

    @cached_property
    def spread(self) -> np.ndarray:
        return np.array([np.bincount((e >> np.uint64(43)).astype(np.int64) % RANGES, minlength=RANGES) for e in self.elements], np.int32).reshape(-1, RANGES)

    @cached_property
    def rest(self) -> np.ndarray:
        return self.size - np.array([len(e) for e in self.elements], np.int64)

    def __len__(self) -> int:
        return len(self.nodes)


def bounds(a: Items, b: Items) -> np.ndarray:
    """Upper bound of each pair's overlap from the first key they share (0: none shared)."""
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(a) or not len(b):
        return out
    key = np.concatenate([*a.keys, *b.keys])
    left = np.concatenate([*a.left, *b.left])
    item = np.repeat(np.arange(len(a) + len(b)), [len(k) for k in (*a.keys, *b.keys)])
    order = np.lexsort((item, key))
    key, left, item = key[order], left[order], item[order]
    start = runs(key)
    end = np.append(start[1:], len(key))
    cut = start + np.add.reduceat(item < len(a), start, dtype=np.int64)
    many = (end - cut) * (cut - start)
    for k in np.flatnonzero(many > PAIRS):
        s, c, e = start[k], cut[k], end[k]
        at = np.ix_(item[s:c], item[c:e] - len(a))
        out[at] = np.maximum(out[at], 1 + np.minimum(left[s:c, None], left[None, c:e]))
    few = np.flatnonzero((many > 0) & (many <= PAIRS))
    for k in np.split(few, np.flatnonzero(np.diff(np.cumsum(many[few]) >> 20)) + 1):
        n = many[k]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(end[k] - cut[k], n)
        x, y = np.repeat(start[k], n) + nth // wide, np.repeat(cut[k], n) + nth % wide
        np.maximum.at(out.reshape(-1), item[x] * len(b) + item[y] - len(a), 1 + np.minimum(left[x], left[y]))
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two arrays of distinct ones share."""
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def overlaps(a: Items, b: Items, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact overlaps of the pairs (i, j)."""
    if len(i) <= 1500:
        return np.array([_common(a.elements[x], b.elements[y]) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    rows, ri = np.unique(i, return_inverse=True)
    cols, rj = np.unique(j, return_inverse=True)
    ea, eb = [a.elements[x] for x in rows], [b.elements[y] for y in cols]
    both = np.intersect1d(np.unique(np.concatenate(ea)), np.unique(np.concatenate(eb)))
    total = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(both), 4096):
        words = both[at : at + 4096]
        m = []
        for sets in (ea, eb):
            x = np.zeros((len(sets), len(words)), np.float32)
            for r, e in enumerate(sets):
                e = e[np.searchsorted(e, words[0]) : np.searchsorted(e, words[-1], "right")]
                p = np.minimum(np.searchsorted(words, e), len(words) - 1)
                x[r, p[words[p] == e]] = 1
            m.append(x)
        total += m[0] @ m[1].T
    return total[ri, rj].astype(np.int64)


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (r := up.get(root, root)) != root:
            root = r
        while (n := up.get(x, x)) != root:
            up[x] = root
            x = n
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _met(a: Items, b: Items) -> np.ndarray:
    """Which pairs were in one block before, and so are decided."""
    return np.logical_or.reduce([(x[:, None] == y[None, :]) & (x[:, None] >= 0) for x, y in zip(a.met, b.met)])


def decide(a: Items, b: Items, forest: Forest, share: tuple[int, int], within: bool) -> list[tuple[int, int]]:
    """Links between the two blocks' items (or within one) that join what the forest has apart."""
    p, q = share
    if len(a) * len(b) <= SMALL:
        return _decide_few(a, b, forest, p, q, within)
    u = bounds(a, b)
    total = a.size[:, None] + b.size[None, :]
    need = -(-p * total // (p + q))
    ok = (u >= need) & (q * np.minimum(a.size[:, None], b.size[None, :]) >= p * np.maximum(a.size[:, None], b.size[None, :])) & (u > 0)
    if within:
        ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    ra = np.array([forest.find(c) for c in a.comps])
    rb = np.array([forest.find(c) for c in b.comps])
    ok &= ra[:, None] != rb[None, :]
    ok &= ~_met(a, b)
    i, j = np.nonzero(ok)
    if not len(i):
        return []
    apart = np.concatenate([np.abs(a.spread[i[s : s + 65536]] - b.spread[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)]) + a.rest[i] + b.rest[j]
    keep = apart <= total[i, j] - 2 * need[i, j]
    i, j = i[keep], j[keep]
    links = []
    for s in range(0, len(i), 30_000):
        x, y = i[s : s + 30_000], j[s : s + 30_000]
        live = np.array([forest.find(a.comps[m]) != forest.find(b.comps[n]) for m, n in zip(x, y)], bool) if s else np.ones(len(x), bool)
        x, y = x[live], y[live]
        if not len(x):
            continue
        good = overlaps(a, b, x, y) >= need[x, y]
        for m, n in zip(x[good], y[good]):
            if forest.join(a.comps[m], b.comps[n]):
                links.append((a.nodes[m], b.nodes[n]))
    return links


def _decide_few(a: Items, b: Items, forest: Forest, p: int, q: int, within: bool) -> list[tuple[int, int]]:
    """The same for a few items of one block, pair by pair: length, then the overlap itself, then a common key."""
    links = []
    na, nb = a.size.tolist(), b.size.tolist()
    for i, n in enumerate(na):
        for j in range(i + 1 if within else 0, len(nb)):
            m = nb[j]
            if q * min(m, n) < p * max(m, n) or any(x[i] == y[j] >= 0 for x, y in zip(a.met, b.met)) or forest.find(a.comps[i]) == forest.find(b.comps[j]):
                continue
            # as among many: only pairs that share a key
            if (p + q) * _common(a.elements[i], b.elements[j]) >= p * (m + n) and not set(a.keys[i].tolist()).isdisjoint(b.keys[j].tolist()):
                forest.join(a.comps[i], b.comps[j])
                links.append((a.nodes[i], b.nodes[j]))
    return links


class _Group:
    """Rows of one block: members, then visitors; decided members stay while more visitors come."""

    def __init__(self, inner: bool):
        self.inner, self.forest = inner, Forest()
        self.members: list[tuple] = []
        self.visitors: list[tuple] = []
        self.block: Items | None = None


def _kernel(decode: Decode, share: tuple[int, int]):
    """Over rows (block, role, inner, node, comp, b0, b1, payload) sorted by block and role: links within members, then of visitors.

    Many small blocks are decoded together; visitors of a large one are settled as they come.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        open_: list[_Group] = []
        held, links = 0, []

        def settle() -> None:
            nonlocal held
            fresh = [x for g in open_ for x in (*(g.members if g.block is None else ()), *g.visitors)]
            decoded = iter(decode([x[4] for x in fresh])) if fresh else iter(())

            def items(found: list[tuple]) -> Items:
                return Items([x[0] for x in found], [next(decoded) for _ in found], [x[1] for x in found], [[x[k] for x in found] for k in (2, 3)])

            for g in open_:
                if g.block is None:
                    g.block = items(g.members)
                    g.members = []
                    if g.inner and len(g.block) > 1:
                        links.extend(decide(g.block, g.block, g.forest, share, True))
                if g.visitors:
                    guests = items(g.visitors)
                    g.visitors = []
                    links.extend(decide(g.block, guests, g.forest, share, False))
            held = 0

        for batch in batches:
            for b, role, inner, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != now:
                    if held >= HELD:
                        settle()
                    if not held:
                        open_.clear()
                    open_.append(_Group(inner))
                    now = b
                g = open_[-1]
                if role == 0:
                    g.members.append(row)
                else:
                    g.visitors.append(row)
                    if len(g.visitors) >= BLOCK:
                        settle()
                        del open_[:-1]
                        continue
                held += 1
            if len(links) > 1000:
                yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
                links.clear()
        settle()
        if links:
            yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node with a link.

    Every round hooks each remaining root to its smallest neighbouring root, shortens the chains by pointer jumping and
    contracts the links; rounds go on until no link joins two roots.
    """
    links = materialise(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels: DataFrame | None = None
    while True:
        up = both(links).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        for _ in range(2):
            up = up.alias("x").join(up.select(F.col("node").alias("n2"), F.col("up").alias("u2")), F.col("up") == F.col("n2"), "left").select("node", F.coalesce("u2", "up").alias("up"))
        up = materialise(up, "roots")
        if labels is None:
            new = up.select("node", F.col("up").alias("comp"))
        else:
            new = labels.join(up.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        new = materialise(new, "labels")
        left, right = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        rest = links.join(left, "a").join(right, "b").filter("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        rest = materialise(rest, "links")
        for old in (links, up, labels):
            if old is not None:
                discard(old)
        labels, links = new, rest
        if links.isEmpty():
            return labels


def link(postings: DataFrame, items: DataFrame, decode: Decode, share: tuple[int, int]) -> DataFrame:
    """Components (node, comp) over all pairs of items that share a key and whose sets' Jaccard index is share[0]/share[1] or more.

    postings: key, node, k: the number of nodes of the key, above 1; distinct. items: node, payload, one per node, and perhaps
    hk, hkey: its key with most nodes, the largest of equal ones.
    """
    if postings.isEmpty():
        return postings.select("node", F.col("node").alias("comp"))
    kernel, spark = _kernel(decode, share), postings.sparkSession
    if "hkey" not in items.columns:
        home = postings.groupBy("node").agg(F.max(F.struct("k", "key")).alias("h")).select("node", F.col("h.k").alias("hk"), F.col("h.key").alias("hkey"))
        items = items.join(home.hint("shuffle_hash"), "node")
    dealt = lambda salt: F.xxhash64("hkey", F.lit(salt), F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("hk") / BLOCK).cast("long")))
    cut = F.col("hk") > BLOCK
    # b0 and b1: the blocks of the two dealings of a large group; a pair that met in one is not decided again
    homed = items.select("node", "hk", "hkey", dealt(0).alias("b0"), F.when(cut, dealt(1)).otherwise(dealt(0)).alias("b1"), "payload")
    homed = materialise(homed, "items")
    bulk = homed.agg(F.sum(F.octet_length("payload") + 100)).collect()[0][0]
    once = homed.select(F.col("b0").alias("block"), F.lit(0).alias("role"), F.lit(True).alias("inner"), "node", F.col("node").alias("comp"), F.lit(None).cast("long").alias("b0"), F.lit(None).cast("long").alias("b1"), "payload")
    twice = homed.filter(cut).select(F.col("b1").alias("block"), F.lit(0).alias("role"), F.lit(True).alias("inner"), "node", F.col("node").alias("comp"), "b0", F.lit(None).cast("long").alias("b1"), "payload")
    links = materialise(_decided(once.unionByName(twice), parts_for(spark, bulk * 1.5, PART_BYTES), kernel), "near", free=True)
    found = materialise(components(links), "near-components")
    big = found.groupBy("comp").count().filter(F.col("count") >= LARGE).select("comp", F.col("comp").alias("big"))
    # keys whose nodes are not all in one component yet, and the nodes that have them, in blocks of one large component or of none
    named = found.join(big, "comp", "left").select("node", "comp", F.coalesce("big", F.lit(-1)).alias("big"))
    spots = postings.select("key", "node").join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_keys = spots.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    spots = materialise(spots.join(open_keys, "key").select("key", "node", "comp", F.coalesce("big", F.lit(-1)).alias("big")), "open")
    if spots.isEmpty():
        return found
    active = spots.select("node", "comp", "big").distinct()
    block = F.when(cut, F.xxhash64("hkey", "big", F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("hk") / BLOCK).cast("long")))).otherwise(F.col("b0"))
    members = homed.join(active, "node").select("node", "comp", F.when(cut, F.col("big")).otherwise(F.lit(-1)).alias("big"), cut.alias("cut"), block.alias("block"), "b0", "b1", "payload")
    members = materialise(members, "members")
    amounts = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    blocks = spots.select("key", "node").join(members.select("node", "big", "block"), "node").select("key", "block", "big").distinct()
    blocks = blocks.join(amounts, "block").select("key", "big", F.struct("n", "block").alias("at"))
    hosts = blocks.select("key", F.col("at").alias("host"), F.col("big").alias("tobig"))
    # of two blocks that share an open key the smaller one's items visit the larger
    visits = blocks.join(hosts, "key").filter("at < host and (big != tobig or big = -1)").select(F.col("at.block").alias("block"), F.col("host.block").alias("to")).distinct()
    visits = materialise(visits, "visits")
    going = members.select("node", "block").join(visits, "block").select("node", "to")
    # a block with many visitors stands in several copies, each for a share of them
    crowds = going.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("copies"))
    placed = going.join(crowds, "to").select("node", F.xxhash64("to", F.pmod(F.xxhash64("node", F.lit(3)), F.col("copies"))).alias("to"))
    inner = F.col("cut") & (F.col("big") == -1)  # of other blocks, the pairs within were decided or are in one component
    stay = members.join(crowds, F.col("block") == F.col("to"), "left").filter(inner | F.col("to").isNotNull())
    stay = stay.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    stay = stay.select(F.xxhash64("block", "copy").alias("block"), F.lit(0).alias("role"), (inner & (F.col("copy") == 0)).alias("inner"), "node", "comp", "b0", "b1", "payload")
    guests = placed.join(members.select("node", "comp", "b0", "b1", "payload"), "node").select(F.col("to").alias("block"), F.lit(1).alias("role"), F.lit(False).alias("inner"), "node", "comp", "b0", "b1", "payload")
    far = materialise(_decided(stay.unionByName(guests), parts_for(spark, bulk * 1.5, PART_BYTES), kernel), "far", free=True)
    return found if far.isEmpty() else components(links.union(far))


def _decided(rows: DataFrame, parts: int, kernel) -> DataFrame:
    return rows.select("block", "role", "inner", "node", "comp", "b0", "b1", "payload").repartition(parts, "block").sortWithinPartitions("block", "role").mapInArrow(trimmed(kernel), "a long, b long")
