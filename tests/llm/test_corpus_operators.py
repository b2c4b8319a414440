"""Line dedup, n-gram join, language model, archives, components and the pipeline against plain code."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrella.llm import elias_fano, line_dedup, linkage, lm_score, ngram_join, queries, warc

W = re.compile(r"[^\x20\x09-\x0D]+")
FIRST, LAST = "\n start", "\n end"  # no words of any text
LOWER = {i: i + 32 for i in range(65, 91)}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def words(t):
    return W.findall((t or "").translate(LOWER))


@pytest.mark.parametrize(("n", "share"), [(3, (90, 100)), (5, (80, 100))])
def test_ngram_join(docs, rows, empty, n, share):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append(frozenset({tuple(w)} if 0 < len(w) < n else zip(*(w[k:] for k in range(n)))))
    u = Union()
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and share[1] * i >= share[0] * len(sets[a] | sets[b]):
                u.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = u.find(k)
            least[r] = min(least.get(r, i), i)
    want = Counter((i, len(sets[k]), least.get(u.find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))
    assert Counter(tuple(r) for r in ngram_join.jaccard_components(docs, n, share).collect()) == want
    assert ngram_join.jaccard_components(empty, n, share).count() == 0


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and None in ids and len(ids) < docs.count()


def test_keep_one_row_of_each_component(spark):
    """Equal ids and null ids are told apart by row; equal rows leave one."""
    rng = random.Random(15)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (2, a + " more"), (None, a), (None, b), (None, b), (None, b + " more"), (3, c), (5, c + " more"), (5, d), (6, e), (None, e), (None, None), (None, None), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.keep_one(df).collect())
    nameless = Counter({k: v for k, v in got.items() if k[1] in (b, b + " more")})
    assert got - nameless == Counter([(1, a), (3, c), (5, d), (6, e), (None, None), (None, None), (7, " ")])
    assert sum(nameless.values()) == 1


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 900 + i) for i in range(40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    u = Union()
    for a, b in links:
        if a != b:
            u.join(a, b)
    got = {r["node"]: r["comp"] for r in linkage.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: u.find(x) for p in links if p[0] != p[1] for x in p}
    assert linkage.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_group_of_near_copies(spark):
    """Over a block's size, at the edge of similarity, so that pairs across blocks matter."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    u = Union()
    for a in range(700):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i):
                u.join(a, b)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, 3, (90, 100)).collect()}
    assert got == {i: u.find(i) for i in range(700)}


def brute_drops(rows):
    seen = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            w = line.lower().split()
            if len(w) >= line_dedup.MIN_WORDS:
                seen[b" ".join(w).decode()].append((i, k))
    lines = list(seen)
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    u = Union()
    for a in range(len(lines)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                u.join(a, b)
    groups = defaultdict(list)
    for a, x in enumerate(lines):
        groups[u.find(a)] += seen[x]
    drops = defaultdict(set)
    for g in groups.values():
        for d, k in g:
            if (d, k) != min(g):
                drops[d].add(k)
    return drops


def test_line_dedup(docs, rows, empty):
    want = brute_drops([(-(1 << 63) if i is None else i, t) for i, t in rows])
    got = line_dedup.line_report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert set(r["dropped"]) == want[-(1 << 63) if r["doc_id"] is None else r["doc_id"]] and r["n_dropped"] == len(r["dropped"])
    kept = line_dedup.dedup(docs)
    assert kept.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for i, t in rows:
        if i is not None and t is not None:
            assert texts[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.dedup(empty).count() == 0


def test_bands_have_high_recall():
    rng = random.Random(6)
    hits = total = 0
    for _ in range(150):
        a = "".join(rng.choice("abcdefghij ") for _ in range(200))
        w = list(a)
        for _ in range(3):
            w[rng.randrange(200)] = rng.choice("klm")
        b = "".join(w)
        (x, y), bands = line_dedup.signatures([a.encode(), b.encode()])
        i = len(np.intersect1d(x, y))
        if 100 * i >= 80 * (len(x) + len(y) - i):
            total += 1
            hits += bool((bands[0] == bands[1]).any())
    assert total > 50 and hits / total > 0.97


def test_line_pairs_are_found_at_any_length(spark):
    """Pairs of similarity 0.8 exactly, of 18 to 90 shingles, each alone with its bands."""
    rng = random.Random(12)
    first, second = [], []
    for n in (18, 27, 45, 90):
        for _ in range(150):
            a = [rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n + 4)]
            a[3::4] = " " * len(a[3::4])
            a[-1] = "y"
            b = a[: -(n // 9)] + [rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n // 9 - 1)] + ["z"]
            sets = [{x[i : i + 5] for i in range(n)} for x in ("".join(a).lower(), "".join(b).lower())]
            if len(sets[0]) == len(sets[1]) == n and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]):
                first.append("".join(a))
                second.append("".join(b))
    got = line_dedup.dropped_lines(spark.createDataFrame([(1, "\n".join(first)), (2, "\n".join(second))], "doc_id long, text string"))
    found = {r["doc"]: set(r["dropped"]) for r in got.collect()}
    assert len(first) > 500 and set(found) == {2} and len(found[2]) >= 0.99 * len(first)


def test_short_lines_and_lines_without_blanks(spark):
    """Repeats of few words, of one sign, and of scripts without blanks go as well; near copies too; blank lines stay."""
    chinese = "他们在河边的小屋里住了很多年后来搬到了城里的一条安静的街道上"
    a = "\n".join(["All rights reserved.", "", "x", chinese, "https://example.org/a/long/path/without/any/blank"])
    b = "\n".join(["all  rights reserved.", "", "x", chinese[:-1] + "中", "own words here", "https://example.org/a/long/path/without/any/blank", " "])
    got = line_dedup.line_report(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dropped"] for r in got} == {1: [], 2: [0, 2, 3, 5]}


def test_lines_go_row_by_row(spark):
    """Rows without an id, and rows of one id, lose only lines of their own that others keep."""
    a, b, c = ("this is the first common line of all", "here stands quite another sentence instead", "nothing like it was ever written before")
    rows = [(1, f"{a}\n{b}"), (None, f"{c}\nunique words of the first nameless row\n{a}"), (None, f"{b}\n{c}\nclean text that only this row has got"), (None, f"twice the same\n\n{a}"), (None, f"twice the same\n\n{a}")]
    rows += [(7, f"{b}\nseven has a line like no other"), (7, "seven begins with its own words\nand ends with different ones too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in line_dedup.dedup(df).collect()]
    assert len(out) == len(rows)
    assert Counter(x for _, t in out for x in t.split("\n") if x) == Counter({x for _, t in rows for x in t.split("\n") if x})
    assert Counter((r["doc_id"], r["n_lines"]) for r in line_dedup.line_report(df).collect()) == Counter((i, t.count("\n") + 1) for i, t in rows)


def test_language_model(docs, rows, empty):
    tok = [[*words(t), LAST] for _, t in rows]
    held = [zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    uni, pair, after, kinds = Counter(), Counter(), Counter(), Counter()
    for t, h in zip(tok, held):
        if not h:
            uni.update(t)
            pair.update(zip([FIRST, *t], t))
    for (u, _), c in pair.items():
        after[u] += c
        kinds[u] += 1
    n, v = sum(uni.values()), len(uni)

    def logp(u, w):
        low = (uni[w] + 1) / (n + v + 1)
        return math.log10(low if not after[u] else max(pair[u, w] - 0.75, 0) / after[u] + 0.75 * kinds[u] / after[u] * low)

    want = sorted((-1 if i is None else i, h, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), sum(logp(u, w) for u, w in zip([FIRST, *t], t))) for (i, _), t, h in zip(rows, tok, held))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in lm_score.lm_scores(docs).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6], abs=1e-3 * w[2])
    assert lm_score.lm_scores(empty).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 10), (800, 1 << 20), (3000, 300), (5000, 1 << 57)])
def test_elias_fano(n, top, tmp_path):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    e = elias_fano.EliasFano.build(v)
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([rng.integers(0, top + 5, 500, dtype=np.uint64), v[:300]])
    place, _ = e.successor(q)
    assert (place == np.searchsorted(v, q)).all() and (e.find(q)[1] == np.isin(q, v)).all()


def test_trie_in_a_file(tmp_path):
    c, w = np.array([3, 3, 9], np.uint64), np.array([1, 5, 2], np.uint64)
    t = elias_fano.Trie.build(c, w, np.array([2.0, 1.0, 4.0]), np.full(3, 0.1), 0.75).mapped(str(tmp_path / "trie"))
    assert t.range_of(3) == (0, 2) and t.range_of(4) == (0, 0)
    got = 10 ** (-t.costs(np.array([3, 3, 9, 9], np.uint64), np.array([1, 2, 2, 7], np.uint64), np.full(4, 4096, np.uint16)) / 4096)
    assert got == pytest.approx([1.25 / 3 + 0.5 * 0.1, 0.5 * 0.1, 3.25 / 4 + 0.1875 * 0.1, 0.1875 * 0.1], rel=1e-3)


def test_archives(spark, tmp_path):
    long = "<p>" + "same words " * 30
    data = [(5, "http://www.Example.org/b", long), (2, "https://example.org:443/a", long), (9, None, None), (7, "http://a b/\n", "é" * 60), (8, "x.org", "tiny"), (3, "x.org", "tiny"), (2, "https://example.org:443/a", long), (None, "n.org", long), (4, "q", "é" * 60)]
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, digest int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.capture_histories(pages).collect())
    want = Counter()
    for i, _, h in data:
        b = (h or "").encode()
        group = [j for j, _, k in data if k == h and j is not None] if len(b) >= 100 else []
        first = min(group) if group else i
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert got == want
    h = warc.capture_histories(pages).orderBy("position").collect()
    keys = [(r["urlkey"], r["stamp"], r["page_id"] is None, r["page_id"] or 0) for r in h]
    assert keys == sorted(keys)
    archives = warc.write_archives(pages).cache()
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(archives, payloads=True).collect() if r["payload"] is not None}[2] == long.encode()
    assert warc.export(archives, f"file://{tmp_path}") == archives.count()
    assert all(gzip.open(p).read(8) == b"WARC/1.1" for p in tmp_path.glob("*.warc.gz"))
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_histories_over_ranges(spark):
    """One url in most captures: its history goes on over several ranges."""
    rows = [(i, "http://www.a.org/x" if i % 4 else f"https://b.org:443/{i % 7}", "x" * (i % 300)) for i in range(900)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    size, warc.CAPTURE_BYTES = warc.CAPTURE_BYTES, 1 << 20
    try:
        merged = warc.merge_index(archives)
        got = merged.orderBy("position").collect()
    finally:
        warc.CAPTURE_BYTES = size
    assert len({r["position"] >> 40 for r in got}) > 10
    assert [(r["urlkey"], r["stamp"], r["page_id"]) for r in got] == sorted((r["urlkey"], r["stamp"], r["page_id"]) for r in got)
    seen = Counter()
    for r in got:
        seen[r["urlkey"]] += 1
        assert r["capture"] == seen[r["urlkey"]]


def test_members_of_long_archives():
    data = [bytes([i]) * (i * 997) for i in range(60)] + [b"end"]
    assert [c for _, _, c in warc.members(b"".join(gzip.compress(x) for x in data))] == data


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.org:80/a/b?c") == "org,example)/a/b?c" and warc.url_key(None) == "" and warc.url_key("https://x.y") == "y,x)"


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    now, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d).cache()
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[1] and counts[3] > 0.5 * docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, d)
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0")
    assert now.join(labels, "doc_id").count() <= 0.2 * labels.count()


def test_pipeline_goes_by_small_batches(spark):
    import corpus_pipeline
    from terrella.session import ship

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat(id, ' some words '), 130)").alias("text"))
    most = lambda: docs.mapInArrow(sizes, "size long, n long").agg(F.max("size"), F.sum("n")).first()
    for stage in (corpus_pipeline.rules, corpus_pipeline.near_duplicates):
        stage(spark, docs.limit(50), "/root/testdata/sf0.001")
        size, n = most()
        assert size <= 1 << 20 and n == 3000
    ship(spark)  # other queries have theirs
    assert most()[0] > 2 << 20


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {f"op{i}" for i in range(1, 11)} <= {q.split("_")[0] for q in e.queries()} and "pipeline" in e.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("more", [0, 4, 60])
def test_links_need_a_common_key_in_blocks_of_any_size(more):
    """Two equal sets without a common key, and two with one, among items unlike all others."""
    from terrella.llm import linkage

    rng = np.random.default_rng(0)
    same = np.sort(rng.integers(0, 1 << 62, 30).astype(np.uint64))
    sets = [same, same, same] + [np.sort(rng.integers(0, 1 << 62, 30).astype(np.uint64)) for _ in range(more)]
    keys = [[1], [2], [2]] + [[10 + i] for i in range(more)]
    decoded = [(np.array(k, np.uint64), np.zeros(1, np.int64), e, 30) for k, e in zip(keys, sets)]
    items = linkage.Items(list(range(len(sets))), decoded, list(range(len(sets))), [[None] * len(sets)])
    assert linkage.decide(items, items, linkage.Forest(), (8, 10), True) == [(1, 2)]


def test_signatures_go_by_small_batches():
    """Whatever lines stand beside it, a line has the signature it has alone, and few lines at a time are in memory as hashes."""
    import tracemalloc

    rng = random.Random(6)
    alphabets = ("abcdefgh ", "aé日😀 b", "x")
    lines = ["".join(rng.choices(rng.choice(alphabets), k=rng.choice((1, 3, 5, 60, 900)))).encode() for _ in range(2500)]
    line_dedup.signatures(lines[:10])
    tracemalloc.start()
    line_dedup.signatures(lines, sets=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    elements, bands = line_dedup.signatures(lines)
    assert len(elements) == len(bands) == len(lines)
    for i in rng.sample(range(len(lines)), 200):
        (own,), band = line_dedup.signatures([lines[i]])
        text = lines[i].decode().ljust(line_dedup.SHINGLE, "\ud800")
        assert (own == elements[i]).all() and (band[0] == bands[i]).all()
        assert len(own) == len({text[j : j + line_dedup.SHINGLE] for j in range(len(text) - line_dedup.SHINGLE + 1)})


def test_distinct_lines_keep_their_first_place(spark):
    """Places and counts of lines stand beside the texts, and are read without them."""
    from terrella.llm.blocks import unpack

    rng = random.Random(8)
    texts = ["\n".join(rng.choice(["one two", " One  TWO ", "three\tfour", "Three Four", "", " ", "日本 é", "\r", "x%d" % rng.randrange(30)]) for _ in range(rng.randrange(9))) for _ in range(80)]
    rows = [(rng.randrange(20), rng.randrange(5), t) for t in texts] + [(7, 7, None)]
    want: dict[bytes, list] = {}
    for doc, row, text in rows:
        for i, raw in enumerate((text or "").encode().split(b"\n")):
            if (key := line_dedup.normal(raw)) is not None:
                want.setdefault(key, []).append((doc, row, i))
    lines = line_dedup.distinct_lines(spark.createDataFrame(rows, "doc long, row long, text string").repartition(3))
    got = {}
    for r in lines.collect():
        node, doc, row, line, count = (x.tolist() for x in unpack(bytes(r["places"])))
        for key, n, *place in zip(line_dedup._texts(*unpack(bytes(r["data"]))), node, doc, row, line, count):
            assert key not in got and n == line_dedup.node_of(key)
            got[key] = tuple(place)
    assert got == {k: (*min(v), len(v)) for k, v in want.items()}
    repeated = {tuple(r) for r in line_dedup.repeated_lines(lines).select("doc", "row", "line").collect()}
    assert repeated == {min(v) for v in want.values() if len(v) > 1}


@pytest.mark.parametrize("pairs", [0, 3, 1024])
def test_bounds_of_many_keys_at_once(pairs, monkeypatch):
    """Keys of few items are decided together, by themselves only where their pairs are many."""
    monkeypatch.setattr(linkage, "PAIRS", pairs)
    alone = []
    ix = np.ix_
    monkeypatch.setattr(linkage.np, "ix_", lambda *a: alone.append(a) or ix(*a))
    r = np.random.default_rng(pairs)

    def items(n: int) -> linkage.Items:
        keys = [np.unique(r.integers(0, 40, 6)).astype(np.uint64) for _ in range(n)]
        return linkage.Items(list(range(n)), [(k, r.integers(0, 5, len(k)), k, len(k) + 5) for k in keys], list(range(n)), [[None] * n] * 2)

    a, b = items(25), items(30)
    want = np.zeros((len(a), len(b)), np.int64)
    for i in range(len(a)):
        for j in range(len(b)):
            for k, p in zip(a.keys[i], a.left[i]):
                for m, q in zip(b.keys[j], b.left[j]):
                    if k == m:
                        want[i, j] = max(want[i, j], 1 + min(p, q))
    assert (linkage.bounds(a, b) == want).all()
    assert len(alone) == 0 if pairs == 1024 else alone
    assert (linkage.bounds(a, items(0)) == 0).all()
