"""Quality rules, classifier, byte-level BPE, packing, token counts and fingerprints against plain code."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrella.llm import docstats, longest_match, merkle, packing, quality_classifier, quality_rules, textkit, tokens
from terrella.llm.docstats import Counts
from tests.llm.conftest import HOSTILE

W = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, VOCAB = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def base(t):
    w, seen, dup = W.findall(t), set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def test_counts_equal_plain_code():
    rng = random.Random(1)
    texts = HOSTILE + ["".join(rng.choice(["a", "b", " ", "\n", "\t", "é", "#", "|", "c "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for limit in (64, 1 << 20):
        got = []
        for s in textkit.slices(pa.array(texts), limit=limit):
            c = docstats.Counts(s)
            got += list(zip(*(x.tolist() for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words))))
        assert got == [base(t or "") for t in texts]


def test_quality_rules(docs, rows, empty):
    got = quality_rules.quality_rules(docs).collect()
    want = Counter((i, *base(t or "")) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.keep_documents(empty).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = quality_rules.Field(rng.normal(size=3), rng.normal(size=2), rng.normal(size=(2, 2)))
    doc = np.repeat([0, 1, 2, 5], [1, 6, 3, 7])
    x = rng.normal(size=(len(doc), 3))
    got = quality_rules.viterbi(field, x, doc)
    for d in np.unique(doc):
        e = x[doc == d] @ field.emission
        n = len(e)
        score = lambda p: field.first[p[0]] + sum(e[t] * p[t] for t in range(n)) + sum(field.step[p[t - 1], p[t]] for t in range(1, n))
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert score(got[doc == d].tolist()) == pytest.approx(max(map(score, paths)))


def test_training_separates_lines():
    rng = np.random.default_rng(2)
    doc = np.repeat(np.arange(80), 5)
    y = np.repeat(rng.integers(0, 2, 80), 5)
    x = np.stack([np.ones(400), np.clip(y + rng.normal(0, 0.2, 400), 0, 1)], 1)
    field = quality_rules.train(x, doc, y)
    assert (quality_rules.viterbi(field, x, doc) == y).mean() > 0.98


def test_states_of_lines_are_latent():
    """Good documents with a planted block of boilerplate, bad ones with a few good lines: labels are of documents alone."""
    rng = np.random.default_rng(4)
    bad = np.repeat([0, 1], 60)
    truth = np.concatenate([np.r_[np.zeros(6), np.ones(3), np.zeros(3)] if not b and i % 2 else np.full(12, b) if i % 3 else np.r_[np.full(9, b), np.zeros(3)] for i, b in enumerate(bad)])
    doc = np.repeat(np.arange(120), 12)
    x = np.stack([np.ones(len(doc)), np.clip(truth * 0.8 + rng.uniform(0, 0.2, len(doc)), 0, 1)], 1)
    field = quality_rules.learn(x, np.full(len(doc), 9.0), doc, bad)
    got = quality_rules.viterbi(field, x, doc)
    assert (got == truth).mean() > 0.97
    share = np.bincount(doc, got == 0) / 12
    assert ((share > 0) & (share < 1)).sum() >= 30


def test_states_keep_to_the_label():
    doc, bad = np.repeat([0, 1], 4), np.array([0, 1])
    words, score = np.array([10.0, 1, 1, 9, 5, 5, 5, 5]), np.array([3.0, 1, 2, 4, -1, -2, -3, -4])
    got = quality_rules.constrained(np.array([1, 1, 1, 1, 0, 0, 0, 0], np.int8), score, words, doc, bad)
    assert got.tolist() == [0, 0, 0, 1, 1, 1, 0, 0]  # by least evidence, until half of the words agree


def test_expectations_are_sums_over_paths():
    rng = np.random.default_rng(1)
    field = quality_rules.Field(rng.normal(size=1), rng.normal(size=2), rng.normal(size=(2, 2)))
    doc = np.repeat([0, 1, 2], [1, 5, 3])
    e = rng.normal(size=len(doc))
    one, first, moves = quality_rules.expectations(field, e, doc)
    want_one, want_first, want_moves = np.zeros(len(doc)), np.zeros(2), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = [[k >> i & 1 for i in range(len(at))] for k in range(2 ** len(at))]
        w = np.exp([field.first[p[0]] + sum(e[i] * s for i, s in zip(at, p)) + sum(field.step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            want_one[at] += x * np.array(p)
            want_first[p[0]] += x
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += x
    assert np.allclose(one, want_one) and np.allclose(first, want_first) and np.allclose(moves, want_moves)


def test_expected_shares_keep_to_the_label():
    """Only documents that contradict their label are tilted, and no further than half of their words."""
    doc, bad = np.repeat([0, 1, 2], 4), np.array([0, 1, 0])
    words = np.array([10.0, 1, 1, 9, 5, 5, 5, 5, 3, 3, 3, 3])
    evidence = np.array([3.0, 2, 2, 4, -1, -2, -3, -4, -2, -2, 1, -2])
    field = quality_rules.Field(np.zeros(1), np.zeros(2), np.array([[0.5, -0.5], [-0.5, 0.5]]))
    one, _, _ = quality_rules.tilted(field, evidence, words, doc, bad)
    share = np.bincount(doc, words * one) / np.bincount(doc, words)
    assert share[:2] == pytest.approx([0.5, 0.5], abs=1e-2)
    assert np.allclose(one[8:], quality_rules.expectations(field, evidence, doc)[0][8:])


def test_kept_equals_plain_code(docs, rows):
    field = quality_rules.DEFAULT
    for r in quality_rules.quality_rules(docs).collect():
        assert r["kept"] == (not r["base_failed"] and r["content_share"] >= quality_rules.SHARE)
    text = "word words more words here to read on.\n" * 3 + "| | | # # $ $ | |\n" * 2
    s = next(textkit.slices(pa.array([text])))
    x, doc, words = Counts(s).line_features()
    n = len(doc)
    e = x @ field.emission
    score = lambda p: field.first[p[0]] + sum(e[t] * p[t] for t in range(n)) + sum(field.step[p[t - 1], p[t]] for t in range(1, n))
    best = max(([k >> i & 1 for i in range(n)] for k in range(2**n)), key=score)
    assert quality_rules.judge(Counts(s), field, 0.5)["content_share"][0] == sum(w for w, b in zip(words.tolist(), best) if not b) / words.sum()


def test_scores_equal_plain_ridge(spark):
    """Features, normal equations, cross-fitted calibration: against one matrix in memory."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    stats = quality_classifier.statistics(docs)
    model = quality_classifier.fit(stats, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    table = [(r["doc_id"], np.frombuffer(r["stats"], np.float64)) for r in stats.collect()]
    train = [(i, x, known[i]) for i, x in table if i in known and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([t[1] for t in train]), np.array([t[2] for t in train], float)
    fold = np.array([zlib.crc32(str(t[0]).encode()) // 5 % quality_classifier.CROSS for t in train])
    z = np.sqrt(2 / quality_classifier.FEATURES) * np.cos(np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -4, 4) @ model.waves + model.phase)
    z = np.concatenate([z, np.ones((len(z), 1))], 1)
    penalty = np.diag([quality_classifier.RIDGE] * quality_classifier.FEATURES + [1e-9])
    solve = lambda m: np.linalg.solve(z[m].T @ z[m] + penalty, z[m].T @ y[m])
    assert np.allclose(model.weights, solve(np.full(len(y), True)), atol=1e-5)
    seen = np.array([z[i] @ solve(fold != fold[i]) for i in range(len(y))])
    low, high = seen[y == 0], seen[y == 1]
    assert np.all(np.diff(model.values) >= 0) and model.knots[0] >= seen.min() - 1e-6 and model.knots[-1] <= seen.max() + 1e-6 and low.mean() < high.mean()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    s = quality_classifier.quality_classifier(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (s.predicted == s.quality).mean() > 0.95 and s.score.between(0, 1).all()
    r = quality_rules.quality_rules(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert (r.kept == (r.quality == 1)).mean() > 0.95


def test_classifier_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows if i is not None] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) or r["doc_id"] is None for r in got)
    none = quality_classifier.quality_classifier(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality_classifier.quality_classifier(empty, labels).count() == 0


def test_isotonic_is_monotone():
    k, v = quality_classifier.isotonic(np.arange(6.0), np.array([0, 3, 1, 5, 4, 9.0]), np.full(6, 10.0))
    assert (np.diff(v) >= 0).all() and len(k) == len(v)


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_equals_rank_file(docs, rows, empty, oracle):
    want = Counter()
    for i, t in rows:
        ids = oracle.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in tokens.bpe_digests(docs, RANKS, P.PATTERN).collect()) == want
    full = tokens.bpe_encode(docs, RANKS, P.PATTERN).collect()
    assert Counter(r["decoded"] for r in full) == Counter(t or "" for _, t in rows)
    assert tokens.bpe_digests(empty, RANKS, P.PATTERN).count() == 0


def test_byte_bpe_on_random_unicode(oracle):
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x2028, 0x3000, 0x200B, 0x301, 0x4E00, 0x1F600]] + ["'s", "'LL", "  ", "<|endoftext|>"] * 9
    bpe = tokens.byte_bpe(RANKS, P.PATTERN)
    for _ in range(800):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        assert bpe.encode(t) == oracle.encode_ordinary(t) and bpe.decode(bpe.encode(t)) == t.encode()


def pieces_by_document(rows_):
    out = defaultdict(list)
    for r in rows_:
        out[r["doc_id"]].append(r)
    return out


def test_packing(docs, rows, empty):
    tk = Tokenizer.from_file(VOCAB)
    tk.encode_special_tokens = True
    got = packing.pack(docs, VOCAB).collect()
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for runs in fill.values():
        at = 0
        for o, n in sorted(runs):
            assert o == at
            at += n
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    by = pieces_by_document(got)
    for i, texts in _by_id(rows).items():
        want = Counter()
        for t in texts:
            want[len(tk.encode(t or "", add_special_tokens=False).ids) + 1] += 1
        assert sum(r["length"] for r in by[i]) == sum(n * k for n, k in want.items())
        if len(texts) == 1:
            ids = [*tk.encode(texts[0] or "", add_special_tokens=False).ids, 2]
            at = 0
            for r in sorted(by[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
                at += r["length"]
            assert at == len(ids)
    assert packing.pack(empty, VOCAB).count() == 0


def _by_id(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[i].append(t)
    return out


def test_equal_texts_have_equal_vectors():
    texts = ["one text to place", "", "ab", None, "another, much longer text " * 9]
    alone = [packing.projected(pa.array([t], pa.string()))[0] for t in texts]
    together = packing.projected(pa.array([*texts, *reversed(texts)], pa.string()))
    assert np.array_equal(together, np.array(alone + alone[::-1]))


def test_neighbours_in_sequences_are_near(spark):
    """Texts of four kinds: most neighbours along the sequences are of one kind."""
    kinds = ["alpha beta gamma delta ", "12 345 6789 0 ", "ÄÖÜ ßéè ", "x+y=z; {a: b} "]
    rows = [(i, kinds[i % 4] * (20 + i % 7)) for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), VOCAB).orderBy("sequence_id", "offset").collect()
    ids = [r["doc_id"] % 4 for r in got if r["start"] == 0]
    assert sum(a == b for a, b in zip(ids, ids[1:])) > 0.8 * len(ids)


def test_hilbert_curve_is_continuous():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = packing.hilbert(g, 3)
    assert sorted(k.tolist()) == list(range(512)) and np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1).max() == 1


def test_longest_match(docs, rows, empty):
    vocabulary = {tuple(p) for p in longest_match.read_pieces(VOCAB)}

    def count(word: bytes) -> int:
        s = list(word)
        s[-1] += 256
        i = n = 0
        while i < len(s):
            j = next(j for j in range(min(len(s), i + 40), i, -1) if tuple(s[i:j]) in vocabulary or j == i + 1)
            i, n = j, n + 1
        return n

    lower = {i: i + 32 for i in range(65, 91)}
    want = Counter()
    for i, t in rows:
        w = W.findall((t or "").translate(lower))
        want[(i, len(w), sum(count(x.encode()) for x in w))] += 1
    assert Counter(tuple(r) for r in longest_match.token_counts(docs, VOCAB).collect()) == want
    assert longest_match.token_counts(empty, VOCAB).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    order = sorted(((-(1 << 63) if i is None else i), t or "") for i, t in rows)
    want = Counter()
    for k, (i, t) in enumerate(order):
        o = order[(k + 1) % len(order)][1]
        e = merkle.edited(t, o)
        a, b, c = (merkle.Tree(x).fingerprint() for x in (t, e, o))
        want[(None if i == -(1 << 63) else i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c))] += 1
    assert Counter(tuple(r) for r in merkle.neighbour_fingerprints(docs).collect()) == want
    assert merkle.neighbour_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "only one.\nhere")], "doc_id long, text string")
    r = merkle.neighbour_fingerprints(one).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1
    assert merkle.fingerprints(docs).count() == len(rows)


def test_tree_locates_edits():
    lines = [f"line number {i} has its own words" for i in range(40)]
    a = merkle.Tree("\n".join(lines)).fingerprint()
    lines[20] = "something else entirely"
    b = merkle.Tree("\n".join(lines)).fingerprint()
    assert 0.85 < merkle.likeness(a, b) < 1 and 1 <= len(merkle.differing(a, b)) <= 2 and merkle.differing(a, a) == []
    assert merkle.likeness(merkle.Tree("").fingerprint(), merkle.Tree("").fingerprint()) == 1
