"""Huffman-coded token files: ids against the library, code lengths against plain package-merge, whole round trips."""

import heapq
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrella.llm import token_files as T
from terrella.llm.common import table_path

PATH = P.path("byte_bpe_50k.json")


@lru_cache
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def library():
    return tokenizer()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x00\x85\xa0 　ab'st.,!Aé0я漢😀"), st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=25), max_size=4))
def test_ids_of_any_text(texts):
    t = tokenizer()
    got = T.byte_ids(PATH).encode_column(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_of_texts(rows, library):
    texts = [t or "" for _, t in rows] + ["don't we'll I'M", "a  b   c ", "\n\na\n\n\nb\n\n", "x\n y\n  z\t\n", "<|endoftext|> x<|endoftext|>", "word, 'word' (word) w0rd̀", "ÀÉ Ж́ 12,3"]
    t = T.ByteIds(PATH)
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, "<u2").tolist() for x in t.encode_column(pa.array(texts))] == [ids_of(library, x) for x in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 10**9)), min_size=1, max_size=90), st.integers(1, 12))
def test_lengths_are_best(counts, limit):
    counts = np.array(counts)
    n = int((counts > 0).sum())
    lengths = T.code_lengths(counts, limit).astype(int)
    assert ((lengths > 0) == (counts > 0)).all()
    if n < 2:
        return
    most = max(limit, (n - 1).bit_length())
    assert lengths.max() <= most and sum(2.0 ** -lengths[counts > 0]) == 1
    heap = [int(c) for c in counts[counts > 0]]
    heapq.heapify(heap)
    free = 0
    while len(heap) > 1:
        free += (s := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, s)
    cost = int((lengths * counts).sum())
    assert cost >= free
    # plain package-merge on lists of (weight, symbols)
    single = sorted((int(c), (i,)) for i, c in enumerate(counts) if c)
    level = single
    for _ in range(most - 1):
        level = sorted(single + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])], key=lambda x: x[0])
    assert cost == sum(w for w, _ in level[: 2 * n - 2])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 900), st.integers(0, 10**6), st.integers(9, 32))
def test_code_round_trip(kinds, n, seed, limit):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.int64)
    code = T.Code(T.code_lengths(np.bincount(ids, minlength=kinds) + (rng.random(kinds) < 0.1), limit))
    if code.bits > 24:
        return
    bits, marks = code.encode(ids, 16)
    words = np.frombuffer(bits, ">u4")
    got = code.segments(np.concatenate([words, words]), np.array([0, len(words)]), [marks, marks], [n, n], 16)
    assert all((g == ids).all() and len(g) == n for g in got)
    for a in range(0, n, 37):
        assert (code.span(bits, marks, a, min(50, n - a), 16) == ids[a : a + 50]).all()


def test_canonical():
    """By length, then by id, each code the one before plus one, widened."""
    code = T.Code(np.array([2, 0, 1, 3, 3], np.uint8))
    assert code.codes.tolist() == [0b10, 0, 0b0, 0b110, 0b111]


LONG = "Lorem Straße naïve, word\n" * 60_000


@pytest.fixture(scope="module")
def placed(spark, docs, rows):
    more = [(-5, "smallest id"), (30, "another text of this id"), (10**12, LONG)]
    df = docs.select("doc_id", "text", "part", "data").union(spark.createDataFrame([(i, t, 1.0, b"") for i, t in more], "doc_id long, text string, part double, data binary"))
    return df, rows + more


def test_round_trip(spark, placed, library):
    df, data = placed
    path = table_path(spark, "test")
    T.write_tokens(df, path, PATH)
    got = sorted(T.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == sorted((i is None for i, _ in data), reverse=True)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in data if i is not None)
    place, seen = 0, []
    for r in got:
        assert r.start == place and r.n_tokens * 4 == len(r.ids)
        place += r.n_tokens
        seen.append((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()))
    assert sorted(seen, key=repr) == sorted(((i, ids_of(library, t) + [0]) for i, t in data), key=repr)
    # a prefix code by counts over all documents, no longer than the limit
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codes").first()[0]), np.uint8)
    counts = np.bincount(np.concatenate([x for _, x in seen]), minlength=len(lengths))
    assert (lengths == T.code_lengths(counts)).all()
    bits = spark.read.parquet(f"{path}/blocks").selectExpr("sum(octet_length(bits))", "sum(size(counts) - 1)").first()
    assert bits[0] < place * 1.7


def test_digests(spark, placed, library):
    df, data = placed
    got = T.token_digests(df, PATH).collect()
    crc = lambda t: zlib.crc32(np.array(ids_of(library, t) + [0], "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((i, len(ids_of(library, t)) + 1, crc(t)) for i, t in data), key=repr)


def test_empty(spark, empty):
    assert T.token_digests(empty, PATH).count() == 0


@pytest.mark.parametrize("limit", [3, 60])
def test_chunks_that_come_again_stay(limit, monkeypatch):
    """Ids are right whatever the caches keep, and chunks of one batch only do not push out those that come in all."""
    monkeypatch.setattr(T, "CACHE", limit)
    rng = random.Random(limit)
    common = ["common%d" % i for i in range(20)]
    plain = tokenizer()
    ids = T.ByteIds(PATH)
    for batch in range(12):
        texts = []
        for _ in range(15):
            chunks = [*rng.sample(common, 10), "".join(rng.choices("abcdefgé日", k=rng.choice((4, 9, 60)))), rng.choice(["x.", "y!", "a\tb", "", "1,000"])]
            texts.append(rng.choice([" ", "\n", "  ", " \n"]).join(rng.sample(chunks, len(chunks))))
        texts += ["", "\n\n\n", "\0", "a\n", None]
        got = ids.encode_column(pa.array(texts, pa.string()).slice(batch % 3))
        assert [np.frombuffer(x, ids.kind).tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts[batch % 3 :]]


def test_chunks_of_one_batch_do_not_push_out_others(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 60)
    ids, asked = T.ByteIds(PATH), []
    joined = ids._joined
    monkeypatch.setattr(ids, "_joined", lambda chunks, blank: asked.extend(chunks) or joined(chunks, blank))
    common = " ".join("common%d" % i for i in range(20))
    batches = [common, common, *(" ".join("lone%d-%d" % (b, i) for i in range(50)) for b in range(6)), common]
    for text in batches:
        ids.encode_column(pa.array([text]))
    assert len(asked) == len(set(asked)) == 20 + 6 * 50


def test_counts_stand_with_the_ids(spark):
    """Counts of ids come from one row a range, not from the ids again."""
    rows = [(i, "one two three " * (i % 7)) for i in range(40)] + [(None, None)]
    ids = T._tokenised(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 0)
    t = T.byte_ids(PATH)
    want = np.zeros(t.size, np.int64)
    for r in ids.filter("counts is null").collect():
        want += np.bincount(np.frombuffer(r["ids"], t.kind), minlength=t.size)
    counts = ids.filter("counts is not null").select("counts")
    assert counts.count() == 3 and (T._counted(counts, t.size) == want).all() and want[0] == 41
