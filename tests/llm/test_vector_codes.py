"""Product codes by exponion search against plain code."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrella.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, v binary, code string, first double"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) and the codebooks' text."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], k, v) for i, v, k in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[j * w : (j + 1) * w]) for j in range(parts)] for _, v, _, _ in kept]
    books = [[p[j] for p in cut[:entries]] for j in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(books[j])) for j, x in enumerate(p)] for p in cut]

    for _ in range(rounds):
        found = assign()
        for j in range(parts):
            for i in range(len(books[j])):
                own = [p[j] for p, f in zip(cut, found) if f[j][1] == i]
                if own:
                    books[j][i] = tuple(sum(c) // len(own) for c in zip(*own))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by: dict = {}
    for (_, _, k, _), e in zip(kept, errors):
        by[k] = by.get(k, 0) + e
    text = ",".join(str(x) for b in books for c in b for x in c)
    return [(i, "".join(f"{x:02x}" for _, x in f), e, by[k]) for (i, _, k, _), f, e in zip(kept, found, errors)], text


def data(seed=3, n=700, dim=8):
    """Clusters, ties, repeated rows, and rows that cannot be compared."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(size=dim) * 0.2], None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += [(i, [float(x) for x in rng.integers(-1, 2, dim)], 1) for i in range(n, n + 60)]  # many equal distances
    rows += [rows[5], rows[5], (5, rows[6][1], 0), (None, rows[9][1], 2)]
    bad = [None, [], [1.0] * (dim - 1), [1.0] * (dim * 2), [None] + [0.0] * (dim - 1), [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [-math.inf] * dim]
    return rows + [(10_000 + i, v, 1) for i, v in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, b"", "c", 0.5) for i, v, k in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [20, 700])
def test_codes(spark, n):
    rows = data(n=n)
    want, text = plain(rows)
    got = V.code_errors(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_other_sizes(spark, rounds):
    rows = data(n=120, dim=6)
    want, text = plain(rows, 3, 17, rounds)
    held, books = V.learn_and_encode(frame(spark, rows), 3, 17, rounds)
    got = [(r.vec_id, "".join(f"{x:02x}" for x in np.frombuffer(r.code, "<u2")), r.error) for r in held.collect()]
    assert sorted(got, key=repr) == sorted((w[:3] for w in want), key=repr) and V.codebook_text(books) == text
    back = {r.vec_id: r.vector for r in V.decode(held, books).collect()}
    code = {r.vec_id: np.frombuffer(r.code, "<u2") for r in held.collect()}
    assert all(list(v) == [x / 1024 for j in range(3) for x in books[j][code[i][j]].tolist()] for i, v in back.items())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 3), st.integers(0, 10_000))
def test_search_from_any_start(k, w, spread, seed):
    """Whatever entry a search starts from, it ends at the nearest one of the lowest index; also where products need 64 bits."""
    rng = np.random.default_rng(seed)
    most = [2, 50, 1 << 20, (1 << 27)][spread]
    c, x = rng.integers(-most, most, (k, w)), rng.integers(-most, most, (60, w))
    found, d = V.Neighbours(c).nearest(x, rng.integers(0, k, 60).astype(np.uint16))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in c] for r in x]
    assert d.tolist() == [min(r) for r in exact] and found.tolist() == [r.index(min(r)) for r in exact]


def test_nothing_to_code(spark):
    assert V.code_errors(frame(spark, [])).count() == 0
    got = V.code_errors(frame(spark, [(1, None, 1), (2, [math.nan] * 4, 1)]))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_too_large(spark):
    with pytest.raises(Exception, match="64-bit"):
        V.code_errors(frame(spark, [(1, [1e30] * 4, 1)]))
