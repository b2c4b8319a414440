"""Fill-in-middle by relational units against plain code."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from terrella.llm import infill


def plain(doc_id, text, unit=r"(?s:.)", cut=90, spm=20, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    ends = [0] + [m.end() for m in re.finditer(unit if unit == r"(?s:.)" else f"(?:{unit}|(?s:.))", text)]
    n = len(ends) - 1
    if not n or any(m in text for m in infill.MARKERS) or h[2] % 100 >= cut:
        return doc_id, n, "plain", None, None, text
    a, b = (ends[x] for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


EXTRA = ["a <P> b", "<S>", "x<M>", "tail <", "<P", "é😀" * 300, "line\nbreak\r\n" * 40, " \x85 sep"]


@pytest.fixture(scope="module")
def hostile(spark, rows):
    data = rows + [(1000 + i, t) for i, t in enumerate(EXTRA)] + [(2000 + i, "ab<<é" * (i + 1)) for i in range(150)]
    return data, spark.createDataFrame([(i, t, b"k", 1, 2) for i, t in data], "doc_id long, text string, key binary, first int, form int").repartition(3)


def test_characters(hostile):
    data, df = hostile
    got = infill.fill_in_middle(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(*r) for r in data), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_restored(hostile):
    data, df = hostile
    got = infill.fill_in_middle_digests(df).select("doc_id", "output_sha256", "restored_sha256").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, sha(plain(i, t)[-1]), sha(t or "")) for i, t in data), key=repr)


@pytest.mark.parametrize("run", [1, 5, 64])
def test_other_units(hostile, run):
    """Words with the blanks behind them; whatever is no word is a unit by the character."""
    data, df = hostile
    got = infill.fill_in_middle(df, r"[a-zA-Z]+\x20*", 100, 50, 7, run).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(*r, r"[a-zA-Z]+\x20*", 100, 50, 7) for r in data), key=repr)


def test_unit_rows_are_few_and_whole(spark):
    """A long text costs a row for each run, and its unit relation covers it."""
    df = spark.createDataFrame([(5, "word é " * 250_000)], "doc_id long, text string")
    t = infill.cut_requests(df, infill.CHARACTER, 100, 20, 1)
    units = infill.unit_rows(t, infill.CHARACTER).agg(F.sum("units"), F.sum("chars"), F.count("*")).first()
    assert units[0] == units[1] == 1_750_000 and units[2] < 1_750_000 / 64 + 129
    assert tuple(infill.fill_in_middle(df).first()) == plain(5, "word é " * 250_000)


def test_texts_move_once(spark, docs):
    """One exchange, by key, which all branches read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = infill.fill_in_middle(docs)
        plan = t._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    reused = plan.count("ReusedExchange")
    assert reused == 2 and plan.count("Exchange hashpartitioning") - reused == 1
    assert "Python" not in plan and "NestedLoop" not in plan


def test_empty(empty):
    assert infill.fill_in_middle_digests(empty).count() == 0
