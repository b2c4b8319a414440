"""Quality rules: Viterbi decoding of a linear-chain conditional random field over a document's lines.

Each line with a word is a position of the chain, its state content or boilerplate. A document stays when at least
``share`` of its words stand in content lines and the base rules hold.

The field is trained on at most ``SAMPLE`` labelled documents, the first by a hash of their ids among those of at most
``MAX_LINES`` lines, whole. Line states are latent: a label only says where most words of a document stand. So a document is
one observation, its lines weigh by their share of its words, and each line is taken to carry the label of its document
truly or, with probability ``NOISE``, falsely; the evidence of lines is fitted to that. Transitions have a prior by which
states stay (``STAY``); they are first fitted to lines decided one by one and held to their labels. Field and states are
then fitted to each other by expectations: forward-backward gives the probabilities of states and of moves, tilted for a
document whose expected share contradicts its label just so far that half of its words agree, and the field is fitted to
these expectations. Decoding covers all documents and all their lines. Without labels, ``DEFAULT`` serves.

Defined cases: a null or empty text has no words and fails the base rules; rows are judged one by one, so repeated rows
and repeated or null ids each get their own equal verdict; an empty table gives an empty result; other columns of the
input are ignored by ``quality_rules`` and kept by ``keep_documents``. Viterbi ties go to content.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .docstats import LINE_FEATURES, Counts
from .textkit import slices

SAMPLE, MAX_LINES, ROUNDS = 2048, 1024, 2
NOISE, STAY = 0.1, 1.0
MIN_WORDS, MAX_REPEAT = 20, 30
SHARE = 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


class Field(NamedTuple):
    """Weights of boilerplate against content: per line feature, of the first state, and of each transition."""

    emission: np.ndarray
    first: np.ndarray
    step: np.ndarray


#: Weights of a field trained once on labelled documents, rounded; for input without labels.
DEFAULT = Field(np.array([-3.0, 8.0, 5.0, 6.0, 6.0, 6.0, 0.5, -0.5, 0.3, -1.0]), np.array([0.5, -0.5]), np.array([[1.0, -1.0], [-1.0, 1.0]]))


def _chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents that have lines, longest first: their numbers, first line and line count."""
    ids, start, count = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    return ids[order], start[order], count[order]


def viterbi(field: Field, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The likeliest states (1: boilerplate) of all chains at once, one position of every chain per step."""
    out = np.zeros(len(doc), np.int8)
    if not len(doc):
        return out
    boiler = features @ field.emission
    _, start, count = _chains(doc)
    back = np.zeros((len(doc), 2), np.int8)
    active = len(count)
    best = np.zeros((active, 2))
    for t in range(int(count[0])):
        active = int(np.searchsorted(-count, -t, "left"))
        at = start[:active] + t
        if t == 0:
            best += field.first
        else:
            moves = best[:active, :, None] + field.step
            back[at] = moves.argmax(1)
            best[:active] = moves.max(1)
        best[:active, 1] += boiler[at]
    state = (best[:, 1] > best[:, 0]).astype(np.int8)
    for t in range(int(count[0]) - 1, -1, -1):
        active = int(np.searchsorted(-count, -t, "left"))
        at = start[:active] + t
        out[at] = state[:active]
        state[:active] = back[at, state[:active]]
    return out


def expectations(field: Field, evidence: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once, one position of every chain per step: the probability of boilerplate
    by line, the expected number of chains that begin in each state, and of each move.

    ``evidence``: of boilerplate by line, beside the field's first states and moves.
    """
    _, start, count = _chains(doc)
    emit = np.stack([np.zeros(len(doc)), evidence], 1)
    ahead, behind = np.zeros((len(doc), 2)), np.zeros((len(doc), 2))
    live = [start[: int(np.searchsorted(-count, -t, "left"))] + t for t in range(int(count[0]))]
    ahead[live[0]] = field.first + emit[live[0]]
    for at in live[1:]:
        ahead[at] = np.logaddexp(ahead[at - 1, :1] + field.step[0], ahead[at - 1, 1:] + field.step[1]) + emit[at]
    moves = np.zeros((2, 2))
    for at in live[:0:-1]:
        ending = emit[at] + behind[at]
        behind[at - 1] = np.logaddexp(field.step[:, 0] + ending[:, :1], field.step[:, 1] + ending[:, 1:])
    z = np.logaddexp(*(ahead + behind).T)
    one = np.exp(ahead[:, 1] + behind[:, 1] - z)
    if len(live) > 1:
        at = np.concatenate(live[1:])
        moves = np.exp(ahead[at - 1][:, :, None] + field.step + (emit[at] + behind[at])[:, None, :] - z[at][:, None, None]).sum(0)
    begin = one[start].sum()
    return one, np.array([len(start) - begin, begin]), moves


def train(features: np.ndarray, doc: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.3, ridge: float = 1e-3, start_at: Field | None = None, first: np.ndarray | None = None, moves: np.ndarray | None = None) -> Field:
    """Maximise the conditional log-likelihood of states by Adam steps, with a ridge around ``start_at``.

    ``labels``: states of lines, or their probabilities of boilerplate; for the latter, ``first`` and ``moves`` give the expected
    numbers of first states and of moves.
    """
    k = features.shape[1]
    if first is None or moves is None:
        y = labels.astype(np.int64)
        _, start, _ = _chains(doc)
        at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        first = np.bincount(y[start], minlength=2).astype(float)
        moves = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2).astype(float)
    centre = np.zeros(k + 6) if start_at is None else np.concatenate([x.ravel() for x in start_at])
    theta = centre.copy()
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        field = Field(theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2))
        one, begin, moved = expectations(field, features @ theta[:k], doc)
        slope = np.concatenate([features.T @ (labels - one), first - begin, (moves - moved).ravel()]) / max(1, len(doc)) - ridge * (theta - centre)
        moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (moment / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return Field(theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2))


def line_evidence(features: np.ndarray, words: np.ndarray, doc: np.ndarray, bad: np.ndarray, noise: float = NOISE, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Weights of boilerplate by line alone: both labels weigh alike, documents of a label alike, and lines by words; a label is false with probability ``noise``."""
    share = words / np.maximum(np.bincount(doc, words, minlength=len(bad)), 1)[doc]
    kinds = np.bincount(bad[np.unique(doc)], minlength=2)
    weight = share / np.maximum(kinds, 1)[bad[doc]] / 2
    label, theta = bad[doc], np.zeros(features.shape[1])
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        seen = noise + (1 - 2 * noise) * p
        slope = features.T @ (weight * (1 - 2 * noise) * p * (1 - p) * (label / seen - (1 - label) / (1 - seen))) - ridge * theta
        moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (moment / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return theta


def tilted(field: Field, evidence: np.ndarray, words: np.ndarray, doc: np.ndarray, bad: np.ndarray, steps: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectations as near to the field's as can be with half of every document's words, in expectation, where its label is.

    The nearest distribution adds a multiple of a line's share of words to its evidence; the multiple is found by halving.
    """
    share = words / np.maximum(np.bincount(doc, words, minlength=len(bad)), 1)[doc]
    way = np.where(bad, 1.0, -1.0)[doc]
    agree = lambda one: np.bincount(doc, share * np.where(way > 0, one, 1 - one), minlength=len(bad))
    short = agree(expectations(field, evidence, doc)[0]) < 0.5
    low, high = np.zeros(len(bad)), np.where(short, 4096.0, 0.0)
    own = short[doc]
    if own.any():
        for _ in range(steps):
            middle = (low + high) / 2
            one = np.zeros(len(doc))
            one[own] = expectations(field, (evidence + way * share * middle[doc])[own], doc[own])[0]
            enough = agree(one) >= 0.5
            low, high = np.where(short & ~enough, middle, low), np.where(short & enough, middle, high)
    return expectations(field, evidence + way * share * high[doc], doc)


def constrained(states: np.ndarray, score: np.ndarray, words: np.ndarray, doc: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """``states`` with the fewest words changed, by evidence, so that half of the words of every document have its label's state.

    ``score``: evidence of boilerplate by line; ``bad``: by document.
    """
    out = states.copy()
    label = bad[doc].astype(np.int8)
    order = np.lexsort((np.where(label == 1, -score, score), states != label, doc))  # lines that agree first, then the next best
    w = words[order].astype(np.float64)
    before = np.cumsum(w) - w
    start = np.searchsorted(doc[order], np.arange(len(bad)))
    before -= before[np.minimum(start, len(w) - 1)][doc[order]]
    needed = before * 2 < np.bincount(doc, words, minlength=len(bad))[doc[order]]
    out[order[needed]] = label[order[needed]]
    return out


def learn(features: np.ndarray, words: np.ndarray, doc: np.ndarray, bad: np.ndarray) -> Field:
    """A field from documents' labels: evidence of lines, then states and moves by expectations under the labels' shares."""
    stay = STAY * np.array([[1.0, -1.0], [-1.0, 1.0]]) / 2
    field = Field(line_evidence(features, words, doc, bad), np.zeros(2), stay)
    score = features @ field.emission
    # the first guess of moves: lines by themselves, held to the labels by those of least evidence
    guess = constrained((score > 0).astype(np.int8), score, words, doc, bad)
    if len(np.unique(guess)) < 2:
        return field
    field = train(features, doc, guess, rounds=60, rate=0.1, ridge=1e-2, start_at=field)
    for _ in range(ROUNDS):
        one, first, moves = tilted(field, features @ field.emission, words, doc, bad)
        field = train(features, doc, one, rounds=40, rate=0.1, ridge=1e-2, start_at=field, first=first, moves=moves)
    return field


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality = batch.column(1).to_numpy(zero_copy_only=False)
        for s in slices(batch.column(0)):
            x, doc, words = Counts(s).line_features()
            x = np.concatenate([x, words[:, None]], 1).astype(np.float32)
            ids, start, count = np.unique(doc, return_index=True, return_counts=True)
            whole = [(int(quality[s.first + d]), x[a : a + c].tobytes()) for d, a, c in zip(ids, start, count) if c <= MAX_LINES]
            yield pa.record_batch([pa.array([q for q, _ in whole], pa.int32()), pa.array([b for _, b in whole], pa.binary())], ["quality", "lines"])


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on the bounded sample; DEFAULT where labels are absent or of one kind only."""
    if labels is None:
        return DEFAULT
    ship(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).dropna().orderBy(F.xxhash64("id"), "id", "quality").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("text", "quality").mapInArrow(_line_rows, "quality int, lines binary")
    # bounded where labels or ids repeat, and the same rows, whatever order they come in
    rows = rows.orderBy(F.xxhash64("lines"), "lines", "quality").limit(SAMPLE).collect()
    if len({r["quality"] for r in rows}) < 2:
        return DEFAULT
    parts = [np.frombuffer(r["lines"], np.float32).reshape(-1, len(LINE_FEATURES) + 1) for r in rows]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x = np.concatenate(parts).astype(np.float64)
    return learn(x[:, :-1], x[:, -1], doc, np.array([int(r["quality"] == 0) for r in rows]))


def judge(c: Counts, field: Field, share: float) -> dict[str, np.ndarray]:
    x, doc, words = c.line_features()
    content = np.bincount(doc, words * (viterbi(field, x, doc) == 0), minlength=c.slice.n)
    failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEAT * c.n_words)
    part = content / np.maximum(c.n_words, 1)
    return {"base_failed": failed, "content_share": part, "kept": ~failed & (part >= share)}


def quality_rules(docs: DataFrame, field: Field = DEFAULT, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, base verdict, share of words in content lines, final verdict."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                c = Counts(s)
                v = judge(c, field, share)
                longs = [pa.array(np.asarray(x).astype(np.int64)) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)]
                yield pa.record_batch([batch.column(0).slice(s.first, s.n), *longs, *(pa.array(v[k]) for k in ("base_failed", "content_share", "kept"))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, SCHEMA)


def keep_documents(docs: DataFrame, field: Field = DEFAULT, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def verdict(text: pa.Array) -> pa.Array:
        found = [judge(Counts(s), field, share)["kept"] for s in slices(text)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.filter(verdict(F.col(text_col)))
