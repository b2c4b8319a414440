"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration.

Statistics of every whole text are computed once and written to the shared folder. Training rows are those with a quality
label whose id is outside the held-out fold; nothing about them but their text is an input. The Gaussian kernel is
approximated by ``FEATURES`` cosines with fixed seed. Each of ``SUMS`` partitions sums its part of the normal equations,
so what reaches the driver has a fixed size whatever the number of rows; so do the ``BINS`` bins of the calibration.

Defined cases: a null or empty text has zero statistics and is scored like any other; repeated rows get equal scores; a
null id is never held out nor trained on; without training rows every score is 0.5; an empty table gives an empty result;
of several labels of one document each counts once. Texts of any length are counted whole. Equal raw scores share a place on the
calibration curve, so ties stay ties. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, ship
from .docstats import DOC_FEATURES, Counts
from .textkit import slices

#: Partial sums are added up as a tree, FAN to one and SUMS at the top, which reach the driver; CROSS folds of the training rows
#: for calibration.
FEATURES, SUMS, FAN, BINS, CROSS = 256, 16, 32, 512, 4
WIDTH, RIDGE, THRESHOLD = 1.0, 0.5, 0.3
SCHEMA = "doc_id long, stats binary"


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray


def fourier(model: Model, stats: np.ndarray) -> np.ndarray:
    """cos features whose inner products approximate a Gaussian kernel of the standardised statistics; a constant last."""
    x = np.clip((stats - model.mean) / model.scale, -4, 4)
    z = np.sqrt(2 / FEATURES) * np.cos(x @ model.waves + model.phase)
    return np.concatenate([z, np.ones((len(x), 1))], 1)


def raw_scores(model: Model, stats: np.ndarray) -> np.ndarray:
    return fourier(model, stats) @ model.weights


def scores(model: Model, stats: np.ndarray) -> np.ndarray:
    if not len(model.knots):
        return np.full(len(stats), 0.5)
    return np.clip(np.interp(raw_scores(model, stats), model.knots, model.values), 0, 1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every row's whole text, as float64 bytes."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                x = Counts(s).doc_features()
                yield pa.record_batch([batch.column(0).slice(s.first, s.n), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, SCHEMA)


def unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(DOC_FEATURES))


def isotonic(score: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted scores: knots and their non-decreasing shares of good."""
    blocks: list[list[float]] = []
    for s, g, t in zip(score, good, total):
        blocks.append([s, s, g, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, g2, t2 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + g2, blocks[-1][3] + t2]
    knots, values = [], []
    for lo, hi, g, t in blocks:
        share = (g + 0.5) / (t + 1)
        knots += [lo, hi] if hi > lo else [lo]
        values += [share, share] if hi > lo else [share]
    return np.array(knots), np.maximum.accumulate(np.array(values)) if values else np.array(values)


def fit(stats: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Model:
    """Three passes over the labelled rows' statistics, each summed by partition."""
    k = len(DOC_FEATURES)
    rng = np.random.default_rng(20240229)
    model = Model(np.zeros(k), np.ones(k), rng.normal(0, WIDTH / np.sqrt(k), (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().filter(crc_mod("doc_id", folds) != held)
    inner = F.expr(f"pmod(crc32(cast(cast(doc_id as string) as binary)) div {folds}, {CROSS})").cast("int")
    train = materialise(stats.join(chosen, "doc_id").select("stats", "quality", inner.alias("inner")), "labelled")
    tasks = train.rdd.getNumPartitions()

    def summed(make, size: int) -> np.ndarray:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += make(unpack(batch.column(0)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])).ravel()
            if total.any():
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    total += np.frombuffer(part, np.float64)
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts, width = train.mapInArrow(rows, "part binary"), tasks
        while True:
            width = max(SUMS, -(-width // FAN))
            parts = parts.repartition(width).mapInArrow(add, "part binary")
            if width == SUMS:
                return sum((np.frombuffer(r["part"], np.float64) for r in parts.collect()), np.zeros(size))

    m = summed(lambda x, y, f: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 2 * k + 1)
    n = m[0]
    if not n:
        return model
    mean = m[1 : k + 1] / n
    model = model._replace(mean=mean, scale=np.sqrt(np.maximum(m[k + 1 :] / n - mean**2, 0)) + 1e-6)
    d = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        z = fourier(model, x)
        return np.stack([np.concatenate([(z[f == i].T @ z[f == i]).ravel(), z[f == i].T @ y[f == i]]) for i in range(CROSS)])

    def ridge(sums: np.ndarray) -> np.ndarray:
        penalty = np.full(d, RIDGE)
        penalty[-1] = 1e-9
        return np.linalg.solve(sums[: d * d].reshape(d, d) + np.diag(penalty), sums[d * d :])

    sums = summed(normal, CROSS * (d * d + d)).reshape(CROSS, -1)
    model = model._replace(weights=ridge(sums.sum(0)))
    # normal equations add up, so those without one fold cost no pass; a row is calibrated by a score that has not seen it
    others = np.stack([ridge(sums.sum(0) - own) for own in sums])

    def binned(x: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        s = (fourier(model, x) * others[f]).sum(1)
        b = np.clip(((s + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(b, w, minlength=BINS) for w in (None, y, s)])

    total, good, score = summed(binned, 3 * BINS).reshape(3, BINS)
    full = total > 0
    knots, values = isotonic(score[full] / total[full], good[full], total[full])
    return model._replace(knots=knots, values=values)


def score_table(stats: DataFrame, model: Model, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: whether held out, calibrated score, prediction."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = scores(model, unpack(batch.column(2)))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "stats").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    stats = materialise(statistics(docs), "docstats")
    return score_table(stats, fit(stats, labels, folds, held), folds, held)


def keep_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        found = [scores(model, Counts(s).doc_features()) >= threshold for s in slices(text)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.filter(good(F.col(text_col)))
