"""Document quality by a regularised quadratic discriminant over document statistics.

Each text gives counts (letters, symbols, repeats, lines ...) that are turned into log
ratios, so that classes are nearer to normal. Class means and covariances come from one
pass over all labelled rows; covariances are shrunk towards the pooled one, and that
towards a multiple of the identity. A score is the difference of the classes' log densities,
from Mahalanobis distances by the cached inverse Cholesky factors, mapped to a probability by
a slope and an offset fitted on about ``SAMPLE`` labelled rows, chosen by a hash of the id.

Nulls: a null text is the empty text and is scored like any other; a null or repeated
``doc_id`` is handed through, row by row. Labelled ids with a null or contradictory label are not
learned from. Without rows of both classes every score is the share of label 1 (0.5
without labels). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, about, texts

THRESHOLD = 0.3
#: Labelled rows that the slope and offset are fitted on, about (all, if there are fewer).
SAMPLE = 20_000
#: Weight of the pooled covariance in a class's, counted as rows, and of the identity.
POOLED_ROWS, IDENTITY = 50.0, 0.02

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_STOP = b".,;:?"
_HIGH = bytes(range(128, 256))
_SYMBOL = bytes(set(range(33, 127)) - set(_UPPER + _LOWER + _DIGIT + _STOP))
N_FEATURES = 16


def _ratio(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    upper, lower, digit, space, stop, high, symbol = (n - len(data.translate(None, c)) for c in (_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _HIGH, _SYMBOL))
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    k, distinct = len(words), len(set(words))
    twice = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    codes = np.frombuffer(data, np.uint8)
    same = int(np.count_nonzero(codes[1:] == codes[:-1]))
    bare = len(data.translate(None, _SYMBOL).split())
    return [
        float(np.log1p(n)),
        _ratio(upper, upper + lower),
        _ratio(digit, n),
        _ratio(symbol, n),
        _ratio(stop, n),
        _ratio(space, n),
        _ratio(high, n),
        _ratio(same, n),
        float(np.log((n - space + 1) / (k + 1))),
        _ratio(distinct, k),
        _ratio(twice, k),
        _ratio(pairs, max(k - 1, 0)),
        _ratio(k - bare, k),
        float(np.log((k + 1) / (len(lines) + 1))),
        _ratio(len(set(lines)), len(lines)),
        _ratio(data.count(b"!") + data.count(b"|"), n),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the transformed statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts(docs).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Discriminant(NamedTuple):
    means: np.ndarray  # class, feature
    factors: np.ndarray  # class, inverse lower Cholesky factor of its covariance
    constants: np.ndarray  # class: log prior less half the log determinant
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 less those of class 0."""
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        # Finite for any text: beyond 30 the probability is 0 or 1 to all digits shown.
        return 1 / (1 + np.exp(-np.clip(self.slope * squeeze(self.difference(x)) + self.offset, -30, 30)))


def squeeze(d: np.ndarray) -> np.ndarray:
    """Far tails of the densities say little more than near ones: a signed log."""
    return np.sign(d) * np.log1p(np.abs(d))


def _moments(rows: DataFrame) -> dict[tuple[int, int], float]:
    """Sums of 1, x and x x' by label: (label, place) -> sum."""
    n = 1 + N_FEATURES + N_FEATURES * N_FEATURES

    def run(batches):
        sums = np.zeros((2, n))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, N_FEATURES)
            for label in (0, 1):
                own = x[y == label]
                sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        labels, places = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
        yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(places), pa.array(sums.reshape(-1))], ["label", "place", "v"])

    summed = rows.select("label", "x").mapInArrow(run, "label long, place long, v double").groupBy("label", "place").agg(F.sum("v").alias("v"))
    return {(r.label, r.place): r.v for r in summed.collect()}


def fit(rows: DataFrame) -> Discriminant | float:
    """The discriminant of rows (label, x, doc_id), or the share of label 1 if a class is missing."""
    p, sums = N_FEATURES, _moments(rows)
    count = np.array([sums.get((k, 0), 0.0) for k in (0, 1)])
    if count.min() < 1:
        return 0.5 if not count.sum() else float(count[1] / count.sum())
    flat = np.array([[sums[k, i] for i in range(1 + p + p * p)] for k in (0, 1)])
    means = flat[:, 1 : 1 + p] / count[:, None]
    own = flat[:, 1 + p :].reshape(2, p, p) / count[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(count / count.sum(), own, 1)
    pooled = (1 - IDENTITY) * pooled + IDENTITY * (np.trace(pooled) / p + 1e-6) * np.eye(p)
    weight = POOLED_ROWS / (count + POOLED_ROWS)
    shrunk = (1 - weight)[:, None, None] * own + weight[:, None, None] * pooled
    shrunk = (1 - IDENTITY) * shrunk + IDENTITY * pooled
    lower = np.linalg.cholesky(shrunk)
    factors = np.array([np.linalg.solve(c, np.eye(p)) for c in lower])
    constants = np.log(count / count.sum()) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    model = Discriminant(means, factors, constants, 1.0, 0.0)
    sample = about(rows, "doc_id", SAMPLE, int(count.sum())).select("label", "x").collect()
    d = squeeze(model.difference(np.array([r.x for r in sample], float)))
    slope, offset = logistic(d, np.array([r.label for r in sample], float))
    return model._replace(slope=slope, offset=offset)


def logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly penalised logistic curve, by damped Newton steps."""
    x = np.column_stack([d, np.ones(len(d))])
    w, penalty = np.zeros(2), np.diag([1e-2, 1e-2])

    def loss(w):
        return np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * w @ penalty @ w

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def trained(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, Discriminant | float]:
    """The features of all texts, and what is learned from the labelled ones not held out."""
    table = scratch.keep(features(docs), "features")
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other and label in (0, 1)")
        .select("doc_id", F.col("label").cast("long").alias("label"))
    )
    return table, fit(table.where(~held_out(F.col("doc_id"))).join(known, "doc_id"))


def _scores(model: Discriminant | float, rows: list[list[float]]) -> np.ndarray:
    if not isinstance(model, Discriminant):
        return np.full(len(rows), model)
    return model.score(np.array(rows, float).reshape(-1, N_FEATURES))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labels of rows not held out."""
    table, model = trained(docs, labels, Scratch(docs.sparkSession, "quality"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = _scores(shared.value, batch.column(1).to_pylist())
            predicted = (score >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(predicted)], ["doc_id", "score", "predicted"])

    given = table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
    return given.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    _, model = trained(docs, labels, Scratch(docs.sparkSession, "quality"))
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(_scores(shared.value, rows) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
