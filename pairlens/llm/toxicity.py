"""Severity of toxic language by cumulative-link ordinal regression.

Labels say toxic or not; severity grades follow from them and the texts: 0 for a
document that is not toxic, 1 to 3 for a toxic one by the third of all toxic labelled
documents that its amount of telling words falls into. The labels hold no grades, so a grade above 1
says how much of that language there is, not how bad it is: the upper thresholds learn amounts of the
features themselves. Features are the logs of counts of
``FEATURES`` telling words, those whose document frequencies differ most between the
classes. One weight vector serves all thresholds: P(grade > k) = logistic(x w - t_k) with
t_0 < t_1 < t_2. The expected severity is the sum of the three probabilities.

The model is fitted on about ``SAMPLE`` labelled rows, chosen by a hash of the id; all
documents are scored, each on its whole text.

Nulls: a null text is the empty text, which scores as a text without telling words; a null or
repeated ``doc_id`` is handed through, row by row. Labelled ids with a null or
contradictory label are not learned from. Without rows of both classes nothing is
telling, and every score is the share of toxic labels (0 without labels). An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, texts

SAMPLE, FEATURES, LEAST_DOCUMENTS, GRADES = 50_000, 512, 3, 3
PENALTY = 0.1
#: Characters of a telling word, at most.
LONGEST = 40

_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII other than letters parts them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class Ordinal(NamedTuple):
    words: list[bytes]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per value."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds, -30, 30)))


def known_labels(labels: DataFrame) -> DataFrame:
    return (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("toxic").alias("label"), F.max("toxic").alias("other"))
        .where("label = other and label in (0, 1)")
        .select("doc_id", F.col("label").cast("long").alias("label"))
    )


def telling_words(rows: DataFrame) -> list[bytes]:
    """The words whose document frequencies differ most between toxic and other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(set(words_of(text)))
        words = [w for w in seen[0].keys() | seen[1].keys() if len(w) <= LONGEST]
        columns = [pa.array(words, pa.binary()), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)]
        yield pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])

    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return []
    counted = rows.select("label", "text").mapInArrow(run, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # Likelihood ratio of the word's frequencies in both classes against one common frequency.
    t, c, n1, n0 = F.col("t"), F.col("c"), sizes[1], sizes[0]
    common = (t + c) / (n0 + n1)
    gain = sum(
        (F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) for k, n, p in ((t, n1, common), (c, n0, common), (n1 - t, n1, 1 - common), (n0 - c, n0, 1 - common))),
        start=F.lit(0.0),
    )
    best = counted.where((t >= LEAST_DOCUMENTS) & (t * n0 > c * n1)).orderBy(F.desc(gain), "word").limit(FEATURES)
    return [bytes(r.word) for r in best.select("word").collect()]


def _hits(some: list[str], index: dict[bytes, int]) -> tuple[list[list[int]], list[list[int]]]:
    """Of each text the telling words it holds and their counts."""
    ids, counts = [], []
    for text in some:
        found = Counter(index[w] for w in words_of(text) if w in index)
        ids.append(sorted(found))
        counts.append([found[i] for i in ids[-1]])
    return ids, counts


def fit(docs: DataFrame, labels: DataFrame) -> Ordinal:
    # About SAMPLE ids and labels: small enough to be sent to all tasks.
    known = known_labels(labels)
    chosen = about(known, "doc_id", SAMPLE, known.count())
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("label", "text")
    words = telling_words(rows)
    index = {w: i for i, w in enumerate(words)}

    def run(batches):
        for batch in batches:
            ids, counts = _hits(batch.column(1).to_pylist(), index)
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "ids", "counts"])

    got = rows.mapInArrow(run, "label long, ids array<long>, counts array<long>").collect()
    label = np.array([r.label for r in got], np.int64)
    if not words:
        share = float(label.mean()) if len(label) else 0.0
        low = np.log((1 - share + 1e-9) / (share + 1e-9))
        return Ordinal([], np.zeros(0), np.array([low, 40.0, 40.0]))
    amount = np.array([float(np.log1p(r["counts"]).sum()) for r in got])
    grade = np.where(label == 1, 1 + np.searchsorted(np.quantile(amount[label == 1], [1 / 3, 2 / 3]), amount), 0)
    row = np.repeat(np.arange(len(got)), [len(r.ids) for r in got])
    column = np.array([i for r in got for i in r.ids], np.int64)
    value = np.log1p(np.array([c for r in got for c in r["counts"]], float))
    return Ordinal(words, *cumulative_link(row, column, value, grade, len(words)))


def cumulative_link(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that fit the grades.

    The loss is the negative log likelihood plus ``PENALTY`` / 2 times the squared weights.
    Thresholds are one free number and logs of the gaps after it, so they cannot cross.
    """
    n, every = len(grade), np.arange(len(grade))

    def thresholds(theta: np.ndarray) -> np.ndarray:
        return theta[p] + np.concatenate([[0.0], np.cumsum(np.exp(theta[p + 1 :]))])

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, cut = theta[:p], thresholds(theta)
        linear = np.bincount(row, value * w[column], n)
        # Cumulative probabilities P(grade <= k), with 0 before the first and 1 after the last.
        below = 1 / (1 + np.exp(-np.clip(cut[None, :] - linear[:, None], -30, 30)))
        low = np.concatenate([np.zeros((n, 1)), below], axis=1)[every, grade]
        high = np.concatenate([below, np.ones((n, 1))], axis=1)[every, grade]
        mass = np.maximum(high - low, 1e-12)
        from_low, from_high = low * (1 - low) / mass, high * (1 - high) / mass
        d_linear = from_high - from_low
        d_cut = np.array([from_low[grade == k + 1].sum() - from_high[grade == k].sum() for k in range(GRADES)])
        d_gaps = np.exp(theta[p + 1 :]) * np.cumsum(d_cut[::-1])[::-1][1:]
        gradient = np.concatenate([np.bincount(column, value * d_linear[row], p) + PENALTY * w, [d_cut.sum()], d_gaps])
        return float(-np.log(mass).sum() + 0.5 * PENALTY * w @ w), gradient

    start = np.concatenate([np.zeros(p), [np.log((np.mean(grade == 0) + 1e-3) / (np.mean(grade > 0) + 1e-3))], np.zeros(GRADES - 1)])
    best = minimise(loss, start)
    return best[:p], thresholds(best)


def minimise(loss, x: np.ndarray, steps: int = 400, memory: int = 10) -> np.ndarray:
    """Quasi-Newton steps from the last changes of place and gradient, with halving."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        size = 1.0 if past else 1.0 / max(1.0, float(np.abs(g).sum()))
        while size > 1e-12:
            f_new, g_new = loss(x - size * q)
            if f_new <= f - 1e-4 * size * (g @ q):
                break
            size /= 2
        else:
            break
        s, y = -size * q, g_new - g
        x, gain, f, g = x + s, f - f_new, f_new, g_new
        if s @ y > 1e-10:
            past = [*past[-memory + 1 :], (s, y)]
        if gain < 1e-9 * max(1.0, abs(f)):
            break
    return x


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (chance of being toxic), severity (expected grade, 0 to 3), grade (likeliest), toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        model = shared.value
        index = {w: i for i, w in enumerate(model.words)}
        for batch in batches:
            ids, counts = _hits(batch.column(1).to_pylist(), index)
            linear = np.array([float(model.weights[i] @ np.log1p(c)) if i else 0.0 for i, c in zip(ids, counts)])
            above = model.above(linear)
            edges = np.concatenate([np.ones((len(ids), 1)), above, np.zeros((len(ids), 1))], axis=1)
            grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
            columns = [pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "severity", "grade", "toxic"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, severity double, grade int, toxic boolean")
