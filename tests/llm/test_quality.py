import zlib

import numpy as np
import pytest

from pairlens.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    right = [got[i].predicted == y for i, y in truth.items() if got[i].held_out]
    assert np.mean(right) > 0.95


def test_held_out_labels_do_not_matter(spark, docs_of):
    texts = [("good plain text " * (i % 7 + 1)) if i % 3 else "@@!! | | | " * (i % 5 + 2) for i in range(90)]
    docs = docs_of(texts)
    rows = [(i, int(i % 3 > 0)) for i in range(90)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in rows]
    a, b = (
        {r.doc_id: r.score for r in quality.scored(docs, spark.createDataFrame(v, "doc_id long, quality int")).collect()} for v in (rows, flipped)
    )
    assert a == pytest.approx(b)


def test_the_discriminant_is_the_difference_of_normal_densities():
    rng = np.random.default_rng(1)
    p = quality.N_FEATURES
    x = rng.normal(size=(5, p))
    means, covariances = rng.normal(size=(2, p)), []
    for _ in range(2):
        a = rng.normal(size=(p, p))
        covariances.append(a @ a.T + np.eye(p))
    lower = np.linalg.cholesky(np.array(covariances))
    factors = np.array([np.linalg.inv(c) for c in lower])
    constants = -np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    got = quality.Discriminant(means, factors, constants, 1.0, 0.0).difference(x)
    log = [-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) for m, c in zip(means, covariances)]
    assert got == pytest.approx(log[1] - log[0])


def test_odd_inputs(spark, docs_of):
    docs = docs_of([None, "", "x" * 100_000, "a", "a", " \n "], [None, 1, 2, 3, 3, 5])
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, odd).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, int(i != 2)) for i in range(9)], "doc_id long, quality int")
    assert quality.scored(docs, both).where("score is null or isnan(score)").count() == 0
    assert quality.scored(docs.limit(0), both).collect() == []


def slow_statistics(text):
    """The sixteen statistics by loops over bytes, words and lines."""
    import math

    data = list(text.encode("utf-8"))
    white = {32, *range(9, 14)}

    def ratio(part, whole):
        return math.log((part + 0.5) / (whole - part + 0.5))

    def split(codes, cuts):
        out, own = [], []
        for c in codes:
            if c in cuts:
                out.append(tuple(own))
                own = []
            else:
                own.append(c)
        return [*out, tuple(own)]

    def symbol(c):
        return 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:?"

    words = [w for w in split(data, white) if w]
    lines = [line for line in split(data, {10}) if any(c not in white for c in line)]
    n, k = len(data), len(words)
    count = lambda test: sum(1 for c in data if test(c))
    upper, lower = count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122)
    space = count(lambda c: c in white)
    return [
        math.log1p(n), ratio(upper, upper + lower), ratio(count(lambda c: 48 <= c <= 57), n), ratio(count(symbol), n),
        ratio(count(lambda c: chr(c) in ".,;:?"), n), ratio(space, n), ratio(count(lambda c: c > 127), n),
        ratio(sum(a == b for a, b in zip(data, data[1:])), n), math.log((n - space + 1) / (k + 1)), ratio(len(set(words)), k),
        ratio(sum(a == b for a, b in zip(words, words[1:])), k), ratio(len(set(zip(words, words[1:]))), max(k - 1, 0)),
        ratio(sum(all(symbol(c) for c in w) for w in words), k), math.log((k + 1) / (len(lines) + 1)), ratio(len(set(lines)), len(lines)),
        ratio(count(lambda c: chr(c) in "!|"), n),
    ]


def test_statistics_match_a_second_implementation(docs_of):
    import random

    import numpy as np

    rng = random.Random(8)
    parts = ["word", "Word", "é", "😀", "!!", "|", "12", ".", ", ", "\n", "\n\n", " ", "\t", "\x0b", "the the", "#$", "a_b", "x" * 30, "line one\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(150)] + ["", " ", "\n", "ab " * 60_000]
    got = {r.doc_id: r.x for r in quality.features(docs_of(texts + [None])).collect()}
    for i, text in enumerate([*texts, ""]):
        np.testing.assert_allclose(got[i], slow_statistics(text), rtol=1e-12, atol=1e-12)
