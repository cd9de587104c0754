import numpy as np

from pairlens.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_documents_that_were_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    unseen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    truth = {r.doc_id: r.toxic for r in unseen.collect()}
    got = {r.doc_id: r for r in tox.scored(docs, learned).join(unseen.select("doc_id"), "doc_id").collect()}
    y = np.array([truth[i] for i in got])
    flag = np.array([r.toxic for r in got.values()])
    score = np.array([r.score for r in got.values()])
    order = np.argsort(np.argsort(score)) + 1.0
    n1 = y.sum()
    assert (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)) > 0.93
    assert flag[y == 0].mean() < 0.03 and flag[y == 1].mean() > 0.8
    assert all(abs(r.severity) <= 3 for r in got.values())


def test_weights_are_shared_and_thresholds_ordered():
    rng = np.random.default_rng(3)
    n, p = 4000, 4
    x = rng.poisson(0.8, (n, p)).astype(float)
    w, cut = np.array([2.0, -1.0, 0.5, 0.0]), np.array([0.5, 1.5, 3.0])
    grade = (x @ w + rng.logistic(size=n))[:, None] > cut
    row, column = np.nonzero(x)
    got, thresholds = tox.cumulative_link(row, column, x[row, column], grade.sum(axis=1), p)
    assert np.abs(got - w).max() < 0.25 and np.abs(thresholds - cut).max() < 0.3
    assert (np.diff(thresholds) > 0).all()
    model = tox.Ordinal([], got, thresholds)
    above = model.above(np.linspace(-5, 9, 50))
    assert (np.diff(above, axis=1) < 0).all() and (np.diff(above, axis=0) > 0).all()


def test_odd_inputs(spark, docs_of):
    docs = docs_of(["vile vile word", "plain word", None, "", "vile", "x" * 90_000, "Vile!! *vile*"] * 4, [*range(27), None])
    labels = spark.createDataFrame([(i, int(i % 7 in (0, 4, 6))) for i in range(27)] + [(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    got = tox.scored(docs, labels).collect()
    assert len(got) == 28
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].score > by_id[1].score and by_id[2].score == by_id[3].score
    none = labels.where("toxic = 0")
    assert {round(r.score, 6) for r in tox.scored(docs, none).collect()} == {0.0}
    assert {round(r.score, 6) for r in tox.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert tox.scored(docs.limit(0), labels).collect() == []


def test_words_and_scores_match_brute_force(docs_of, spark):
    """Telling words by their definition, and every score from the model by plain loops."""
    import math
    import random
    import re

    rng = random.Random(6)
    mild, bad = ["tree", "sea", "hut", "été", "sun"], ["vile", "foul", "grim"]
    texts = [" ".join(rng.choice(mild + bad * (i % 3 == 0) * 2) + rng.choice([" ", ", ", "1 ", "\n"]) for _ in range(rng.randint(0, 40))) for i in range(240)]
    texts += [None, "VILE vile-Vile", "x" * 90 + " vile", "grim " * 30_000]
    docs = docs_of(texts)
    rows = [(i, int(i % 3 == 0)) for i in range(200)] + [(3, 1), (5, None), (6, 0)]  # 6 is contradictory
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    known = {i: int(i % 3 == 0) for i in range(200) if i not in (5, 6)} | {5: 0}

    def words(text):
        return re.findall("[a-z\x80-\U0010ffff]+", (text or "").lower())

    held = {i: set(words(texts[i])) for i in known}
    size = [sum(v == k for v in known.values()) for k in (0, 1)]
    gain = {}
    for w in set().union(*held.values()):
        n = [sum(known[i] == k and w in own for i, own in held.items()) for k in (0, 1)]
        p = sum(n) / sum(size)
        if n[1] >= tox.LEAST_DOCUMENTS and n[1] / size[1] > n[0] / size[0]:
            cells = [(n[k], size[k] * p) for k in (0, 1)] + [(size[k] - n[k], size[k] * (1 - p)) for k in (0, 1)]
            gain[w] = sum(a * math.log(a / b) for a, b in cells if a)
    assert set(bad) <= set(gain)
    assert [w.decode() for w in model.words] == sorted(gain, key=lambda w: (-round(gain[w], 9), w.encode()))[: tox.FEATURES]
    weight = dict(zip((w.decode() for w in model.words), model.weights))
    for r in tox.scored(docs, labels).collect():
        own = words(texts[r.doc_id])
        linear = sum(weight[w] * math.log1p(own.count(w)) for w in set(own) if w in weight)
        above = [1 / (1 + math.exp(-max(-30.0, min(30.0, linear - t)))) for t in model.thresholds]
        assert math.isclose(r.score, above[0], rel_tol=1e-9) and math.isclose(r.severity, sum(above), rel_tol=1e-9)
        shares = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert math.isclose(shares[r.grade], max(shares), rel_tol=1e-9) and r.toxic == (above[0] >= 0.5)
