"""Pruned cosine neighbours against the whole product."""

import numpy as np
import pandas as pd
import pytest

from pairlens.operators import vectors


def frame(spark, v, prefix=""):
    return spark.createDataFrame([(f"{prefix}{i:04d}", list(map(float, r))) for i, r in enumerate(v)], "id string, v array<double>")


def brute(q, r, k, exclude_self):
    def unit(v):
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    sims = np.round(unit(q) @ unit(r).T, 12)
    if exclude_self:
        np.fill_diagonal(sims, -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return {f"{i:04d}": [f"{j:04d}" for j in row if np.isfinite(sims[i, j])] for i, row in enumerate(order)}


def made(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5)) * 4
    v = np.round(centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 5)) * 0.2, 6)
    v[::9] = v[0]  # copies
    v[3::50] = 0.0
    v[5] = -v[4]
    return v


@pytest.mark.parametrize("block,pivots,k", [(8, 5, 4), (4096, 64, 3), (3, 1, 7), (16, 20, 500)])
def test_neighbours_are_those_of_the_whole_product(spark, block, pivots, k):
    v = made(1, 260)
    df = frame(spark, v)
    for queries, exclude in ((v, True), (made(2, 40), False)):
        got = {}
        for r in vectors.cosine_neighbors(frame(spark, queries), df, "id", "v", k, exclude, block, pivots).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r.reference)
        assert got == brute(queries, v, k, exclude)


def test_bounds_hold_and_rule_out_most_blocks(spark):
    v = made(3, 2000)
    held, bins, points = vectors._placed(frame(spark, v), "id", "v", 40, 12)
    assert held.count() == 2000 and len(points) <= 12
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    bound = bins.bounds(vectors._angles(unit, points))
    sims = unit @ unit.T
    for r in held.select("reference", "bin").collect():
        assert (sims[:, int(r.reference)] <= bound[:, r.bin] + 1e-9).all()
    fifth = np.sort(sims, axis=1)[:, -5]
    own = np.linalg.norm(v, axis=1) > 0
    assert (bound[own] >= fifth[own, None] - 1e-9).mean() < 0.5


def test_zero_vectors_only_and_no_rows(spark):
    zero = frame(spark, np.zeros((5, 3)))
    got = vectors.cosine_neighbors(zero, zero, "id", "v", 2, exclude_self=True).orderBy("query", "rank").collect()
    assert [r.reference for r in got] == ["0001", "0002", "0000", "0002", "0000", "0001", "0000", "0001", "0000", "0001"]
    assert {r.cosine for r in got} == {0.0}
    assert vectors.cosine_neighbors(zero, zero.limit(0), "id", "v", 2).collect() == []
    assert vectors.cosine_neighbors(zero.limit(0), zero, "id", "v", 2).collect() == []


def test_visits_come_in_bounded_parts():
    rng = np.random.default_rng(4)
    pivots = vectors._unit(pd.Series(list(rng.normal(size=(64, 8)))))
    n = 64 * 40
    bins = vectors.Bins(np.repeat(np.arange(64), 40), np.zeros(n), np.full(n, np.pi), np.full(n, 5))  # nothing is ruled out
    asked = pd.DataFrame({"query": [str(i) for i in range(150)], "v": list(rng.normal(size=(150, 8))), "bin": 3, "part": 1, "least": 0.5})
    seen, first, bounds = [], [], vectors.Bins.bounds
    try:
        vectors.Bins.bounds = lambda self, angles: seen.append(len(angles)) or bounds(self, angles)
        first = [len(b) for b in vectors._visits(iter([asked]), bins, pivots, True)]
        found = list(vectors._visits(iter([asked]), bins, pivots, False))
    finally:
        vectors.Bins.bounds = bounds
    assert sum(first) == 150 and max(seen) * n <= vectors._CELLS and max(map(len, found)) <= vectors._SENT
    every = pd.concat(found)
    assert len(every) == 150 * (5 * n - 1) == len(every.drop_duplicates(["query", "bin", "part"]))
    assert not ((every["bin"] == 3) & (every["part"] == 1)).any()
