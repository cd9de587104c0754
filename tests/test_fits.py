"""Random intercepts and fitted shifts against dense solutions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import fits


def dense(y, x, group, reml):
    """Deviance of a variance ratio with the whole covariance matrix."""
    same = (group[:, None] == group[None, :]).astype(float)

    def at(ratio):
        v = np.eye(len(y)) + ratio * same
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        beta = np.linalg.solve(a, x.T @ w @ y)
        e = y - x @ beta
        free = len(y) - x.shape[1] if reml else len(y)
        s2 = e @ w @ e / free
        dev = free * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1]
        return dev + (np.linalg.slogdet(a)[1] if reml else 0), beta, np.sqrt(np.diag(np.linalg.inv(a)) * s2), s2

    low, high = -12.0, 12.0
    for _ in range(70):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        if at(math.exp(a))[0] < at(math.exp(b))[0]:
            high = b
        else:
            low = a
    ratio = math.exp(low)
    return (0.0, *at(0.0)) if at(0.0)[0] <= at(ratio)[0] + 1e-7 else (ratio, *at(ratio))


@pytest.mark.parametrize("method", ["ml", "reml"])
@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_random_intercept_is_the_dense_solution(spark, method, spread):
    rng = np.random.default_rng(7)
    group = np.repeat(np.arange(14), rng.integers(1, 6, 14))  # groups of one row among them
    x = np.column_stack([np.ones(len(group)), rng.normal(size=len(group)), rng.integers(0, 2, len(group))])
    y = x @ [1.0, 2.0, -0.5] + spread * rng.normal(size=14)[group] + rng.normal(size=len(group))
    frame = pd.DataFrame({"g": group, "a": x[:, 1], "b": x[:, 2], "y": y, "k": "one"})
    rows = spark.createDataFrame(frame)
    rows = rows.union(spark.createDataFrame([(1, None, 1.0, 2.0, "one"), (None, 1.0, 1.0, 2.0, "one")], rows.schema))
    terms = {"Intercept": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}
    got = fits.random_intercept(rows, ["k"], "g", "y", terms, method).toPandas()
    ratio, dev, beta, se, s2 = dense(y, x, group, method == "reml")
    assert got.term.tolist() == list(terms)
    np.testing.assert_allclose(got.coef, beta, rtol=1e-6)
    np.testing.assert_allclose(got.std_err, se, rtol=1e-6)
    np.testing.assert_allclose(got.variance_ratio, ratio, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(got.residual_variance, s2, rtol=1e-6)
    np.testing.assert_allclose(-2 * got.log_likelihood, dev, rtol=1e-9)
    assert set(got.n_obs) == {len(y)} and set(got.n_groups) == {14} and got.converged.all()
    assert got.aic.isna().all() == (method == "reml")
    everything = fits.random_intercept(rows, [], "g", "y", terms, method).toPandas()
    np.testing.assert_allclose(everything.coef, beta, rtol=1e-6)


def test_groups_of_one_row_have_no_ratio(spark):
    rows = spark.range(30).selectExpr("id AS g", "sin(id) AS y")
    got = fits.random_intercept(rows, [], "g", "y", {"Intercept": F.lit(1.0)}).collect()[0]
    y = np.sin(np.arange(30))
    assert got.variance_ratio == 0 and math.isclose(got.coef, y.mean(), rel_tol=1e-9)
    assert math.isclose(got.residual_variance, y.var(), rel_tol=1e-9)
    flat = fits.random_intercept(rows.withColumn("y", F.lit(2.0)), [], "g", "y", {"Intercept": F.lit(1.0)}).collect()[0]
    assert math.isclose(flat.coef, 2.0) and not flat.converged
    assert fits.random_intercept(rows.limit(0), [], "g", "y", {"Intercept": F.lit(1.0)}).collect() == []
    with pytest.raises(ValueError):
        fits.random_intercept(rows, [], "g", "y", {}, "other")


def newton(x, hits, n):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ ((n * p * (1 - p))[:, None] * x)
        beta = beta + np.linalg.solve(h, x.T @ (hits - n * p))
    return beta, np.linalg.inv(h)


def rows_of(spark, cells):
    frame = spark.createDataFrame(cells, "c string, f string, m string, hits int, n int")
    return frame.selectExpr("c", "f", "m", "explode(sequence(1, n)) AS i", "hits").selectExpr("c", "f", "m", "CAST(i <= hits AS INT) AS hit")


def test_shifts_of_main_effects_are_those_of_newton(spark):
    rng = np.random.default_rng(3)
    cells = [(c, f, m, int(rng.integers(5, 30)), 40 + int(rng.integers(0, 30))) for c in ("base", "x", "y") for f in "pq" for m in "uvw"]
    rows = rows_of(spark, cells)
    got = fits.fitted_shifts(rows, [], ["f"], "c", "hit", "base", crossed=[("c", "f")], averaged=["m"]).toPandas()

    def line(c, f, m):
        cx, cy, fq = float(c == "x"), float(c == "y"), float(f == "q")
        return [1, cx, cy, fq, m == "v", m == "w", cx * fq, cy * fq]

    x = np.array([line(*cell[:3]) for cell in cells], float)
    beta, cov = newton(x, np.array([k for *_, k, _ in cells], float), np.array([n for *_, n in cells], float))
    for r in got.itertuples():
        own, base = (np.mean([line(c, r.f, m) for m in "uvw"], axis=0) for c in (r.c, "base"))
        eta, eta0 = own @ beta, base @ beta
        p, p0 = (1 / (1 + math.exp(-e)) for e in (eta, eta0))
        slope, slope0 = p * (1 - p) * own, p0 * (1 - p0) * base
        want = [p, math.sqrt(slope @ cov @ slope), eta, math.sqrt(own @ cov @ own), p - p0, math.sqrt((slope - slope0) @ cov @ (slope - slope0)), eta - eta0, math.sqrt((own - base) @ cov @ (own - base))]
        have = [r.fitted, r.fitted_se, r.log_odds, r.log_odds_se, r.probability_shift, r.probability_shift_se, r.log_odds_shift, r.log_odds_shift_se]
        np.testing.assert_allclose(have, want, rtol=1e-7, atol=1e-9)
        assert r.converged and (math.isnan(r.p_value) if r.c == "base" else 0 <= r.p_value <= r.p_holm <= 1)


def test_saturated_cells_without_hits_and_missing_baseline(spark):
    cells = [("base", "p", "u", 4, 10), ("x", "p", "u", 0, 10), ("y", "p", "u", 10, 10), ("x", "q", "u", 3, 9)]
    got = {(r.f, r.c): r for r in fits.fitted_shifts(rows_of(spark, cells), [], ["f"], "c", "hit", "base", crossed=None).collect()}
    for (c, f, _, hits, n) in cells:
        r = got[f, c]
        assert math.isclose(r.fitted, hits / n, abs_tol=1e-9) and r.n == n and math.isclose(r.observed, hits / n)
        assert math.isclose(r.fitted_se, math.sqrt(hits / n * (1 - hits / n) / n), abs_tol=1e-6)
    assert got["q", "x"].probability_shift is None and got["p", "x"].probability_shift == pytest.approx(-0.4)
    with pytest.raises(ValueError):
        fits.fitted_shifts(rows_of(spark, cells), [], ["f"], "c", "hit", "base", crossed=[("c", "other")])
    none = fits.fitted_shifts(rows_of(spark, cells).limit(0), [], ["f"], "c", "hit", "base")
    assert none.collect() == []
