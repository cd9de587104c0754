"""Tail probabilities for summary rows.

Only tables with one row per group reach these: Arrow batches in, numpy inside. The
base is the regularised incomplete beta function by its continued fraction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Modified Lentz evaluation of the continued fraction of the incomplete beta."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    value = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = np.ones_like(x)
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            change = change * d * c
        value = value * change
        if np.all(np.abs(change - 1.0) < 1e-14):
            break
    return value


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); NaN where the arguments are."""
    x, a, b = np.broadcast_arrays(
        np.asarray(x, dtype=float), np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    )
    out = np.full(x.shape, np.nan)
    known = np.isfinite(x) & (a > 0) & (b > 0)
    out[known & (x <= 0)] = 0.0
    out[known & (x >= 1)] = 1.0
    inside = known & (x > 0) & (x < 1)
    if inside.any():
        xi, ai, bi = x[inside], a[inside], b[inside]
        swap = xi > (ai + 1.0) / (ai + bi + 2.0)
        p, q, z = np.where(swap, bi, ai), np.where(swap, ai, bi), np.where(swap, 1 - xi, xi)
        front = np.exp(
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
        part = front * _fraction(p, q, z) / p
        out[inside] = np.where(swap, 1.0 - part, part)
    return out


def beta_quantile(p: float, a, b) -> np.ndarray:
    """Inverse of :func:`beta_cdf` in x, by bisection."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(b, dtype=float))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(80):
        mid = (low + high) / 2
        below = beta_cdf(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where((a > 0) & (b > 0), (low + high) / 2, np.nan)


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series(values).where(np.isfinite(values), None).astype("object")


def t_two_sided(t: Column | str, df: Column | str) -> Column:
    """Two-sided p of Student's t."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        v, n = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = beta_cdf(n / (n + v * v), n / 2, np.full_like(n, 0.5))
        return _nullable(p)

    return tail(col(t).cast("double"), col(df).cast("double"))


def normal_two_sided(z: Column | str) -> Column:
    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        v = z.to_numpy(dtype=float)
        return _nullable(_erfc(np.abs(v) / math.sqrt(2.0)))

    return tail(col(z).cast("double"))


def binomial_at_most(k: Column | str, n: Column | str) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2)."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        kv, nv = k.to_numpy(dtype=float), n.to_numpy(dtype=float)
        p = np.where(kv >= nv, 1.0, beta_cdf(0.5, nv - kv, kv + 1))
        return _nullable(np.where(np.isfinite(kv) & np.isfinite(nv), p, np.nan))

    return tail(col(k).cast("double"), col(n).cast("double"))


def exact_rate_interval(x: Column | str, n: Column | str, level: float = 0.95) -> Column:
    """Clopper-Pearson interval of x out of n as ``struct(low, high)``."""
    alpha = (1.0 - level) / 2.0

    @F.pandas_udf("low double, high double")
    def interval(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        xv, nv = x.to_numpy(dtype=float), n.to_numpy(dtype=float)
        low = np.where(xv == 0, 0.0, beta_quantile(alpha, xv, nv - xv + 1))
        high = np.where(xv == nv, 1.0, beta_quantile(1 - alpha, xv + 1, nv - xv))
        some = nv > 0
        return pd.DataFrame(
            {"low": np.where(some, low, np.nan), "high": np.where(some, high, np.nan)}
        )

    return interval(col(x).cast("double"), col(n).cast("double"))
