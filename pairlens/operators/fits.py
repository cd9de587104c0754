"""Fits with more than fixed effects of single rows: a random intercept, and shifts of fitted rates.

Both take from the data what one or two aggregations give (cross products per group, counts per
cell) and solve small systems on those rows, one set of keys a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues
from .stats import _inverse, _symmetric, holm

_FAR = 14.0  # variance ratios are sought between exp(-14) and exp(14), and at 0


# ---- random intercept ---------------------------------------------------------


class Profile:
    """The likelihood of a random-intercept model as a function of the variance ratio alone.

    With ratio r the inverse covariance of a group of n rows is I - r / (1 + r n) 11', so the
    cross products under it are the plain ones less a weight of the group's sums. The weight depends
    on n only: sums over all groups of one size are enough.
    """

    def __init__(self, size, groups, xx, xy, yy, ss, st, tt, reml: bool):
        self.size, self.groups = np.asarray(size, float), np.asarray(groups, float)
        self.xx, self.xy, self.yy, self.ss, self.st, self.tt = xx, xy, yy, ss, st, tt
        self.n, self.p, self.reml = float(self.size @ self.groups), len(xy), reml

    def solved(self, ratio: float):
        c = ratio / (1.0 + ratio * self.size)
        a = self.xx - np.tensordot(c, self.ss, 1)
        b = self.xy - c @ self.st
        inverse, rank = _inverse(a)
        beta = inverse @ b
        rss = max(self.yy - c @ self.tt - beta @ b, 0.0)
        return beta, inverse, rank, rss, a

    def deviance(self, ratio: float) -> float:
        """Minus twice the log-likelihood at the best other parameters."""
        _, _, rank, rss, a = self.solved(ratio)
        free = self.n - rank if self.reml else self.n
        if free <= 0 or rss <= 0:
            return math.inf
        out = free * (math.log(2 * math.pi * rss / free) + 1) + float(self.groups @ np.log1p(ratio * self.size))
        if self.reml:
            values = np.linalg.eigvalsh(a)
            out += float(np.log(values[-rank:]).sum())
        return out

    def slope(self, ratio: float) -> float:
        """The derivative of the deviance by the ratio."""
        beta, inverse, rank, rss, _ = self.solved(ratio)
        weight = 1.0 / (1.0 + ratio * self.size)
        # Squared residual sums of the groups, by size.
        sums = self.tt - 2 * self.st @ beta + np.einsum("i,kij,j->k", beta, self.ss, beta)
        out = float(self.groups @ (self.size * weight))
        out -= (self.n - rank if self.reml else self.n) * float(weight**2 @ sums) / rss
        if self.reml:
            out -= float(np.sum(inverse * np.tensordot(weight**2, self.ss, 1)))
        return out

    def best(self) -> float:
        """The ratio of least deviance: the best of a grid, then the root of the slope beside it; 0 unless
        that is better."""
        grid = np.linspace(-_FAR, _FAR, 81)
        values = [self.deviance(math.exp(u)) for u in grid]
        k = int(np.argmin(values))
        if not math.isfinite(values[k]):
            return 0.0
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        if self.slope(math.exp(low)) < 0 < self.slope(math.exp(high)):
            while high - low > 1e-14 * max(1.0, abs(low)):
                middle = (low + high) / 2
                if not low < middle < high:
                    break
                if self.slope(math.exp(middle)) < 0:
                    low = middle
                else:
                    high = middle
            ratio = math.exp((low + high) / 2)
        else:
            ratio = math.exp(grid[k])
        none = self.deviance(0.0)
        noise = 1e-6 + 1e-13 * abs(none) * max(1.0, ratio)  # of sums that nearly cancel at large ratios
        return ratio if self.deviance(ratio) < none - noise else 0.0


_REPORT = (
    "term string, coef double, std_err double, variance_ratio double, group_variance double, residual_variance double, "
    "log_likelihood double, aic double, bic double, n_obs bigint, n_groups bigint, converged boolean"
)


def random_intercept(
    df: DataFrame, by: Sequence[str], group: str, y: str, terms: Mapping[str, Column], method: str = "ml"
) -> DataFrame:
    """y on the terms with one random intercept for each ``group``, fitted per ``by`` by maximum likelihood
    (``ml``) or restricted maximum likelihood (``reml``; no aic and bic): one row for each term with
    coefficient, error, z, p, and the fit's variances.

    Rows with a null group, y or term are left out. One aggregation sums cross products per group,
    a second one over groups of one size; the search for the variance ratio sees one row for each
    size that occurs (at most the root of twice the number of rows). Groups of one row count as
    any other; if all are, the ratio can't be told from the residual and is 0. ``converged`` is false
    where the terms leave no residual or the ratio is at the search's end.
    """
    if method not in ("ml", "reml"):
        raise ValueError(f"unknown method {method!r}")
    reml, p, labels = method == "reml", len(terms), list(terms)
    names = [f"__x{i}" for i in range(p)]
    rows = df.select(
        *by, F.col(group).alias("__g"), F.col(y).cast("double").alias("__y"), *(c.cast("double").alias(n) for n, c in zip(names, terms.values()))
    ).na.drop(subset=["__g", "__y", *names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    parts = {f"xx{k}": F.col(a) * F.col(b) for k, (a, b) in enumerate(pairs)}
    parts |= {f"xy{i}": F.col(x) * F.col("__y") for i, x in enumerate(names)} | {"yy": F.col("__y") * F.col("__y")}
    parts |= {f"s{i}": F.col(x) for i, x in enumerate(names)} | {"t": F.col("__y")}
    per_group = rows.groupBy(*by, "__g").agg(F.count("*").alias("size"), *(F.sum(v).alias(k) for k, v in parts.items()))
    sums = {k: F.col(k) for k in parts if k[0] in "xy"}
    sums |= {f"ss{k}": F.col(f"s{names.index(a)}") * F.col(f"s{names.index(b)}") for k, (a, b) in enumerate(pairs)}
    sums |= {f"st{i}": F.col(f"s{i}") * F.col("t") for i in range(p)} | {"tt": F.col("t") * F.col("t")}
    keys = list(by) or ["__all"]
    if not by:
        per_group = per_group.withColumn("__all", F.lit(0))
    per_size = per_group.groupBy(*keys, "size").agg(F.count("*").alias("groups"), *(F.sum(v).alias(k) for k, v in sums.items()))
    kinds = {f.name: f.dataType.simpleString() for f in per_size.schema if f.name in keys}

    def matrices(table: pd.DataFrame, name: str) -> np.ndarray:
        flat = table[[f"{name}{k}" for k in range(len(pairs))]].to_numpy(float)
        return np.stack([_symmetric(row, p) for row in flat])

    def fit(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("size")
        vector = {name: table[[f"{name}{i}" for i in range(p)]].to_numpy(float) for name in ("xy", "st")}
        profile = Profile(
            table["size"], table["groups"], matrices(table, "xx").sum(0), vector["xy"].sum(0), table["yy"].sum(),
            matrices(table, "ss"), vector["st"], table["tt"].to_numpy(float), reml,
        )
        ratio = profile.best()
        beta, inverse, rank, rss, _ = profile.solved(ratio)
        free = profile.n - rank if reml else profile.n
        variance = rss / free if free > 0 else math.nan
        score = -profile.deviance(ratio) / 2
        held = rank + 2
        out = pd.DataFrame({c: [v] * p for c, v in zip(keys, key)})
        return out.assign(
            term=labels, coef=beta, std_err=np.sqrt(np.maximum(np.diag(inverse) * variance, 0.0)), variance_ratio=ratio,
            group_variance=ratio * variance, residual_variance=variance, log_likelihood=score,
            aic=math.nan if reml else -2 * score + 2 * held, bic=math.nan if reml else -2 * score + held * math.log(profile.n),
            n_obs=int(profile.n), n_groups=int(profile.groups.sum()), converged=math.isfinite(score) and ratio < math.exp(_FAR - 1),
        )

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    out = per_size.groupBy(*keys).applyInPandas(fit, f"{schema}, {_REPORT}")
    out = out.withColumn("z_stat", F.when(F.col("std_err") > 0, F.col("coef") / F.col("std_err")))
    out = out.withColumn("p_value", pvalues.normal_two_sided("z_stat"))
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("aic", "bic")}).drop("__all")


# ---- fitted shifts --------------------------------------------------------------


def binomial_newton(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Fitted log odds of the cells, a matrix D with covariance D D' of them, and whether it converged.

    Newton steps as weighted least squares, halved while the deviance grows. A level without hits
    or misses lets its log odds run off; they stop at 30, where the fitted rate is 0 or 1 to 13 digits.
    """

    def deviance(eta: np.ndarray) -> float:
        return float(2 * (n * np.logaddexp(0, eta) - hits * eta).sum())

    eta, before, converged = np.zeros(len(n)), math.inf, False
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-eta))
        w = np.maximum(n * p * (1 - p), 1e-12 * n)
        root = np.sqrt(w)
        step = np.linalg.lstsq(root[:, None] * x, root * (eta - x @ beta + (hits - n * p) / w), rcond=1e-10)[0]
        for _ in range(30):
            eta = np.clip(x @ (beta + step), -30, 30)
            now = deviance(eta)
            if now <= before * (1 + 1e-12) or not math.isfinite(before):
                break
            step = step / 2
        beta = beta + step
        converged = abs(before - now) <= 1e-13 * (abs(now) + 1)
        before = now
        if converged:
            break
    p = 1 / (1 + np.exp(-eta))
    root = np.sqrt(np.maximum(n * p * (1 - p), 1e-300))
    u, values, _ = np.linalg.svd(root[:, None] * x, full_matrices=False)
    u = u[:, values > 1e-10 * values.max()]
    return eta, u / root[:, None], converged


def _dummies(cells: pd.DataFrame, factors: Sequence[str], crossed: Sequence[Sequence[str]]) -> np.ndarray:
    """An intercept, a column for each level but the first, and products for each crossing."""
    one = np.ones((len(cells), 1))
    own = {}
    for c in factors:
        values = cells[c].astype(str)
        own[c] = np.column_stack([one[:, :0], *[(values == v).to_numpy(float) for v in sorted(values.unique())[1:]]])
    blocks = [one, *own.values()]
    for crossing in crossed:
        block = one
        for c in crossing:
            block = (block[:, :, None] * own[c][:, None, :]).reshape(len(cells), -1)
        blocks.append(block)
    return np.concatenate(blocks, axis=1)


def fitted_shifts(
    df: DataFrame,
    by: Sequence[str],
    facets: Sequence[str],
    condition: str,
    hit: Column | str,
    baseline: str,
    crossed: Sequence[Sequence[str]] = (),
    averaged: Sequence[str] = (),
    most_cells: int = 10_000,
) -> DataFrame:
    """Fitted rates of a logistic model and their shifts from the baseline condition.

    Per ``by`` the log odds of ``hit`` are modelled by condition, ``facets`` and ``averaged`` factors and
    their ``crossed`` products (``None`` for all of them). A row for each (facets, condition): fitted
    probability with its delta-method error, the shift of the probability and of the log odds from
    the baseline of the same facets with their errors, z, p and Holm-adjusted p over the facets' conditions.
    ``averaged`` factors are averaged with equal weights on the log-odds scale.

    One aggregation counts hits per cell of the design; Newton steps run on the cells of one ``by``, of
    which more than ``most_cells`` are an error. Rows with a null hit, condition or factor are left
    out. A missing baseline gives null shifts. A cell of no hits or no misses that the model fits
    exactly has a rate of 0 or 1 with error 0.
    """
    factors = [condition, *facets, *averaged]
    products = _all_crossings(factors) if crossed is None else [tuple(c) for c in crossed]
    if any(c not in factors for own in products for c in own):
        raise ValueError("only factors of the model can be crossed")
    value = (F.col(hit) if isinstance(hit, str) else hit).cast("double")
    rows = df.withColumn("__hit", value).na.drop(subset=["__hit", *factors])
    cells = rows.groupBy(*by, *factors).agg(F.sum("__hit").alias("__k"), F.count("*").alias("__n"))
    keys = list(by) or ["__all"]
    if not by:
        cells = cells.withColumn("__all", F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    shown = [*facets, condition]
    numbers = ["fitted", "fitted_se", "log_odds", "log_odds_se", "probability_shift", "probability_shift_se", "log_odds_shift", "log_odds_shift_se"]

    def fit(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        if len(table) > most_cells:
            raise ValueError(f"more than {most_cells} cells in one fit")
        table = table.sort_values(factors).reset_index(drop=True)
        x = _dummies(table, factors, products)
        eta, d, converged = binomial_newton(x, table["__k"].to_numpy(float), table["__n"].to_numpy(float))
        out = table.groupby(shown, sort=True, dropna=False).agg(n=("__n", "sum"), k=("__k", "sum")).reset_index()
        mean = np.zeros((len(out), len(table)))
        place = {tuple(v): i for i, v in enumerate(out[shown].itertuples(index=False, name=None))}
        for j, v in enumerate(table[shown].itertuples(index=False, name=None)):
            mean[place[tuple(v)], j] = 1.0
        mean /= mean.sum(axis=1, keepdims=True)
        eta, d = mean @ eta, mean @ d
        p = 1 / (1 + np.exp(-eta))
        slope = (p * (1 - p))[:, None] * d
        base = [place.get((*v[:-1], baseline)) for v in out[shown].itertuples(index=False, name=None)]
        have = np.array([b is not None for b in base], bool)
        at = np.array([b if b is not None else 0 for b in base])

        def length(rows: np.ndarray) -> np.ndarray:
            return np.sqrt((rows * rows).sum(axis=1))

        found = [p, length(slope), eta, length(d), p - p[at], length(slope - slope[at]), eta - eta[at], length(d - d[at])]
        for k in range(4, 8):
            found[k] = np.where(have, found[k], np.nan)
        out = out.assign(**dict(zip(numbers, found)), observed=out["k"] / out["n"], converged=converged)
        for c, v in zip(keys, key):
            out[c] = v
        return out[[*keys, *shown, "n", "observed", *numbers, "converged"]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, *shown))
    schema += ", n bigint, observed double, " + ", ".join(f"{c} double" for c in numbers) + ", converged boolean"
    out = cells.groupBy(*keys).applyInPandas(fit, schema)
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in numbers[4:]})
    moved = (F.col(condition) != baseline) & (F.col("log_odds_shift_se") > 0)
    out = out.withColumn("z_stat", F.when(moved, F.col("log_odds_shift") / F.col("log_odds_shift_se")))
    out = out.withColumn("p_value", pvalues.normal_two_sided("z_stat"))
    return holm(out, [*keys, *facets], "p_value").drop("__all")


def _all_crossings(factors: Sequence[str]) -> list[tuple[str, ...]]:
    """Every product of two factors or more."""
    out: list[tuple[str, ...]] = [()]
    for c in factors:
        out += [(*own, c) for own in out]
    return [own for own in out if len(own) > 1]
