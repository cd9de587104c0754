"""Tests and regressions over unit tables. Heavy work is aggregation; p-values are
computed on the summary rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clean, pvalues
from ..functions.core import col
from ..sources.shared import materialize
from . import effects, resample
from .ranking import null_safe_join
from .reshape import to_wide


def _t_stat(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n > 1) & (sd > 0), mean / (sd / F.sqrt(n)))


def one_sample(
    df: DataFrame, by: Sequence[str], value: Column | str, single_sd: float | None = None
) -> DataFrame:
    """n, mean, sd, t and two-sided p against 0 over the finite values.

    With one value the sd is ``single_sd`` and there is no t. A group without finite
    values stays, with n = 0.
    """
    x = clean.finite(col(value).cast("double"))
    return _one_sample_of(
        df.groupBy(*by).agg(F.count(x).alias("n_items"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")), single_sd
    )


def _one_sample_of(out: DataFrame, single_sd: float | None) -> DataFrame:
    """:func:`one_sample` from the moments ``n_items, mean, sd`` of the groups."""
    t = _t_stat(F.col("mean"), F.col("sd"), F.col("n_items"))
    if single_sd is not None:
        sd = F.when(F.col("n_items") == 1, F.lit(single_sd)).otherwise(F.col("sd"))
    else:
        sd = F.col("sd")
    out = out.withColumn("t_stat", t).withColumn("sd", sd)
    return out.withColumn("p_value", pvalues.t_two_sided("t_stat", F.col("n_items") - 1))


def paired_tests(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    measures: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    condition: str = "prime_condition",
) -> DataFrame:
    """Paired t per group, measure and condition pair; pairs without data have n_pairs = 0.

    Means per (unit, condition) in one aggregation, then the differences of all pairs
    side by side in a second.
    """
    levels = list(dict.fromkeys(c for pair in pairs for c in pair))
    wide = to_wide(df, [*by, unit], condition, measures, levels)
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                *[F.col(f"{m}_{c}").alias(f"v_{c}") for c in levels],
            )
            for m in measures
        ]
    )
    rows = wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    aggs = []
    for i, (a, b) in enumerate(pairs):
        diff = F.col(f"v_{a}") - F.col(f"v_{b}")
        aggs.append(
            F.struct(
                F.lit(a).alias("condition_a"),
                F.lit(b).alias("condition_b"),
                F.count(diff).alias("n_pairs"),
                F.avg(diff).alias("mean_diff_a_minus_b"),
                F.stddev_samp(diff).alias("sd"),
            ).alias(f"p{i}")
        )
    grouped = rows.groupBy(*by, "measure").agg(*aggs)
    flat = grouped.select(
        *by, "measure", F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")
    ).select(*by, "measure", "p.*")
    t = _t_stat(F.col("mean_diff_a_minus_b"), F.col("sd"), F.col("n_pairs"))
    return (
        flat.withColumn("t_stat", t)
        .withColumn("p_value", pvalues.t_two_sided("t_stat", F.col("n_pairs") - 1))
        .drop("sd")
    )


def _test_block(
    diffs: DataFrame,
    by: Sequence[str],
    unit: str,
    measures: Sequence[str],
    n_resamples: int,
    seed: int,
    correction: bool,
    zero_dz: bool,
    n_bootstrap: int | None = None,
    empty: bool = False,
) -> DataFrame:
    """Moments, t, sign-flip p and bootstrap interval per group; the interval has ``n_bootstrap`` draws,
    or as many as the test.

    ``diffs`` is an array with an entry for each measure, so that a unit is one row, not one per measure;
    ``by`` calls the measures ``metric``. They share their draws. ``empty`` keeps groups without any value.
    """
    common = [c for c in ("metric", "summary_group") if c in by]
    rest = [c for c in by if c != "metric"]
    x = F.col("__x")
    own = clean.finite(x)
    found = diffs.select(*rest, F.posexplode("diffs").alias("__i", "__x")).groupBy(*rest, "__i").agg(
        F.count(own).alias("n_items"), F.avg(own).alias("mean"), F.stddev_samp(own).alias("sd"),
        F.count(x).alias("__n"), F.avg(x).alias("__mean"),
    )
    found = found.withColumn("metric", F.get(F.array(*[F.lit(m) for m in measures]), "__i")).drop("__i")
    # a few rows, which three statistics read
    found = materialize(found, "moments")
    some = found.where("__n > 0")
    base = _one_sample_of((found if empty else some).select(*by, "n_items", "mean", "sd"), 0.0 if zero_dz else None)
    dz = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd"))
    if zero_dz:
        dz = F.coalesce(dz, F.lit(0.0))
    base = base.withColumn("effect_size_dz", dz)
    observed = some.select(*by, F.col("__n").alias("n"), F.col("__mean").alias("mean"))
    perm = resample.sign_flip_p(
        diffs, by, unit, "diffs", n_resamples, seed, correction=correction, common=common, measures=measures, observed=observed
    ).select(*by, F.col("p_value").alias("perm_p_two_sided"))
    boot = resample.bootstrap_ci(
        diffs, by, unit, "diffs", n_bootstrap or n_resamples, 95.0, seed, common=common, measures=measures, observed=observed
    ).select(
        *by,
        F.col("ci_low").alias("bootstrap_ci95_low"),
        F.col("ci_high").alias("bootstrap_ci95_high"),
    )
    out = null_safe_join(base, perm, list(by))
    return null_safe_join(out, boot, list(by))


def pairwise_stats(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    metrics: Mapping[str, str],
    order: Sequence[str],
    condition: str = "prime_condition",
    n_resamples: int = 10_000,
    seed: int = 13,
    correction: bool = False,
) -> DataFrame:
    """Every ordered condition pair (b - a) and metric: n, mean, sd, dz, t, p, sign-flip p,
    bootstrap interval."""
    pairs = [(b, a) for i, a in enumerate(order) for b in order[i + 1 :]]
    diffs = effects.pair_differences(df, by, unit, metrics, pairs, condition, gather=True)
    diffs = diffs.select(
        *by, unit, F.col("condition_b").alias("condition_a"), F.col("condition_a").alias("condition_b"), "diffs"
    )
    keys = [*by, "metric", "condition_a", "condition_b"]
    return _test_block(
        materialize(diffs, "differences"), keys, unit, list(metrics.values()), n_resamples, seed, correction, zero_dz=True
    )


def paired_metric_tests(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    metrics: Sequence[str],
    structure: str = "target_structure",
    n_resamples: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Passive minus active target per unit and metric, tested per group."""
    diffs = effects.pair_differences(
        df, by, unit, {m: m for m in metrics}, [("passive", "active")], structure, gather=True
    ).drop("condition_a", "condition_b")
    return _test_block(
        materialize(diffs, "differences"), [*by, "metric"], unit, metrics, n_resamples, seed, correction=True, zero_dz=False
    )


def mcnemar(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    condition_a: str,
    condition_b: str,
    condition: str = "prime_condition",
    chosen: str = "chosen_structure",
) -> DataFrame:
    """Discordant choice counts b, c of two conditions and the exact binomial p."""
    cond = F.col(condition)
    wide = df.groupBy(*by, unit).agg(
        F.max(F.when(cond == condition_a, F.col(chosen))).alias("__a"),
        F.max(F.when(cond == condition_b, F.col(chosen))).alias("__b"),
    )
    a, b = F.col("__a"), F.col("__b")
    out = wide.groupBy(*by).agg(
        F.count_if((a == "active") & (b == "passive")).alias("mcnemar_b"),
        F.count_if((a == "passive") & (b == "active")).alias("mcnemar_c"),
    )
    n = F.col("mcnemar_b") + F.col("mcnemar_c")
    tail = pvalues.binomial_at_most(F.least("mcnemar_b", "mcnemar_c"), n)
    return out.withColumn("mcnemar_p_exact", F.least(F.lit(1.0), 2 * tail))


def binom_test(df: DataFrame, x: str, n: str) -> DataFrame:
    """One-sided (less) binomial p of x out of n against 1/2."""
    return df.withColumn("p_less", pvalues.binomial_at_most(x, n))


def exact_rate_ci(df: DataFrame, x: str, n: str) -> DataFrame:
    out = df.withColumn("__ci", pvalues.exact_rate_interval(x, n))
    return out.withColumns(
        {"rate": F.try_divide(F.col(x), F.col(n)), "ci_low": F.col("__ci.low"), "ci_high": F.col("__ci.high")}
    ).drop("__ci")


def summarize_effects(
    df: DataFrame,
    sets: Mapping[str, Sequence[str]],
    unit: str,
    metrics: Sequence[str],
    n_resamples: int = 10_000,
    seed: int = 13,
    n_bootstrap: int | None = None,
) -> DataFrame:
    """n, mean, sd, interval and p-values per metric for several groupings.

    A row is copied once per grouping and holds its metrics as an array; everything after
    that is one aggregation per statistic. The units' metrics are written to the shared folder first:
    three statistics read them, and the optimiser need not carry the constraints of many
    differences of the same columns through the copies.
    """
    keys = list(dict.fromkeys(k for columns in sets.values() for k in columns))
    metrics = [m for m in metrics if m in df.columns]
    df = materialize(df.select(*dict.fromkeys([unit, *keys, *metrics])), "effects")
    grids = F.array(
        *[
            F.struct(
                F.lit(name).alias("summary_group"),
                *[
                    (F.col(k) if k in columns else F.lit(None).cast(df.schema[k].dataType)).alias(k)
                    for k in keys
                ],
            )
            for name, columns in sets.items()
        ]
    )
    values = F.array(*[clean.finite(m) for m in metrics]).alias("diffs")
    rows = df.select(F.col(unit).alias("__u"), values, F.explode(grids).alias("g")).select("__u", "g.*", "diffs")
    by = ["summary_group", *keys, "metric"]
    return _test_block(
        rows, by, "__u", metrics, n_resamples, seed, correction=False, zero_dz=True, n_bootstrap=n_bootstrap, empty=True
    )


# ---- regression -------------------------------------------------------------


def _cross_sums(terms: Sequence[str], weight: Column | None = None) -> list[Column]:
    out = []
    for i, a in enumerate(terms):
        for b in terms[i:]:
            product = F.col(a) * F.col(b)
            out.append(F.sum(product if weight is None else product * weight))
    return out


def _symmetric(flat: np.ndarray, p: int) -> np.ndarray:
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = flat
    return full + np.triu(full, 1).T


def _inverse(xx: np.ndarray) -> tuple[np.ndarray, int]:
    """Generalised inverse of a cross-product matrix and its rank.

    Terms are first brought to one scale, so that a small column is not taken for a
    redundant one.
    """
    scale = np.sqrt(np.diag(xx))
    scale = np.where(scale > 0, scale, 1.0)
    scaled = xx / np.outer(scale, scale)
    values = np.linalg.eigvalsh(scaled)
    rank = int((values > 1e-10 * max(values.max(), 1e-300)).sum())
    inverse = np.linalg.inv(scaled) if rank == len(xx) else np.linalg.pinv(scaled, rcond=1e-10, hermitian=True)
    return inverse / np.outer(scale, scale), rank


def design(
    df: DataFrame,
    factors: Sequence[str] = (),
    numeric: Sequence[str] = (),
    interactions: Sequence[tuple[str, str]] = (),
    most_levels: int = 100,
) -> dict[str, Column]:
    """Terms for :func:`ols` and :func:`ols_hc3`: an intercept, a column per factor level but the
    first, the numbers, and products for each interaction of two of them.

    The levels of each factor come from one aggregation; more than ``most_levels`` are an error.
    """
    parts: dict[str, dict[str, Column]] = {c: {c: F.col(c).cast("double")} for c in numeric}
    for c in factors:
        found = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
        levels = sorted(r.v for r in found.limit(most_levels + 1).collect())
        if len(levels) > most_levels:
            raise ValueError(f"{c} has more than {most_levels} levels")
        parts[c] = {f"{c}[{v}]": (F.col(c).cast("string") == v).cast("double") for v in levels[1:]}
    terms: dict[str, Column] = {"Intercept": F.lit(1.0)}
    for c in (*factors, *numeric):
        terms |= parts[c]
    for a, b in interactions:
        terms |= {f"{m}:{n}": x * z for m, x in parts[a].items() for n, z in parts[b].items()}
    return terms


def _fit(df: DataFrame, y: str, terms: Sequence[str]) -> DataFrame:
    """One row: coefficients, inverse cross-product matrix, rows, rank, residual sum of squares.

    Redundant terms share their effect by the generalised inverse; the rank tells of them.

    Everything the fit needs from the data is the p x p cross-product table, summed in
    one aggregation; only that row is solved.
    """
    p = len(terms)
    sums = df.agg(
        F.array(*_cross_sums(terms)).alias("xx"),
        F.array(*[F.sum(F.col(t) * F.col(y)) for t in terms]).alias("xy"),
        F.sum(F.col(y) * F.col(y)).alias("yy"),
        F.count("*").alias("n"),
    )

    def solve(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                xy = np.asarray(row.xy, dtype=float)
                inverse, rank = _inverse(_symmetric(np.asarray(row.xx, dtype=float), p))
                beta = inverse @ xy
                yield pd.DataFrame(
                    {
                        "beta": [beta.tolist()],
                        "inverse": [inverse.ravel().tolist()],
                        "n": [int(row.n)],
                        "rank": [rank],
                        "rss": [float(row.yy - beta @ xy)],
                    }
                )

    return sums.mapInPandas(
        solve, "beta array<double>, inverse array<double>, n bigint, rank bigint, rss double"
    )


def _design(df: DataFrame, y: str, terms: Mapping[str, Column]) -> tuple[DataFrame, list[str]]:
    names = [f"x{i}" for i in range(len(terms))]
    columns = [c.cast("double").alias(n) for n, c in zip(names, terms.values())]
    rows = df.select(F.col(y).cast("double").alias("y"), *columns)
    return rows.na.drop(), names


def ols(df: DataFrame, y: str, terms: Mapping[str, Column]) -> DataFrame:
    """Least squares on hand-made terms: term, coefficient, classical error, t, p."""
    rows, names = _design(df, y, terms)
    p, labels = len(names), list(terms)

    def report(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                inverse = np.asarray(row.inverse, dtype=float).reshape(p, p)
                free = max(int(row.n) - int(row.rank), 1)
                se = np.sqrt(np.maximum(np.diag(inverse) * max(row.rss, 0.0) / free, 0.0))
                beta = np.asarray(row.beta, dtype=float)
                yield pd.DataFrame(
                    {"term": labels, "coef": beta, "std_err": se, "df_resid": free}
                )

    out = _fit(rows, "y", names).mapInPandas(
        report, "term string, coef double, std_err double, df_resid bigint"
    )
    out = out.withColumn("t_stat", F.when(F.col("std_err") > 0, F.col("coef") / F.col("std_err")))
    return out.withColumn("p_value", pvalues.t_two_sided("t_stat", "df_resid"))


def ols_hc3(df: DataFrame, y: str, terms: Mapping[str, Column]) -> DataFrame:
    """Least squares with HC3 errors: term, coefficient, error, 95% interval, z, p.

    Leverage and the weighted cross products come from a second aggregation that reads the
    solved p x p matrix as a scalar subquery. A row with leverage 1 is fitted exactly and
    adds nothing to the errors.
    """
    rows, names = _design(df, y, terms)
    p, labels = len(names), list(terms)
    fit = _fit(rows, "y", names)
    solved = fit.select(F.struct("beta", "inverse").alias("s")).scalar()
    x = F.array(*names)
    work = rows.withColumns({"__s": solved, "__x": x})

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    products = F.transform(
        F.sequence(F.lit(0), F.lit(p - 1)),
        lambda i: dot(F.slice(F.col("__s.inverse"), i * p + 1, p), F.col("__x")),
    )
    leverage = dot(F.col("__x"), products)
    residual = F.col("y") - dot(F.col("__x"), F.col("__s.beta"))
    own = F.greatest(1 - leverage, F.lit(0.0))
    weighted = work.withColumn("__w", F.when(own > 1e-10, F.pow(residual / own, F.lit(2))).otherwise(0.0))
    meat = weighted.agg(
        F.array(*_cross_sums(names, F.col("__w"))).alias("meat"), F.first("__s").alias("s")
    ).select("meat", "s.beta", "s.inverse")

    def report(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                inverse = np.asarray(row.inverse, dtype=float).reshape(p, p)
                middle = _symmetric(np.asarray(row.meat, dtype=float), p)
                cov = inverse @ middle @ inverse
                yield pd.DataFrame(
                    {
                        "term": labels,
                        "coef": np.asarray(row.beta, dtype=float),
                        "std_err": np.sqrt(np.maximum(np.diag(cov), 0.0)),
                    }
                )

    out = meat.mapInPandas(report, "term string, coef double, std_err double")
    reach = F.lit(1.959963984540054) * F.col("std_err")
    out = out.withColumns({"ci95_low": F.col("coef") - reach, "ci95_high": F.col("coef") + reach})
    out = out.withColumn("z_stat", F.when(F.col("std_err") > 0, F.col("coef") / F.col("std_err")))
    return out.withColumn("p_value", pvalues.normal_two_sided("z_stat"))


def binomial_glm(
    cells: DataFrame, correct: str, total: str, terms: Mapping[str, Column]
) -> DataFrame:
    """Logistic regression on correct/total cells; only the fitted coefficients (one per
    term) come to the driver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    names = [f"x{i}" for i in range(len(terms))]
    rows = cells.where(F.col(total) > 0).select(
        (F.col(correct) / F.col(total)).alias("rate"),
        F.col(total).cast("double").alias("total"),
        *[c.cast("double").alias(n) for n, c in zip(names, terms.values())],
    )
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="rate", weightCol="total", tol=1e-10, maxIter=50
    ).fit(data)
    values = [("(Intercept)", float(model.intercept))]
    values += list(zip(terms, (float(v) for v in model.coefficients)))
    return cells.sparkSession.createDataFrame(values, "term string, coef double")


# ---- contrasts --------------------------------------------------------------


def holm(df: DataFrame, by: Sequence[str], p: str, name: str = "p_holm") -> DataFrame:
    """Holm-adjusted p-values inside each family of tests; a null p is no test."""
    family = W.partitionBy(*by)
    ordered = family.orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(family)
    step = F.col(p) * (m - F.row_number().over(ordered) + 1)
    up = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    adjusted = F.least(F.lit(1.0), F.max("__step").over(up))
    return df.withColumn("__step", step).withColumn(
        name, F.when(F.col(p).isNotNull(), adjusted)
    ).drop("__step")


def contrast_holm(
    df: DataFrame,
    by: Sequence[str],
    level: Column | str,
    value: Column | str,
    contrasts: Mapping[str, Mapping[str, float]],
) -> DataFrame:
    """Weighted sums of cell means per group: estimate, error, z, p and Holm-adjusted p."""
    here, x = col(level), col(value).cast("double")
    levels = list(dict.fromkeys(k for w in contrasts.values() for k in w))
    aggs = []
    for i, name in enumerate(levels):
        cell = F.when(here == name, x)
        aggs += [
            F.avg(cell).alias(f"m{i}"),
            (F.var_samp(cell) / F.count(cell)).alias(f"v{i}"),
        ]
    means = df.groupBy(*by).agg(*aggs)
    cells = []
    for name, weights in contrasts.items():
        estimate, variance = F.lit(0.0), F.lit(0.0)
        for k, w in weights.items():
            i = levels.index(k)
            estimate = estimate + F.lit(float(w)) * F.col(f"m{i}")
            variance = variance + F.lit(float(w) ** 2) * F.col(f"v{i}")
        cells.append(
            F.struct(
                F.lit(name).alias("contrast"),
                estimate.alias("estimate"),
                F.sqrt(variance).alias("std_err"),
            )
        )
    out = means.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")
    out = out.withColumn("z_stat", F.when(F.col("std_err") > 0, F.col("estimate") / F.col("std_err")))
    out = out.withColumn("p_value", pvalues.normal_two_sided("z_stat"))
    return holm(out, by, "p_value")
