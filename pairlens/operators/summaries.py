"""Group summaries. Every operator is one hash aggregation with map-side partial results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clean, fixed
from ..functions.core import col


def _se(column: Column | str, n: Column | None = None) -> Column:
    column = col(column)
    return F.stddev_samp(column) / F.sqrt(F.count(column) if n is None else n)


def summarize(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows, mean, sd (ddof 1) and standard error per measure; null keys are groups too.

    ``n_rows`` counts rows, and the error divides by it, also where a value is null.
    """
    rows = F.count(F.lit(1))
    aggs = [rows.alias("n_rows")]
    for v in values:
        aggs += [
            F.avg(v).alias(f"{v}_mean"),
            F.stddev_samp(v).alias(f"{v}_std"),
            _se(v, rows).alias(f"{v}_se"),
        ]
    return df.groupBy(*by).agg(*aggs)


def summarize_measures(
    df: DataFrame, by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """One row per group and measure; here n counts the non-null values.

    All measures are aggregated side by side and unpivoted afterwards, so the rows are
    scanned and shuffled once, not once per measure.
    """
    aggs = [
        F.struct(
            F.lit(m).alias("measure"),
            F.count(m).alias("n_rows"),
            F.avg(F.col(m).cast("double")).alias("mean"),
            F.stddev_samp(m).alias("std"),
            _se(m).alias("se"),
        ).alias(f"m{i}")
        for i, m in enumerate(measures)
    ]
    wide = df.groupBy(*by).agg(*aggs)
    cells = F.explode(F.array(*[F.col(f"m{i}") for i in range(len(measures))])).alias("m")
    return wide.select(*by, cells).select(*by, "m.*")


def standard_summaries(
    df: DataFrame, sets: Mapping[str, Sequence[str]], values: Sequence[str]
) -> DataFrame:
    """Several roll-ups at once, told apart by ``summary``.

    Rows are reduced to counts, means and squared deviations at the finest grain; the
    roll-ups merge those, so the wide data is read and shuffled once.
    """
    keys = list(dict.fromkeys(k for columns in sets.values() for k in columns))
    fine_aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, v in enumerate(values):
        fine_aggs += [
            F.count(v).alias(f"__n{i}"),
            F.avg(v).alias(f"__m{i}"),
            F.var_pop(v).alias(f"__v{i}"),
        ]
    fine = df.groupBy(*keys).agg(*fine_aggs)
    grids = F.array(
        *[
            F.struct(
                F.lit(name).alias("summary"),
                *[
                    (F.col(k) if k in columns else F.lit(None).cast(df.schema[k].dataType)).alias(k)
                    for k in keys
                ],
            )
            for name, columns in sets.items()
        ]
    )
    spread = fine.select(
        F.explode(grids).alias("g"), *[c for c in fine.columns if c.startswith("__")]
    ).select("g.*", *[c for c in fine.columns if c.startswith("__")])
    # Squares about one common point per value, close to all means, so that the groups'
    # sums form in partial aggregations and little is lost in the last difference.
    aggs = [F.sum("__rows").alias("n_rows")]
    for i, v in enumerate(values):
        shift = df.agg(F.coalesce(F.avg(v), F.lit(0.0))).scalar()
        rows, mean, own = F.col(f"__n{i}"), F.col(f"__m{i}"), F.col(f"__v{i}")
        n = F.sum(rows)
        off = F.try_divide(F.sum(rows * (mean - shift)), n)
        squares = F.sum(rows * (own + F.pow(mean - shift, F.lit(2)))) - n * off * off
        sd = F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1)))
        aggs += [
            (off + shift).alias(f"{v}_mean"),
            sd.alias(f"{v}_std"),
            (sd / F.sqrt(F.sum("__rows"))).alias(f"{v}_se"),
        ]
    return spread.groupBy("summary", *keys).agg(*aggs)


def conditional_mean(value: Column | str, condition: Column) -> Column:
    return F.avg(F.when(condition, col(value)))


def accuracy_summary(df: DataFrame, by: Sequence[str], label: str = "matched_label") -> DataFrame:
    """n, mean correct, and the counts of the four answer labels."""
    correct = F.avg((F.col(label) == "correct").cast("int"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        correct.alias("accuracy"),
        *[
            F.count_if(F.col(label) == x).alias(f"{x}_n")
            for x in ("correct", "foil", "ambiguous", "other")
        ],
    )


_DIFFERENCES = {
    "priming_active_minus_passive": ("active", "passive"),
    "active_minus_no_prime": ("active", "no_prime"),
    "passive_minus_no_prime": ("passive", "no_prime"),
    "active_minus_filler": ("active", "filler"),
    "passive_minus_filler": ("passive", "filler"),
}


def baseline_vs_primed(
    df: DataFrame,
    by: Sequence[str],
    condition: str = "prime_condition",
    voice: str = "target_voice",
    label: str = "matched_label",
) -> DataFrame:
    """Accuracy per condition, five differences, voice-specific baselines and foil rates."""
    cond, v = F.col(condition), F.col(voice)
    correct = (F.col(label) == "correct").cast("int")
    foil = (F.col(label) == "foil").cast("int")
    names = {"active": "active_prime", "passive": "passive_prime", "filler": "filler",
             "no_prime": "no_prime"}
    aggs = [F.count("*").alias("n_items")]
    aggs += [conditional_mean(correct, cond == c).alias(f"accuracy_{n}") for c, n in names.items()]
    for base in ("no_prime", "filler"):
        for target in ("active", "passive"):
            rows = (cond == base) & (v == target)
            aggs.append(conditional_mean(correct, rows).alias(f"accuracy_{base}_{target}_target"))
        rows = (cond == base) & (v == "passive")
        aggs.append(conditional_mean(foil, rows).alias(f"foil_rate_{base}_passive_target"))
    out = df.groupBy(*by).agg(*aggs)
    extra = {
        name: F.col(f"accuracy_{names[a]}") - F.col(f"accuracy_{names[b]}")
        for name, (a, b) in _DIFFERENCES.items()
    }
    for base in ("no_prime", "filler"):
        extra[f"baseline_{base}_passive_minus_active"] = F.col(
            f"accuracy_{base}_passive_target"
        ) - F.col(f"accuracy_{base}_active_target")
    return out.withColumns(extra)


def ceiling_diagnostics(df: DataFrame, by: Sequence[str], threshold: float = 0.95) -> DataFrame:
    return accuracy_summary(df, by).withColumns(clean.ceiling_flag("accuracy", threshold))


def label_shares(
    df: DataFrame,
    label: str,
    by: Sequence[str] = ("prompt_column", "prime_condition"),
) -> DataFrame:
    """Count per label and its share of the group; the group total is a window over the counts."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n_items"))
    total = F.sum("n_items").over(W.partitionBy(*by))
    return counts.withColumn("total_items", total).withColumn(
        "share", F.col("n_items") / F.col("total_items")
    )


def order_by_levels(df: DataFrame, levels: Mapping[str, Sequence[str]], *then: str) -> DataFrame:
    """Sort by category order, unknown values last."""
    return df.orderBy(*[clean.level_rank(c, order) for c, order in levels.items()], *then)


def class_rates(
    df: DataFrame,
    label: str,
    by: Sequence[str] = ("prompt_column", "prime_condition"),
    condition: str = "prime_condition",
    reviewed: str | None = None,
) -> DataFrame | None:
    """active / passive / other / congruent rates, and the reviewed rate.

    None when a grouping column is absent.
    """
    if any(c not in df.columns for c in by):
        return None
    flags = clean.class_indicators(label, condition=condition)
    aggs = [F.count("*").alias("n_items")]
    aggs += [F.avg(flag).alias(f"{name[3:]}_rate") for name, flag in flags.items()]
    if reviewed:
        aggs.append(F.avg(F.col(reviewed).cast("int")).alias("reviewed_rate"))
    return df.groupBy(*by).agg(*aggs)


def quality_rates(
    df: DataFrame,
    label: str,
    by: Sequence[str] = ("prompt_column", "prime_condition"),
    condition: str = "prime_condition",
) -> DataFrame:
    flags = clean.quality_indicators(label, condition)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        *[F.avg(flag).alias(f"{name[3:]}_rate") for name, flag in flags.items()],
    )


def choice_summary(
    df: DataFrame,
    by: Sequence[str],
    chosen: str = "chosen_structure",
    measures: Sequence[str] = ("passive_minus_active_logprob",),
) -> DataFrame:
    """n, choices and rates; mean and sd of each measure (sd of one row is 0)."""
    n = F.count("*")
    aggs = [n.alias("n_items")]
    for voice in ("active", "passive"):
        picked = F.count_if(F.col(chosen) == voice)
        aggs += [picked.alias(f"n_{voice}_choice"), (picked / n).alias(f"{voice}_choice_rate")]
    for m in measures:
        sd = F.when(n > 1, F.stddev_samp(m)).otherwise(0.0)
        aggs += [F.avg(m).alias(f"mean_{m}"), sd.alias(f"sd_{m}")]
    return df.groupBy(*by).agg(*aggs)


def condition_contrasts(
    summary: DataFrame,
    by: Sequence[str],
    condition: str,
    order: Sequence[str],
    values: Mapping[str, str],
) -> DataFrame:
    """Every ordered pair of conditions of a summary: both values and b - a.

    The conditions of a group are few, so they are gathered into one array and the
    pairs are made inside the row; no self join.
    """
    rank = clean.level_rank(condition, order)
    cells = F.struct(
        rank.alias("rank"), F.col(condition).alias("name"), *[F.col(v).alias(v) for v in values.values()]
    )
    known = summary.where(rank < len(order))
    cell = known.groupBy(*by).agg(F.array_sort(F.collect_list(cells)).alias("cells"))
    pairs = (
        cell.select(*by, "cells", F.explode("cells").alias("a"))
        .select(*by, "a", F.explode("cells").alias("b"))
        .where(F.col("b.rank") > F.col("a.rank"))
    )
    out = [F.col("a.name").alias("condition_a"), F.col("b.name").alias("condition_b")]
    for label, v in values.items():
        a, b = F.col(f"a.{v}"), F.col(f"b.{v}")
        out += [
            a.alias(f"{label}_a"),
            b.alias(f"{label}_b"),
            (b - a).alias(f"{label}_diff_b_minus_a"),
        ]
    return pairs.select(*by, *out)


def priming_effects_all(
    df: DataFrame,
    by: Sequence[str],
    measures: Sequence[str],
    condition: str = "prime_condition",
) -> DataFrame:
    """Condition means and five differences per group and measure, in one aggregation."""
    cells = []
    for i, m in enumerate(measures):
        cells.append(
            F.struct(
                F.lit(m).alias("measure"),
                *[
                    conditional_mean(m, F.col(condition) == c).alias(f"{c}_mean")
                    for c in fixed.CONDITIONS
                ],
            ).alias(f"m{i}")
        )
    wide = df.groupBy(*by).agg(*cells)
    long = wide.select(
        *by, F.explode(F.array(*[F.col(f"m{i}") for i in range(len(measures))])).alias("m")
    ).select(*by, "m.*")
    names = dict(_DIFFERENCES)
    names = {
        ("priming_effect_active_minus_passive" if k.startswith("priming") else k): v
        for k, v in names.items()
    }
    return long.withColumns(
        {k: F.col(f"{a}_mean") - F.col(f"{b}_mean") for k, (a, b) in names.items()}
    )


def priming_effects(
    df: DataFrame, by: Sequence[str], measure: str, condition: str = "prime_condition"
) -> DataFrame:
    return priming_effects_all(df, by, [measure], condition).drop("measure")


def mean_sd(columns: Sequence[str]) -> list[Column]:
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    return out


ITEM_MEASURES = (
    "sentence_pe",
    "sentence_pe_mean",
    "critical_word_pe",
    "critical_word_pe_mean",
    "post_divergence_pe",
    "post_divergence_pe_mean",
    "pre_divergence_pe",
    "structure_region_pe",
    "structure_region_pe_mean",
)


def summarize_items(
    df: DataFrame,
    by: Sequence[str] = ("condition", "target_structure"),
    measures: Sequence[str] = ITEM_MEASURES,
) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_items"), *mean_sd(measures))


def summarize_tokens(
    df: DataFrame, by: Sequence[str] = ("condition", "target_structure", "token_index")
) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        *mean_sd(["token_pe"]),
        F.avg("congruent_log_prob").alias("mean_congruent_log_prob"),
        F.avg("incongruent_log_prob").alias("mean_incongruent_log_prob"),
        F.avg(F.col("is_post_divergence").cast("int")).alias("post_divergence_rate"),
        F.avg(F.col("is_structure_region").cast("int")).alias("structure_region_rate"),
    )


def tokens_to_words(
    df: DataFrame,
    keys: Sequence[str] = ("condition", "target_structure", "item_index", "target_text"),
) -> DataFrame:
    """Token rows to word rows: count, sum, mean, any critical; the word by its position."""
    word = F.get(F.split(F.col("target_text"), " "), F.col("word_index").cast("int"))
    return (
        df.groupBy(*keys, "word_index")
        .agg(
            F.count("*").alias("token_count"),
            F.sum("token_pe").alias("word_pe"),
            F.avg("token_pe").alias("word_pe_mean"),
            F.bool_or("is_critical_word").alias("is_critical_word"),
        )
        .withColumn("word", word)
    )


def summarize_words(
    df: DataFrame, by: Sequence[str] = ("condition", "target_structure", "word_index")
) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.min_by("word", "item_index").alias("word"),
        *mean_sd(["word_pe", "word_pe_mean"]),
        F.avg(F.col("is_critical_word").cast("int")).alias("critical_word_rate"),
    )


def region_report(
    df: DataFrame,
    by: Sequence[str] = ("condition", "target_structure"),
    measures: Sequence[str] = (
        "sentence_pe", "sentence_pe_mean", "critical_word_pe", "critical_word_pe_mean",
        "post_divergence_pe", "post_divergence_pe_mean", "structure_region_pe",
        "structure_region_pe_mean",
    ),
) -> DataFrame:
    """Mean and standard error per measure; the error of one row is 0."""
    aggs = [F.count("*").alias("n_items")]
    for m in measures:
        aggs += [
            F.avg(m).alias(f"{m}_avg"),
            F.coalesce(_se(m), F.lit(0.0)).alias(f"{m}_se"),
        ]
    return df.groupBy(*by).agg(*aggs)


def roi_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum and mean of log-prob and surprisal per region; absent keys are left out."""
    by = [k for k in keys if k in df.columns]
    return df.groupBy(*by).agg(
        F.sum("token_logprob").alias("roi_logprob_sum"),
        F.avg("token_logprob").alias("roi_logprob_mean"),
        F.sum("token_surprisal").alias("roi_surprisal_sum"),
        F.avg("token_surprisal").alias("roi_surprisal_mean"),
        F.count("*").alias("roi_token_count"),
    )


def roi_profile(
    df: DataFrame, item: Sequence[str], by: Sequence[str], value: str = "token_logprob"
) -> DataFrame:
    """Mean per item first, then mean and error over items, so long items do not weigh more."""
    items = df.groupBy(*item, *by).agg(F.avg(value).alias("__item"))
    return items.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.avg("__item").alias("mean_logprob"),
        _se("__item", F.count("*")).alias("se"),
    )


def generation_bias(df: DataFrame, keys: Sequence[str], voice: str, strict: str) -> DataFrame:
    """Counts per item, rates (null where nothing is counted) and smoothed log-odds."""
    by = [k for k in keys if k in df.columns]
    aggs = [F.count("*").alias("n_outputs")]
    for name, column in (("lax", voice), ("strict", strict)):
        aggs += [
            F.count_if(F.col(column) == c).alias(f"n_{c}_{name}")
            for c in ("active", "passive", "other")
        ]
    out = df.groupBy(*by).agg(*aggs)
    known = F.col("n_active_lax") + F.col("n_passive_lax")
    rates = {
        f"{c}_rate_all_lax": F.try_divide(F.col(f"n_{c}_lax"), F.col("n_outputs"))
        for c in ("active", "passive", "other")
    }
    rates |= {
        f"{c}_rate_classifiable_lax": F.try_divide(F.col(f"n_{c}_lax"), known)
        for c in ("active", "passive")
    }
    return out.withColumns(
        {
            "n_classifiable_lax": known,
            **rates,
            "passive_vs_active_logodds_lax": clean.smoothed_logodds(
                "n_passive_lax", "n_active_lax"
            ),
            "passive_vs_nonpassive_logodds_lax": clean.smoothed_logodds(
                "n_passive_lax", F.col("n_active_lax") + F.col("n_other_lax")
            ),
        }
    )


def generation_bias_by_verb(bias: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = [k for k in keys if k in bias.columns]
    means = (
        "passive_rate_all_lax",
        "passive_rate_classifiable_lax",
        "passive_vs_active_logodds_lax",
        "passive_vs_nonpassive_logodds_lax",
    )
    return bias.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        *[
            F.sum(c).alias(c)
            for c in ("n_outputs", "n_active_lax", "n_passive_lax", "n_other_lax")
        ],
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )


def scored_bias_by_verb(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size (nulls counted), mean and sd of the log-odds, mean sum and token difference."""
    by = [k for k in keys if k in df.columns]
    return df.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.avg("logodds_passive").alias("mean_logodds_passive"),
        F.stddev_samp("logodds_passive").alias("sd_logodds_passive"),
        F.avg("logodds_passive_sum").alias("mean_logodds_passive_sum"),
        F.avg("token_count_diff").alias("mean_token_count_diff"),
    )


def means_summary(
    df: DataFrame, by: Sequence[str], means: Mapping[str, Column | str]
) -> DataFrame:
    """n and the mean of each named column (booleans as 0/1)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        *[F.avg(col(c).cast("double")).alias(name) for name, c in means.items()],
    )


def prime_surprisal_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return means_summary(
        df,
        by,
        {
            "prime_surprisal_mean": "prime_surprisal_mean",
            "prime_surprisal_sum": "prime_surprisal_sum",
            "prime_token_count": "prime_token_count",
            "match_rate": F.col("prime_sentence_matches_column").cast("int"),
        },
    )


CATEGORY_MEASURES = (
    "actual_token_logprob",
    "actual_token_surprisal",
    "target_category_probability",
    "target_category_surprisal",
    "category_entropy",
    "category_effective_n",
    "within_category_probability",
    "within_category_surprisal",
    "within_category_entropy",
    "within_category_effective_n",
    "word_surprisal_sum",
)


def category_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Twelve means per region and category; NaN counts as missing."""
    means: dict[str, Column] = {f"{m}_mean": F.nanvl(F.col(m), F.lit(None)) for m in CATEGORY_MEASURES}
    means["target_token_in_category_set_rate"] = F.col("target_token_in_category_set").cast("int")
    return means_summary(df, by, means)


def similarity_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_words"),
        F.avg("max_cosine").alias("mean_max_cosine"),
        F.max("max_cosine").alias("max_max_cosine"),
        F.avg("mean_topk_cosine").alias("mean_topk_cosine"),
    )


def balance_table(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Rows per combination; None when a column is absent."""
    if any(c not in df.columns for c in columns):
        return None
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def balance_tables(df: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several balance tables from one aggregation at the finest grain."""
    keys = list(dict.fromkeys(k for columns in sets.values() for k in columns))
    fine = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    grids = F.array(
        *[
            F.struct(
                F.lit(name).alias("table_name"),
                *[
                    (F.col(k) if k in columns else F.lit(None).cast(df.schema[k].dataType)).alias(k)
                    for k in keys
                ],
            )
            for name, columns in sets.items()
        ]
    )
    return (
        fine.select(F.explode(grids).alias("g"), "__n")
        .select("g.*", "__n")
        .groupBy("table_name", *keys)
        .agg(F.sum("__n").alias("n"))
    )


def missing_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    value = F.col(column)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(value.isNull()).alias("n_missing"),
        F.avg(value.cast("double")).alias("mean"),
    )


def binomial_cells(df: DataFrame, by: Sequence[str], correct: Column | str) -> DataFrame:
    hits = F.sum(col(correct).cast("int"))
    return df.groupBy(*by).agg(
        hits.alias("correct"),
        F.count("*").alias("total"),
        (F.count("*") - hits).alias("incorrect"),
    )


def within_share(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("prop", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def class_rate_wide(
    df: DataFrame, by: Sequence[str], label: str, classes: Sequence[str] = ("active", "passive")
) -> DataFrame:
    """Class counts as columns (0 where none), their total and rates (null when 0)."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes])
    total = F.col(classes[0])
    for c in classes[1:]:
        total = total + F.col(c)
    return counts.withColumn("total", total).withColumns(
        {f"{c}_rate": F.try_divide(F.col(c), F.col("total")) for c in classes}
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def review_coverage(df: DataFrame, by: Sequence[str], reviewed: str, needed: str) -> DataFrame:
    """Rows, needed, matched, missing and still-other rows per source."""
    need, match = F.col(needed), F.col(reviewed)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(need).alias("n_review_needed"),
        F.count_if(need & match).alias("n_review_matches"),
        F.count_if(need & ~match).alias("n_review_missing"),
        F.count_if(F.col("review_remaining_strict_final")).alias("n_strict_other_final"),
        F.count_if(F.col("review_remaining_lax_final")).alias("n_lax_other_final"),
    )
