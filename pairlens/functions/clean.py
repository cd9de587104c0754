"""Cleaning, canonical labels, derived measures and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .core import col, literal_array, literal_map


def coerce_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns as strings, null as the empty string."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    )


def to_number(df: DataFrame, column: str) -> Column:
    """The column as double; unreadable values and a missing column give null."""
    if column not in df.columns:
        return F.lit(None).cast("double")
    return F.col(column).try_cast("double")


def canonical_condition(
    value: Column | str,
    aliases: Mapping[str, str] = fixed.CONDITION_ALIASES,
    mode: str = "whole",
) -> Column:
    """Trimmed lower-case label with aliases replaced.

    ``mode='substring'`` replaces aliases anywhere inside the raw label, in the
    order given, and neither trims nor lower-cases.
    """
    value = col(value).cast("string")
    if mode == "substring":
        for alias, name in aliases.items():
            value = F.regexp_replace(value, alias, name)
        return value
    tidy = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.coalesce(literal_map(aliases)[tidy], tidy)


def normalize_lexicality(value: Column | str, dataset: Column | str | None = None) -> Column:
    """core / jabberwocky / mixed from the label, else from the data set name."""
    text = F.lower(F.trim(F.coalesce(col(value).cast("string"), F.lit(""))))
    data = (
        F.lit("")
        if dataset is None
        else F.lower(F.trim(F.coalesce(col(dataset).cast("string"), F.lit(""))))
    )
    return (
        F.when(text.isin("real", "core"), "core")
        .when(text.isin("nonce", "jabberwocky"), "jabberwocky")
        .when(data.contains("core_targets_jabberwocky_primes"), "mixed")
        .when(data.isin("core", "jabberwocky"), data)
        .when(text != "", text)
        .when(data != "", data)
        .otherwise("unspecified")
    )


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each missing column with its default; present columns stay."""
    return df.withColumns(
        {
            name: value if isinstance(value, Column) else F.lit(value)
            for name, value in defaults.items()
            if name not in df.columns
        }
    )


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate name that the frame has."""
    return next((c for c in candidates if c in df.columns), None)


def first_filled(df: DataFrame, candidates: Sequence[str]) -> Column:
    """First non-blank value among the candidate columns that exist."""
    present = [F.col(c) for c in candidates if c in df.columns]
    if not present:
        return F.lit("")
    filled = [F.when(F.trim(c.cast("string")) != "", c) for c in present[:-1]]
    return F.coalesce(*filled, present[-1])


def item_id(experiment: Column, dataset: Column, index: Column) -> Column:
    """``{experiment}_{dataset}_{index:05d}``; empty when the index is missing."""
    made = F.format_string("%s_%s_%05d", experiment, dataset, index.cast("bigint"))
    return F.when(index.isNotNull(), made).otherwise("")


def index_from_id(value: Column | str) -> Column:
    """Integer after the last underscore; null when there is none."""
    return F.regexp_extract(col(value), r"_([^_]*)$", 1).try_cast("bigint")


def as_bool(value: Column | str) -> Column:
    """true / 1 / yes, whatever the case; null is false."""
    text = F.lower(F.trim(col(value).cast("string")))
    return F.coalesce(text.isin("true", "1", "yes"), F.lit(False))


def needs_review(df: DataFrame) -> Column:
    """Strict or lax flag; a missing flag falls back to label = 'other'."""

    def flag(name: str) -> Column:
        if f"review_remaining_{name}" in df.columns:
            return as_bool(f"review_remaining_{name}")
        return F.coalesce(F.col(f"generation_class_{name}") == "other", F.lit(False))

    return flag("strict") | flag("lax")


def finite(value: Column | str) -> Column:
    """NaN and infinities as null."""
    value = col(value)
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def drop_nonfinite(df: DataFrame, columns: Sequence[str], drop: bool = True) -> DataFrame:
    """Non-finite values become null, then rows with any null in ``columns`` go."""
    out = df.withColumns({c: finite(c) for c in columns})
    return out.na.drop(subset=list(columns)) if drop else out


def index_key(value: Column | str) -> Column:
    """Numeric index as a text key, so 3, 3.0 and '3' meet."""
    return col(value).cast("string").try_cast("double").cast("bigint").cast("string")


def class_indicators(
    label: Column | str,
    classes: Sequence[str] = ("active", "passive", "other"),
    condition: Column | str | None = None,
) -> dict[str, Column]:
    """0/1 columns ``is_<class>`` and, with a condition, ``is_congruent``."""
    label = F.coalesce(col(label), F.lit(""))
    out = {f"is_{c}": (label == c).cast("int") for c in classes}
    if condition is not None:
        cond = F.coalesce(col(condition), F.lit(""))
        out["is_congruent"] = (
            cond.isin("active", "passive") & (label == cond)
        ).cast("int")
    return out


def quality_indicators(label: Column | str, condition: Column | str) -> dict[str, Column]:
    """Like, exact, prefix, structural and congruent flags of a structure class."""
    label, cond = col(label), col(condition)
    out = {
        "is_active_like": label.startswith("active"),
        "is_passive_like": label.startswith("passive"),
        "is_exact": label.isin("active_exact", "passive_exact"),
        "is_prefix": label.isin("active_prefix", "passive_prefix"),
        "is_structural": label.isin("active_structural", "passive_structural"),
        "is_congruent": ((cond == "active") & label.startswith("active"))
        | ((cond == "passive") & label.startswith("passive")),
    }
    return {name: flag.cast("int") for name, flag in out.items()}


def choose_structure(active: Column | str, passive: Column | str) -> Column:
    """passive only when its score is higher; a tie is active."""
    return F.when(col(passive) > col(active), "passive").otherwise("active")


def pairwise_preference(
    active_sum: Column | str,
    passive_sum: Column | str,
    active_tokens: Column | str,
    passive_tokens: Column | str,
) -> dict[str, Column]:
    """Totals, per-token means, both signs of the difference, the choice and its indicator."""
    a, p = col(active_sum), col(passive_sum)
    a_mean = a / F.greatest(F.lit(1), col(active_tokens))
    p_mean = p / F.greatest(F.lit(1), col(passive_tokens))
    chosen = choose_structure(a_mean, p_mean)
    return {
        "active_choice_logprob": a_mean,
        "passive_choice_logprob": p_mean,
        "preference_total": a - p,
        "preference_mean": a_mean - p_mean,
        "passive_minus_active_logprob": p_mean - a_mean,
        "passive_minus_active_logprob_sum": p - a,
        "chosen_structure": chosen,
        "passive_choice_indicator": F.when(chosen == "passive", 1.0).otherwise(0.0),
    }


def finalize_scores(df: DataFrame) -> DataFrame:
    """Log-odds from the difference column, else computed, else null; token-count difference."""

    def odds(suffix: str) -> Column:
        ready = f"passive_minus_active_logprob{suffix}"
        if ready in df.columns:
            return to_number(df, ready)
        return to_number(df, f"passive_choice_logprob{suffix}") - to_number(
            df, f"active_choice_logprob{suffix}"
        )

    tokens = to_number(df, "passive_target_token_count") - to_number(
        df, "active_target_token_count"
    )
    return df.withColumns(
        {
            "logodds_passive": odds(""),
            "logodds_passive_sum": odds("_sum"),
            "passive_minus_active_token_count": tokens,
            "token_count_diff": tokens,
        }
    )


def prime_relation(condition: Column | str, voice: Column | str) -> Column:
    cond, voice = col(condition), col(voice)
    return (
        F.when(cond == "no_prime", "no_prime")
        .when(cond == voice, "congruent")
        .when(cond != voice, "incongruent")
    )


def congruent_shift(
    condition: Column | str, shift: Column | str, strict: bool = True
) -> Column:
    """Passive keeps its sign, active flips. Other conditions: null, or flipped if not strict."""
    cond, shift = col(condition), col(shift)
    kept = F.when(cond == "passive", shift)
    return kept.when(cond == "active", -shift) if strict else kept.otherwise(-shift)


def congruent_generation(prime: Column | str, voice: Column | str) -> Column:
    prime, voice = col(prime), col(voice)
    both = prime.isin("active", "passive") & voice.isin("active", "passive")
    return F.when(both, (prime == voice).cast("int"))


def ceiling_flag(accuracy: Column | str, threshold: float) -> dict[str, Column]:
    return {
        "is_near_ceiling": col(accuracy) >= F.lit(threshold),
        "ceiling_threshold": F.lit(float(threshold)),
    }


def rank_value(rank: Column | str) -> Column:
    """Numeric rank cut to an integer; empty or unreadable is 10^9."""
    number = col(rank).cast("string").try_cast("double")
    return F.coalesce(number.cast("bigint"), F.lit(10**9))


def rank_filter(df: DataFrame, rank: str, maximum: int) -> DataFrame:
    return df.where(rank_value(rank) <= maximum)


def candidate_voice(label: Column | str, fallback: Column | str) -> Column:
    text = F.lower(F.coalesce(col(label), F.lit("")))
    return (
        F.when(text.contains("active"), "active")
        .when(text.contains("passive"), "passive")
        .otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)
    )


def infer_domain(*labels: Column | str) -> Column:
    """jabberwocky when any label names it, else core."""
    text = F.lower(F.concat_ws(" ", *[col(x) for x in labels]))
    return F.when(text.contains("jabberwocky"), "jabberwocky").otherwise("core")


def level_rank(value: Column | str, levels: Sequence[str]) -> Column:
    """Position of the value in ``levels``; unknown values come last."""
    place = F.array_position(literal_array(levels), col(value))
    return F.when(place > 0, place - 1).otherwise(len(levels)).cast("int")


def safe_log(value: Column | str) -> Column:
    value = col(value)
    return F.when((value > 0) & (value < float("inf")), F.log(value))


def smoothed_logodds(a: Column | str, b: Column | str, alpha: float = 0.5) -> Column:
    return F.log((col(a) + alpha) / (col(b) + alpha))


def empirical_logit(correct: Column | str, total: Column | str) -> Column:
    """logit((c + 0.5) / (n + 1))."""
    c, n = col(correct), col(total)
    return F.log((c + 0.5) / (n - c + 0.5))
