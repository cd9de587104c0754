"""Paired effects: same unit under several conditions, collapsed, spread, differenced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, fixed, text
from ..functions.core import col
from .reshape import to_wide


def paired_effect(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    condition: str = "prime_condition",
    active: str = "active_choice_logprob",
    passive: str = "passive_choice_logprob",
) -> DataFrame:
    """Prediction error per unit.

    Score of each target after the same-voice prime minus after the other-voice
    prime, and passive minus active. Also for the ``_sum`` columns when present.
    Rows with a null key are dropped, and so are units that lack one condition or
    have a value that is not finite. One aggregation does collapse and pivot.
    """
    forms = {"": (active, passive)}
    if f"{active}_sum" in df.columns and f"{passive}_sum" in df.columns:
        forms["_sum"] = (f"{active}_sum", f"{passive}_sum")
    rows = df.na.drop(subset=[*by, unit, condition])
    aggs = []
    for suffix, columns in forms.items():
        for target, column in zip(("active", "passive"), columns):
            for prime in ("active", "passive"):
                name = f"logp{suffix}_{target}_target_given_{prime}_prime"
                score = F.col(column).cast("double")
                here = (F.col(condition) == prime) & ~F.isnan(score)
                value = F.avg(F.when(here, score))
                aggs.append(clean.finite(value).alias(name))
    wide = rows.groupBy(*by, unit).agg(*aggs)
    wide = wide.na.drop(subset=[c for c in wide.columns if c.startswith("logp")])
    extra: dict[str, Column] = {}
    for suffix in forms:
        p = f"logp{suffix}"
        a = F.col(f"{p}_active_target_given_active_prime") - F.col(
            f"{p}_active_target_given_passive_prime"
        )
        b = F.col(f"{p}_passive_target_given_passive_prime") - F.col(
            f"{p}_passive_target_given_active_prime"
        )
        extra[f"pe_active_target_logprob{suffix}_same_minus_other"] = a
        extra[f"pe_passive_target_logprob{suffix}_same_minus_other"] = b
        extra[f"pe_logprob{suffix}_imbalance_passive_minus_active"] = b - a
    return wide.withColumns(extra)


def _cell(voice: str, prime: str, metric: str) -> str:
    return f"logp_{voice}_target_given_{prime}_prime_{metric}"


def spread_scores(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean score per (target voice, prime condition) as columns."""
    metric = value.removeprefix("target_logprob_")
    levels = [(v, p) for v in ("active", "passive") for p in fixed.CONDITIONS]
    wide = to_wide(df, keys, ["target_voice", "prime_condition"], [value], levels)
    renamed = {f"{value}_{v}_{p}": _cell(v, p, metric) for v, p in levels}
    return wide.withColumnsRenamed(renamed)


def paired_effect_long(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str] = ("sum", "mean"),
    baselines: Sequence[str] = ("no_prime", "filler"),
) -> DataFrame:
    """Effects from a long target-score table, with shifts against each baseline.

    Sum and mean scores are spread in the same aggregation.
    """
    levels = [(v, p) for v in ("active", "passive") for p in ("active", "passive", *baselines)]
    values = [f"target_logprob_{m}" for m in metrics]
    wide = to_wide(df, keys, ["target_voice", "prime_condition"], values, levels)
    wide = wide.withColumnsRenamed(
        {f"target_logprob_{m}_{v}_{p}": _cell(v, p, m) for m in metrics for v, p in levels}
    )
    out: dict[str, Column] = {}
    for m in metrics:

        def c(voice, prime, m=m):
            return F.col(_cell(voice, prime, m))

        a = c("active", "active") - c("active", "passive")
        b = c("passive", "passive") - c("passive", "active")
        out[f"pe_active_target_logprob_{m}_same_minus_other"] = a
        out[f"pe_passive_target_logprob_{m}_same_minus_other"] = b
        out[f"pe_logprob_{m}_imbalance_passive_minus_active"] = b - a
        for base in baselines:
            out[f"active_target_shift_active_minus_{base}_{m}"] = c("active", "active") - c(
                "active", base
            )
            out[f"passive_target_shift_passive_minus_{base}_{m}"] = c("passive", "passive") - c(
                "passive", base
            )
            out[f"baseline_{base}_passive_minus_active_logprob_{m}"] = c("passive", base) - c(
                "active", base
            )
    return wide.withColumns({name: clean.finite(value) for name, value in out.items()})


def baseline_shift(
    df: DataFrame,
    unit: Sequence[str],
    value: str = "logodds_passive",
    condition: str = "prime_condition",
    baseline: str = "no_prime",
    conditions: Sequence[str] = ("active", "passive"),
    carry: Sequence[str] = (),
    row_order: Sequence[str] = (),
) -> DataFrame:
    """Value minus the unit's own baseline mean, one row per unit and condition.

    Units without a baseline or without the condition give no row. ``carry`` columns
    come from the unit's first row in ``row_order``.
    """
    cond = F.col(condition)
    seen = {c: F.count_if(cond == c) for c in (baseline, *conditions)}
    aggs = [F.avg(F.when(cond == c, F.col(value))).alias(f"__v_{c}") for c in seen]
    aggs += [n.alias(f"__n_{c}") for c, n in seen.items()]
    if carry:
        aggs.append(F.min_by(F.struct(*carry), F.struct(*row_order)).alias("__first"))
    wide = df.groupBy(*unit).agg(*aggs)
    cells = F.array(
        *[
            F.when(
                F.col(f"__n_{c}") > 0,
                F.struct(
                    F.lit(c).alias("prime_type"),
                    F.lit(baseline).alias("baseline_condition"),
                    F.col(f"__v_{baseline}").alias("baseline_logodds_passive"),
                    F.col(f"__v_{c}").alias("primed_logodds_passive"),
                ),
            )
            for c in conditions
        ]
    )
    first = ["__first.*"] if carry else []
    rows = wide.where(F.col(f"__n_{baseline}") > 0).select(
        *unit, *first, F.explode(F.array_compact(cells)).alias("__c")
    )
    return rows.select(*[c for c in rows.columns if c != "__c"], "__c.*").withColumn(
        "shift_from_no_prime",
        F.col("primed_logodds_passive") - F.col("baseline_logodds_passive"),
    )


def target_frame_columns(df: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Target text (active target, else first candidate), its verb form, lemma, content frame."""
    present = [c for c in ("target_active", "candidate_a_text") if c in df.columns]
    target = clean.first_filled(df, present)
    out = df.withColumn("target_active_text_for_bias", target)
    out = out.withColumns(
        {
            "target_verb_form": text.finite_verb("target_active_text_for_bias"),
            "target_content_frame": text.content_frame("target_active_text_for_bias"),
        }
    )
    if lemmas is None:
        return out.withColumn("target_verb_lemma", F.col("target_verb_form"))
    from .joins import lookup

    return lookup(out, lemmas, "target_verb_form", "lemma", "target_verb_lemma", dim_key="form")


def scored_baseline(
    df: DataFrame, keep: Sequence[str], lemmas: DataFrame | None = None
) -> DataFrame:
    """Unprimed scored rows with their target frame; the wanted columns that exist."""
    base = df.where(F.col("prime_condition") == "no_prime")
    out = target_frame_columns(base, lemmas).withColumn(
        "baseline_bias_type", F.lit("scored_candidate_no_prime")
    )
    return out.select(*[c for c in keep if c in out.columns])


def prime_event_bias(
    df: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Passive minus active prime score per event.

    Active and passive rows of an event meet in one aggregation. A second row of one
    voice for the same keys is an error; events with one voice only give no row.
    """
    cond = F.col("prime_condition")
    rows = df.where(cond.isin("active", "passive"))
    aggs = []
    for voice in ("active", "passive"):
        here = cond == voice
        n = F.count_if(here)
        checked = F.when(n <= 1, n).otherwise(
            F.raise_error(F.lit(f"more than one {voice} prime for an event"))
        )
        aggs.append(checked.alias(f"__n_{voice}"))
        aggs += [F.max(F.when(here, F.col(v))).alias(f"prime_{voice}_{v}") for v in values]
    both = rows.groupBy(*keys).agg(*aggs).where("__n_active = 1 AND __n_passive = 1")
    out = {
        f"prime_logodds_passive_{m}": F.col(f"prime_passive_logprob_{m}")
        - F.col(f"prime_active_logprob_{m}")
        for m in ("sum", "mean")
        if f"logprob_{m}" in values
    }
    if "token_count" in values:
        out["prime_passive_minus_active_token_count"] = F.col(
            "prime_passive_token_count"
        ) - F.col("prime_active_token_count")
    return both.drop("__n_active", "__n_passive").withColumns(out)


def match_prime_surprisal(
    scores: DataFrame,
    primes: DataFrame,
    unit: Sequence[str],
    match: Sequence[str],
    value: str = "logodds_passive",
) -> DataFrame:
    """Attach independently scored prime surprisal to target shifts.

    ``match`` keys plus the normalised sentence and the typed index must agree. The
    prime table and the baseline are reduced to one row per key first, so both joins
    are many-to-one by construction.
    """
    keys = [*match, "prime_condition", "item_index_key", "prime_sentence_key"]
    primed = scores.where(F.col("prime_condition").isin("active", "passive")).withColumns(
        {
            "prime_sentence_key": text.sentence_key("prime_text"),
            "item_index_key": clean.index_key("item_index"),
        }
    )
    baseline = (
        scores.where(F.col("prime_condition") == "no_prime")
        .groupBy(*unit)
        .agg(F.min_by(value, "row_id").alias("baseline_logodds_passive"))
    )
    keep = [
        c for c in ("prime_sentence", "prime_surprisal_sum", "prime_surprisal_mean")
        if c in primes.columns
    ]
    scored = (
        primes.where(F.col("prime_condition").isin("active", "passive"))
        .withColumns(
            {
                "prime_sentence_key": text.sentence_key("prime_sentence"),
                "item_index_key": clean.index_key("item_index"),
            }
        )
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*keep), "row_id").alias("__p"))
        .select(*keys, "__p.*")
        .withColumnRenamed("prime_sentence", "scored_prime_sentence")
    )
    out = primed.join(scored, keys, "left").join(baseline, list(unit), "left")
    shift = F.col(value) - F.col("baseline_logodds_passive")
    return out.withColumns(
        {
            "target_shift_from_no_prime": shift,
            "congruent_shift_from_no_prime": clean.congruent_shift(
                "prime_condition", shift, strict=False
            ),
            "prime_surprisal_match_status": F.when(
                F.col("scored_prime_sentence").isNotNull(), "exact_sentence_match"
            ).otherwise("missing_or_mismatch"),
        }
    )


def token_surprisal(df: DataFrame, keys: Sequence[str], value: str = "token_surprisal") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("prime_surprisal_mean"),
        F.sum(value).alias("prime_surprisal_sum"),
        F.count("*").alias("prime_token_count"),
    )


def roi_facilitation(
    df: DataFrame,
    unit: Sequence[str],
    value: str = "roi_surprisal_mean",
    baseline: str = "no_prime",
    primed: str = "passive",
) -> DataFrame:
    """Baseline minus primed surprisal per region; incomplete pairs are dropped."""
    wide = to_wide(df, unit, "prime_condition", [value], [baseline, primed], name="{level}")
    gain = F.col(baseline) - F.col(primed)
    return wide.withColumn("facilitation", gain).where(F.col("facilitation").isNotNull())


def congruency_effect(
    df: DataFrame, unit: Sequence[str], condition: str, voice: str, correct: Column | str
) -> DataFrame:
    """Accuracy and empirical logit after congruent minus after incongruent primes."""
    relation = clean.prime_relation(condition, voice)
    hit = col(correct).cast("int")
    aggs = []
    for r in ("congruent", "incongruent"):
        c = F.sum(F.when(relation == r, hit))
        n = F.count_if(relation == r)
        aggs.append(F.try_divide(c, n).alias(f"accuracy_{r}"))
        aggs.append(F.when(n > 0, clean.empirical_logit(c, n)).alias(f"elogit_accuracy_{r}"))
    primed = df.where(relation.isin("congruent", "incongruent"))
    return primed.groupBy(*unit).agg(*aggs).withColumns(
        {
            "comprehension_congruency_effect": F.col("accuracy_congruent")
            - F.col("accuracy_incongruent"),
            "comprehension_congruency_logodds": F.col("elogit_accuracy_congruent")
            - F.col("elogit_accuracy_incongruent"),
        }
    )


def rate_shift(
    df: DataFrame,
    by: Sequence[str],
    indicator: Column | str,
    condition: str = "prime_condition",
    baseline: str = "no_prime",
    conditions: Sequence[str] = ("active", "passive", "filler"),
) -> DataFrame:
    """Rate of an indicator per condition minus the baseline rate, long by shift type."""
    hit = col(indicator).cast("double")
    rates = df.groupBy(*by).agg(
        *[
            F.avg(F.when(F.col(condition) == c, hit)).alias(f"__{c}")
            for c in (baseline, *conditions)
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f"{c}_shift").alias("shift_type"),
                (F.col(f"__{c}") - F.col(f"__{baseline}")).alias("probability_shift"),
            )
            for c in conditions
        ]
    )
    return rates.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def abs_shift(df: DataFrame, column: str = "shift_from_no_prime") -> DataFrame:
    return df.withColumn(f"abs_{column}", F.abs(column))


def pair_differences(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    metrics: Mapping[str, str],
    pairs: Sequence[tuple[str, str]],
    condition: str = "prime_condition",
    gather: bool = False,
) -> DataFrame:
    """Per unit, metric and condition pair (a, b): value under a minus value under b.

    Units without both values give no row. All pairs come from one aggregation. ``gather`` gives a row per
    unit and pair, with the metrics' differences as an array ``diffs`` in place of ``metric`` and ``diff``.
    """
    levels = list(dict.fromkeys(c for pair in pairs for c in pair))
    wide = to_wide(df, [*by, unit], condition, list(metrics), levels)

    def named(a: str, b: str) -> list[Column]:
        return [F.lit(a).alias("condition_a"), F.lit(b).alias("condition_b")]

    def diff(m: str, a: str, b: str) -> Column:
        return F.col(f"{m}_{a}") - F.col(f"{m}_{b}")

    if gather:
        cells = [F.struct(*named(a, b), F.array(*[diff(m, a, b) for m in metrics]).alias("diffs")) for a, b in pairs]
    else:
        cells = [
            F.struct(F.lit(label).alias("metric"), *named(a, b), diff(m, a, b).alias("diff"))
            for m, label in metrics.items()
            for a, b in pairs
        ]
    rows = wide.select(*by, unit, F.explode(F.array(*cells)).alias("c")).select(*by, unit, "c.*")
    return rows.where(F.exists("diffs", lambda d: d.isNotNull()) if gather else F.col("diff").isNotNull())
