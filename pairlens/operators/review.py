"""Human review: queue, overlay, scored answers and generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels, text
from ..functions.core import col


def overlay_reviews(
    df: DataFrame,
    reviews: DataFrame,
    on: Sequence[str],
    columns: Sequence[str],
    policy: str = "any_match",
    needed: Column | str | None = None,
    prefix: str = "reviewed_",
    flag: str = "manually_reviewed",
) -> DataFrame:
    """Reviewed value where there is one, else the automatic one, as ``<column>_final``.

    ``any_match`` takes the review of every matching row. ``needed_only`` takes it only
    where ``needed`` holds and the review's strict class is filled. Blank reviewed
    values never override. Review keys must be unique: the reviews are grouped on them
    and a repeated key fails.
    """
    one = reviews.groupBy(*on).agg(
        F.count("*").alias("__n"), F.first(F.struct(*[f"{prefix}{c}" for c in columns])).alias("__r")
    )
    checked = F.when(F.col("__n") == 1, F.col("__r")).otherwise(
        F.raise_error(F.lit(f"duplicate review key {list(on)}"))
    )
    one = one.select(*on, checked.alias("__r"), F.lit(True).alias("__hit"))
    out = df.join(one, list(on), "left")
    hit = F.col("__hit").isNotNull()
    if policy == "needed_only":
        strict = F.col(f"__r.{prefix}{columns[0]}").cast("string")
        filled = F.coalesce(F.length(strict) > 0, F.lit(False))
        need = F.lit(True) if needed is None else col(needed)
        hit = hit & filled & need
    elif policy != "any_match":
        raise ValueError(f"unknown policy {policy!r}")
    out = out.withColumn(flag, hit)
    final = {}
    for c in columns:
        value = F.col(f"__r.{prefix}{c}")
        if policy == "needed_only":
            value = F.when(F.col(flag) & (value.cast("string") != ""), value)
        final[f"{c}_final"] = F.coalesce(value, F.col(c))
    return out.withColumns(final).drop("__r", "__hit")


def add_review_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "review_remaining_strict_final": F.col("generation_class_strict_final") == "other",
            "review_remaining_lax_final": F.col("generation_class_lax_final") == "other",
        }
    )


def review_queue(
    df: DataFrame,
    key: str,
    sentence: str,
    lists: Sequence[str],
    examples: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """One row per review key: occurrences, all distinct values per list column, and the
    first row's example columns.

    Distinct (key, value) pairs are formed first, so repeated values are gone before a
    key's lists are gathered. For keys with more values than a row should hold,
    :func:`review_values` gives the same as rows.
    """
    base = df.groupBy(key, sentence).agg(
        F.count("*").alias("occurrence_count"),
        F.min_by(F.struct(*examples), F.struct(*order)).alias("__first"),
    )
    joined = review_values(df, key, lists).groupBy(key).agg(
        *[
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("list") == c, F.col("value")))), ";"
            ).alias(f"{c}_list")
            for c in lists
        ]
    )
    return base.join(joined, key, "left").select(
        key, sentence, "occurrence_count", "__first.*", *[f"{c}_list" for c in lists]
    )


def review_values(df: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """One row per review key, list column and value, with its number of rows."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("list"), F.col(c).cast("string").alias("value"))
            for c in lists
        ]
    )
    values = df.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    return values.groupBy(key, "list", "value").agg(F.count("*").alias("n"))


def score_answers(
    df: DataFrame, raw: str, correct_head: Column | str, foil_head: Column | str
) -> DataFrame:
    """Normalised answer, its label, and correct / foil flags."""
    out = df.withColumn(
        "generated_answer_normalized", text.normalize_answer(raw, correct_head, foil_head)
    )
    out = out.withColumn(
        "matched_label",
        text.evaluate_answer(raw, "generated_answer_normalized", correct_head, foil_head),
    )
    return out.withColumns(
        {
            "is_correct": F.col("matched_label") == "correct",
            "is_foil": F.col("matched_label") == "foil",
        }
    )


def score_generations(
    df: DataFrame,
    completion: str,
    stub: str = "The",
    active: str = "target_active",
    passive: str = "target_passive",
) -> DataFrame:
    """First sentence of stub + completion, its normal form and its structure class."""
    answer = text.first_sentence(F.concat(F.lit(stub), F.col(completion)))
    out = df.withColumn("greedy_answer_first_sentence", answer)
    return out.withColumns(
        {
            "greedy_answer_first_sentence_normalized": text.normalize_generated(
                "greedy_answer_first_sentence"
            ),
            "generation_class": labels.classify_structure(
                "greedy_answer_first_sentence", active, passive, fixed.SIMPLE_DETERMINERS
            ),
        }
    )
