"""Long to wide, wide to long, row expansion, vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.core import col


def to_wide(
    df: DataFrame,
    unit: Sequence[str],
    condition: str | Sequence[str],
    values: Sequence[str],
    levels: Sequence,
    strict: bool = False,
    fill: float | None = None,
    name: str = "{value}_{level}",
) -> DataFrame:
    """One row per unit, one column per value and level.

    Collapse and pivot are one aggregation of conditional means (no second shuffle).
    ``condition`` may name several columns; a level is then a tuple. ``strict`` makes
    a second row in one cell an error.
    """
    conditions = [condition] if isinstance(condition, str) else list(condition)
    aggs = []
    for level in levels:
        parts = (level,) if isinstance(level, str) else tuple(level)
        here = F.lit(True)
        for c, part in zip(conditions, parts):
            here = here & (F.col(c) == part)
        for v in values:
            label = name.format(value=v, level="_".join(parts))
            cell = F.avg(F.when(here, F.col(v)))
            if strict:
                cell = F.when(F.count_if(here) <= 1, cell).otherwise(
                    F.raise_error(F.lit(f"more than one row in cell {label}"))
                )
            if fill is not None:
                cell = F.coalesce(cell, F.lit(fill))
            aggs.append(cell.alias(label))
    return df.groupBy(*unit).agg(*aggs)


def to_long(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    name: str = "measure",
    value: str = "value",
) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def to_long_by_pattern(
    df: DataFrame,
    keys: Sequence[str],
    names: Mapping[str, Mapping[str, str]],
    key: str,
) -> DataFrame:
    """Long table with one key column and several value columns.

    ``names[k][v]`` is the wide column that holds value ``v`` for key ``k``. One
    explode of an array of structs; no pivot back is needed.
    """
    cells = [
        F.struct(F.lit(k).alias(key), *[F.col(c).alias(v) for v, c in values.items()])
        for k, values in names.items()
    ]
    return df.select(*keys, F.explode(F.array(*cells)).alias("__c")).select(*keys, "__c.*")


def columns_by_pattern(columns: Sequence[str], pattern: str) -> dict[str, dict[str, str]]:
    """Column names split by a two-group pattern into ``{key: {value: column}}``."""
    import re

    out: dict[str, dict[str, str]] = {}
    for c in columns:
        hit = re.fullmatch(pattern, c)
        if hit:
            out.setdefault(hit.group(1), {})[hit.group(2)] = c
    return out


def prompts_to_rows(
    df: DataFrame,
    keys: Sequence[str],
    prompts: Mapping[str, Sequence[str]],
) -> DataFrame:
    """One row per prompt column. Each canonical column lists its alias columns in order;
    the first that exists and is filled is taken, and none is an error."""
    cells = []
    for canonical, candidates in prompts.items():
        present = [F.col(c) for c in candidates if c in df.columns]
        found = F.coalesce(
            *present, F.raise_error(F.lit(f"prompt column {canonical} is missing"))
        )
        cells.append(
            F.struct(
                F.lit(canonical).alias("prompt_column"),
                F.lit(canonical.removeprefix("prompt_")).alias("prime_condition"),
                found.cast("string").alias("prompt"),
            )
        )
    return df.select(*keys, F.explode(F.array(*cells)).alias("__c")).select(*keys, "__c.*")


def primes_to_rows(df: DataFrame, keys: Sequence[str], opening: str = 'Mary answered, "') -> DataFrame:
    """Active and passive prime of each prompt row: extracted answer, its context, match flag."""
    cells = F.array(
        *[
            F.struct(
                F.lit(kind).alias("prime_condition"),
                F.col(f"prompt_{kind}").alias("prompt"),
                F.trim(F.coalesce(F.col(f"prime_{kind}_sentence"), F.lit(""))).alias(
                    "declared_prime_sentence"
                ),
            )
            for kind in ("active", "passive")
        ]
    )
    rows = df.select(*keys, F.explode(cells).alias("__c")).select(*keys, "__c.*")
    rows = rows.withColumn("__m", text.between_markers("prompt", opening))
    return rows.withColumns(
        {
            "prime_context": F.col("__m.context"),
            "prime_sentence": F.col("__m.answer"),
        }
    ).withColumn(
        "prime_sentence_matches_column",
        text.sentences_match("declared_prime_sentence", "prime_sentence"),
    ).drop("__m", "prompt")


def dedupe_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows over the columns that exist."""
    return df.select(*[c for c in columns if c in df.columns]).distinct()


def content_words(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct words of several text columns: letters only, no function words.

    Words are made distinct inside each row first, which shrinks the shuffle.
    """
    bag = F.array_distinct(
        F.concat(*[text.nonstop_words(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    )
    return df.select(F.explode(bag).alias("word")).distinct()


def vocab_union(tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Distinct letters-only lower-case cells over all named columns of all tables."""
    parts = [
        df.select(F.explode(F.array(*[F.lower(F.trim(col(c).cast("string"))) for c in columns])).alias("word"))
        for df, columns in tables
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("word").rlike("^[a-z]+$")).distinct()


def select_nouns(
    df: DataFrame, noun: str, rank: str, keep: Column | None = None
) -> DataFrame:
    """Distinct lower-case nouns of a category with their best rank, which carries the order."""
    rows = df if keep is None else df.where(keep)
    return rows.groupBy(F.lower(F.trim(noun)).alias("noun")).agg(F.min(rank).alias("best_rank"))
