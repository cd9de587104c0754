"""Checks on frames: columns, value domains, keys, levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, fixed


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def unknown_values(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each value outside its domain with its row count (`column_name, value, n_rows`).

    One aggregation over all checked columns; only bad values leave the scan.
    """
    checked = [c for c in domains if c in df.columns]
    bad = [
        F.when(
            ~F.coalesce(F.col(c).isin(*domains[c]), F.lit(False)),
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")),
        )
        for c in checked
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*bad))).alias("b"))
        .groupBy("b.column_name", "b.value")
        .agg(F.count("*").alias("n_rows"))
    )


DEFAULT_DOMAINS = {
    "prime_condition": fixed.CONDITIONS,
    "lexicality_condition": fixed.LEXICALITIES,
    "role_order": fixed.ROLE_ORDERS,
}


def validate_values(
    df: DataFrame,
    domains: Mapping[str, Sequence[str]] = DEFAULT_DOMAINS,
    non_empty: Sequence[str] = ("item_id",),
) -> DataFrame:
    """Raise (on the driver) when a value is outside its domain or an id is blank."""
    bad = unknown_values(df, domains).orderBy("column_name", "value").limit(20).collect()
    if bad:
        raise ValueError(
            "unknown values: " + ", ".join(f"{r.column_name}={r.value!r}" for r in bad)
        )
    for column in non_empty:
        if not df.where(F.coalesce(F.trim(column), F.lit("")) == "").isEmpty():
            raise ValueError(f"{column} must not be empty")
    return df


def checked_values(
    df: DataFrame, domains: Mapping[str, Sequence[str]] = DEFAULT_DOMAINS
) -> DataFrame:
    """The same check without an extra job: a bad value fails the task that reads it."""
    checks: dict[str, Column] = {}
    for c in (c for c in domains if c in df.columns):
        fine = F.coalesce(F.col(c).isin(*domains[c]), F.lit(False))
        message = F.concat(F.lit(f"unknown {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))
        checks[c] = F.when(fine, F.col(c)).otherwise(F.raise_error(message))
    return df.withColumns(checks)


def select_subset(df: DataFrame, requested: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose columns hold one of the requested values; asking for an absent value is an error.

    The check is one aggregate of yes/no flags, one per requested value.
    """
    flags = {
        f"{c}={v}": F.max((F.col(c).cast("string") == v).cast("int"))
        for c, values in requested.items()
        for v in values
    }
    if any(not values for values in requested.values()):
        raise ValueError("at least one value must be requested per column")
    seen = df.agg(*[F.coalesce(flag, F.lit(0)).alias(str(i)) for i, flag in enumerate(flags.values())])
    row = seen.first()
    absent = [name for i, name in enumerate(flags) if not row[i]]
    if absent:
        raise ValueError(f"requested values that do not occur: {absent}")
    out = df
    for c, values in requested.items():
        out = out.where(F.col(c).cast("string").isin(*values))
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise with up to five examples when a key repeats."""
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"duplicate keys {list(keys)}: {[r.asDict() for r in found]}")
    return df


def level_counts(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Exact number of distinct values per group."""
    return df.groupBy(*by).agg(F.count_distinct(column).alias("n_levels"))


def assert_levels(df: DataFrame, by: Sequence[str], column: str, expected: int) -> DataFrame:
    """Raise when a group has another number of levels than expected."""
    bad = level_counts(df, by, column).where(F.col("n_levels") != expected)
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"expected {expected} levels of {column}: {[r.asDict() for r in found]}")
    return df


def preview(df: DataFrame, condition: Column, order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows that meet the condition, by the stated order."""
    return df.where(condition).orderBy(*order).limit(n)


def load_items(df: DataFrame, check: bool = True) -> DataFrame:
    """Checked item table: columns, strings, default role order, canonical condition, domains."""
    require_columns(df, fixed.ITEM_COLUMNS)
    out = clean.coerce_strings(df, fixed.ITEM_COLUMNS)
    if "role_order" in df.columns:
        role = F.coalesce(F.col("role_order").cast("string"), F.lit("agent_first"))
        out = out.withColumn("role_order", role)
    out = out.withColumn("prime_condition", clean.canonical_condition("prime_condition"))
    return checked_values(out) if check else out


def condition_order(
    requested: Sequence[str], allowed: Sequence[str] = fixed.CONDITIONS
) -> list[str]:
    """Canonical condition names in the order asked for, without repeats."""
    tidy = [r.strip().lower() for r in requested if r.strip()]
    names = list(dict.fromkeys(fixed.CONDITION_ALIASES.get(r, r) for r in tidy))
    invalid = sorted(set(names) - set(allowed))
    if invalid or not names:
        raise ValueError(f"unsupported conditions {invalid}" if invalid else "no condition given")
    return names


def normalize_quartets(df: DataFrame) -> DataFrame:
    """Header trimmed and lower-cased; the four sentence columns required and kept."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    return require_columns(out, fixed.QUARTET_COLUMNS).select(*fixed.QUARTET_COLUMNS)
