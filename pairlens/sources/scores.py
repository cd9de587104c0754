"""Ingest of externally made scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import arrays, clean
from .tables import read_table

LISTS = {
    "_token_logprobs": arrays.decode_list,
    "_token_ids": arrays.decode_list,
    "_tokens": arrays.decode_strings,
}


def decode_scores(df: DataFrame, slots: Sequence[str] = ("candidate_a", "candidate_b")) -> DataFrame:
    """JSON list cells as arrays (absent columns are left out) and the derived log-odds."""
    lists = {
        f"{slot}{suffix}": decode(f"{slot}{suffix}")
        for slot in slots
        for suffix, decode in LISTS.items()
        if f"{slot}{suffix}" in df.columns
    }
    return clean.finalize_scores(df.withColumns(lists))


def read_scores(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    slots: Sequence[str] = ("candidate_a", "candidate_b"),
) -> DataFrame:
    """Score table from CSV: explicit schema, lists decoded, differences finalised."""
    return decode_scores(read_table(spark, path, schema), slots)
