"""Exact deduplication by sorting content, in DataFrame operations only.

Texts are equal when identical after white space (space, tab to carriage return) is
deleted. Sampled splitters cut the order (first characters, hash, salt) into ranges;
each range is sorted externally by the normalised bytes, so equal texts are neighbours;
the window compares neighbours in full and keeps, of equal texts, the one with the most
code points before normalising, then the smallest ``doc_id``.

Splitters hold 16 characters and two numbers, never whole texts, so their sample stays
small. A text with many copies is salted: its copies are sorted in several pieces of
about ``hot`` rows, and the best of all pieces comes from a pre-aggregated table with one
row for each such text (at most ``rows / hot``, and ``hot`` is at least a 100,000th of
all rows, so that table can be broadcast).

Nulls: a null text is the empty text; a null ``doc_id`` sorts after all others and may be
returned as ``keep_id`` only when its group has no other. Rows that repeat in full, the
id included, are separate rows of a group of which exactly one is kept. An empty table gives an
empty result. Other columns pass through ``exact_dedup`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def _best(text: Column, doc_id: Column) -> Column:
    """Least for the row that stays."""
    long_first = -F.char_length(F.coalesce(text.cast("string"), F.lit("")))
    return F.struct(long_first.alias("a"), doc_id.isNull().alias("b"), doc_id.cast("long").alias("c"))


def _sorted_groups(docs: DataFrame, columns: list[str], least_hot: int) -> DataFrame:
    """``columns`` of each row as _row, with _keep, _size, _kept and _sha of its group.

    Own columns start with an underscore and stand beside one struct of the caller's,
    so no name of the input can clash.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        normalised(F.col("text")).alias("_norm"),
        _best(F.col("text"), F.col("doc_id")).alias("_best"),
    ).withColumn("_sha", F.sha2("_norm", 256))
    hot_rows = max(least_hot, docs.count() // 100_000)
    hot = (
        rows.groupBy("_sha")
        .agg(F.count("*").alias("_copies"), F.min("_best").alias("_of_all"))
        .where(F.col("_copies") >= hot_rows)
    )
    ranges = (
        rows.join(F.broadcast(hot), "_sha", "left")
        .withColumn("_prefix", F.substring("_norm", 1, 16))
        .withColumn("_h", F.xxhash64("_norm"))
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_best"), F.ceil(F.col("_copies") / hot_rows)), F.lit(0)))
        .repartitionByRange("_prefix", "_h", "_salt")
    )
    piece = Window.partitionBy("_prefix", "_h", "_salt", "_norm")
    best = F.coalesce("_of_all", F.first("_best").over(piece.orderBy("_best")))
    return ranges.select(
        "_row",
        "_sha",
        best["c"].alias("_keep"),
        F.coalesce("_copies", F.count("*").over(piece)).alias("_size"),
        ((F.row_number().over(piece.orderBy("_best")) == 1) & (F.col("_best") == best)).alias("_kept"),
    )


def exact_groups(docs: DataFrame, least_hot: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _sorted_groups(docs, ["doc_id"], least_hot).select(
        F.col("_row.doc_id").cast("long").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, least_hot: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = _sorted_groups(docs, docs.columns, least_hot).where("_kept")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
