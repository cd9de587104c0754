"""Order inside large groups, best rows, counterbalancing and picks.

A window over a whole group would put a hot group into one task, so positions are
counted in two steps: inside small key-ordered blocks, then across the block counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import col
from ..sources.shared import materialize


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi join on keys that may be null on both sides."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def hash_bucket(*parts: Column, digits: int = 4) -> Column:
    """Leading hex digits of the md5 of the parts as a number; orders like the md5 text."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def position_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    block: Column,
    name: str = "position",
) -> DataFrame:
    """Zero-based position of each row in its group.

    ``block`` must not fall while ``order`` rises and should hold few rows per value
    (a hash prefix; for an index see :func:`position_by_rank`). Each block is sorted on its own;
    the counts of the earlier blocks are added by a join with the small block table.
    """
    group = list(group)
    work = df.withColumn("__block", block)
    counts = work.groupBy(*group, "__block").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(W.partitionBy(*group, "__block").orderBy(*order)) - 1
    ranked = work.withColumn("__inside", inside)
    out = null_safe_join(ranked, offsets, [*group, "__block"], "inner")
    return out.withColumn(name, F.col("__inside") + F.col("__before")).drop(
        "__block", "__inside", "__before"
    )


def ranked_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str], width: int) -> DataFrame:
    """``df`` with ``__block``: the number of its range of about ``width`` rows.

    The ranges' edges are sampled from the rows themselves, ordered by group, order and a hash of the
    row, so blocks hold about as many rows whatever the spacing of an index, and rows of one
    index are split too. The rows are written with their numbers: a lost task finds the same blocks.
    """
    ranges = max(1, math.ceil(df.count() / width))
    tie = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    dealt = df.withColumn("__tie", tie).repartitionByRange(ranges, *group, *order, "__tie")
    return materialize(dealt.withColumn("__block", F.spark_partition_id()), "ranges")


def position_by_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], width: int = 100_000, name: str = "position"
) -> DataFrame:
    """Zero-based position of each row in its group, in blocks of about ``width`` rows. Rows that agree in
    ``order`` get different positions, in an order that depends on the rows only."""
    rows = ranked_blocks(df, group, order, width)
    return position_in_group(rows, group, [*order, "__tie"], F.col("__block"), name).drop("__tie")


def counterbalance(
    df: DataFrame,
    cell: Sequence[str],
    index: str,
    width: int = 100_000,
    name: str = "role_order",
) -> DataFrame:
    """agent_first / patient_first in turn inside each cell, in index order."""
    placed = position_by_rank(df, cell, [index], width, "__turn")
    turn = F.when(F.col("__turn") % 2 == 0, "agent_first").otherwise("patient_first")
    return placed.withColumn(name, turn).drop("__turn")


def best_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """The columns of the first row per key. Partial aggregation, no window."""
    best = F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def dedupe(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """One row per key, the first in the stated order; all columns kept."""
    rest = [c for c in df.columns if c not in keys]
    return best_per_key(df, keys, order, rest).select(*df.columns)


def topk_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first k rows per key. Spark keeps only k rows per key and task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def zscore(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    ddof: int = 1,
    zero: bool = False,
    name: str | None = None,
) -> DataFrame:
    """(x - mean) / sd, per group or over everything.

    Moments come from an aggregation, joined back (or read as scalar subqueries), so
    no group is sorted into one task. sd 0 or one row: null, or 0 when ``zero``.
    """
    name = name or f"{column}_z"
    sd = F.stddev_samp(column) if ddof == 1 else F.stddev_pop(column)
    moments = df.groupBy(*by).agg(F.avg(column).alias("__mean"), sd.alias("__sd"))
    if by:
        joined = null_safe_join(df, moments, list(by))
        mean, spread = F.col("__mean"), F.col("__sd")
    else:
        joined = df
        mean = moments.select("__mean").scalar()
        spread = moments.select("__sd").scalar()
        joined = joined.withColumns({"__mean": mean, "__sd": spread})
        mean, spread = F.col("__mean"), F.col("__sd")
    z = F.when(spread > 0, (F.col(column) - mean) / spread)
    if zero:
        z = F.when(spread == 0, F.lit(0.0)).otherwise(z)
    return joined.withColumn(name, z).drop("__mean", "__sd")


def seeded_pick(
    pool: Sequence[str], seed: int, index: Column | str, blocked: Column | None = None
) -> Column:
    """One entry per row by a draw from md5(seed, index), avoiding blocked words.

    A pool entry is out when it shares a word with ``blocked``; if all are out the
    whole pool is open again.
    """
    from ..functions.core import let, literal_array

    open_entries = literal_array(pool) if blocked is None else open_pool(pool, blocked)
    draw = hash_bucket(F.lit(seed), col(index), digits=8)
    return let(open_entries, lambda e: F.get(e, F.pmod(draw, F.size(e)).cast("int")))


def open_pool(pool: Sequence[str], blocked: Column) -> Column:
    """Pool entries without a blocked word; the whole pool when none is left."""
    from ..functions import text
    from ..functions.core import let, literal_array

    entries = literal_array(pool)
    # The words of a fixed pool are literals: no row splits them again.
    parted = F.array(
        *[F.struct(F.lit(s).alias("entry"), literal_array(text.pool_words(s)).cast("array<string>").alias("words")) for s in pool]
    )

    def kept_of(b):
        return F.filter(parted, lambda s: ~F.arrays_overlap(s["words"], b))["entry"]

    kept = let(blocked, kept_of)
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(entries))


_POOL_IN_A_ROW = 10_000  # so many words of a pool are held as one array


def rotating_pick(
    df: DataFrame,
    key: Sequence[str],
    used: Column,
    offset: Column,
    count: Column,
    pool: DataFrame,
) -> DataFrame:
    """``count`` pool words per row: from ``offset`` on, wrapping, used words skipped.

    ``pool(position, word)`` numbers its words 0..n-1. A row can skip as many words as it has
    used, so it asks for that many positions and ``count`` more, never for one twice. ``key`` names a
    row. Adds ``picks`` (array): fewer than ``count`` when the pool runs out, empty when all of it is
    used or it is empty.

    Rows with a key of their own read a pool of up to 10,000 words as an array in place, so they don't meet a
    shuffle; only their keys are counted. Rows that share a key, and larger pools, meet by an equi join.
    """
    pool = materialize(pool.select("position", "word"), "pool")
    at = F.col("position")
    n, low, high, different = pool.agg(F.count("*"), F.min(at), F.max(at), F.count_distinct(at)).first()
    if n > _POOL_IN_A_ROW or (n and (low, high, different) != (0, n - 1, n)):
        return _picks_by_join(df, key, used, offset, count, pool, n)
    shared = df.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").select(*key, F.lit(True).alias("__shared"))
    shared = materialize(shared, "shared-keys")
    if shared.isEmpty():
        return _picks_in_place(df, used, offset, count, pool, n)
    marked = null_safe_join(df, shared, key)
    alone = marked.where(F.col("__shared").isNull()).drop("__shared")
    rest = marked.where(F.col("__shared")).drop("__shared")
    return _picks_in_place(alone, used, offset, count, pool, n).unionByName(
        _picks_by_join(rest, key, used, offset, count, pool, n)
    )


def _picks_in_place(df: DataFrame, used: Column, offset: Column, count: Column, pool: DataFrame, n: int) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("position", "word")))
    words = pool.agg(F.transform(listed, lambda s: s["word"])).scalar()
    work = df.withColumns({"__used": used, "__offset": offset, "__count": count, "__words": words}).withColumn(
        "__reach", F.least(F.size("__used") + F.col("__count"), F.lit(n)).cast("int")
    )
    asked = F.transform(
        F.sequence(F.lit(0), F.col("__reach") - 1),
        lambda i: F.get("__words", F.pmod(F.col("__offset") + i, F.lit(max(n, 1))).cast("int")),
    )
    free = F.filter(asked, lambda w: w.isNotNull() & ~F.array_contains("__used", w))
    picks = F.when(F.col("__reach") > 0, F.slice(free, F.lit(1), F.col("__count")))
    out = work.withColumn("picks", F.coalesce(picks, F.array().cast("array<string>")))
    return out.drop("__used", "__offset", "__count", "__words", "__reach")


def _picks_by_join(
    df: DataFrame, key: Sequence[str], used: Column, offset: Column, count: Column, pool: DataFrame, size: int
) -> DataFrame:
    n = F.col("__n")
    work = (
        df.select(*key, used.alias("__used"), offset.alias("__offset"), count.alias("__count"))
        .withColumn("__n", F.lit(size).cast("bigint"))
        .withColumn("__reach", F.least(F.size("__used") + F.col("__count"), n).cast("int"))
        .where(F.col("__reach") > 0)
    )
    asked = work.withColumn(
        "__step", F.explode(F.sequence(F.lit(0), F.col("__reach") - 1))
    ).withColumn("position", F.pmod(F.col("__offset") + F.col("__step"), n))
    # An outer join can't broadcast the rows, only the pool; a merge join broadcasts neither side.
    found = asked.join(pool.select("position", "word"), "position", "left")
    free = F.col("word").isNotNull() & ~F.array_contains("__used", F.col("word"))
    in_turn = F.array_sort(F.collect_list(F.when(free, F.struct("__step", "word"))))
    picked = found.groupBy(*key).agg(
        F.transform(F.slice(in_turn, F.lit(1), F.first("__count")), lambda s: s["word"]).alias("picks")
    )
    out = null_safe_join(df, picked.hint("merge"), key)
    return out.withColumn("picks", F.coalesce("picks", F.array().cast("array<string>")))


def offset_row(
    df: DataFrame, index: str, column: str, offset: int, name: str
) -> DataFrame:
    """Value of another row: the one at ``(index + offset) mod n``. Indexes run 0..n-1."""
    n = df.agg(F.count("*")).scalar()
    other = df.select(F.col(index).alias("__at"), F.col(column).alias(name))
    asked = df.withColumn("__n", n).withColumn(
        "__at", F.pmod(F.col(index) + max(1, offset), F.col("__n"))
    )
    return asked.join(other, "__at", "left").drop("__at", "__n")


def sample_items(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the n smallest md5(seed, key)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(digest, key).limit(n)


def take_items(df: DataFrame, index: str, n: int) -> DataFrame:
    """Rows whose index is below n."""
    return df.where(F.col(index) < n)


def first_in_word(tokens: DataFrame, keys: Sequence[str], word: str, token: str) -> DataFrame:
    """First token index of each aligned word."""
    aligned = tokens.where(F.col(word) >= 0)
    return aligned.groupBy(*keys, word).agg(F.min(token).alias("first_token_index"))
