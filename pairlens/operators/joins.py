"""Expansion by conditions, checked joins, lookups, membership joins, matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.core import col
from .ranking import hash_bucket, null_safe_join, position_by_rank, position_in_group
from .validate import assert_unique


def expand_conditions(
    df: DataFrame,
    texts: Mapping[str, Column],
    condition: str = "prime_condition",
    text_column: str = "prime_text",
) -> DataFrame:
    """One row per item and condition; the condition decides the text.

    The conditions are an array literal exploded in place, so nothing is joined.
    """
    pairs = F.array(
        *[F.struct(F.lit(name).alias("c"), t.cast("string").alias("t")) for name, t in texts.items()]
    )
    return (
        df.withColumn("__p", F.explode(pairs))
        .withColumns({condition: F.col("__p.c"), text_column: F.col("__p.t")})
        .drop("__p")
    )


def expand_grid(df: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every combination of the axis values per row."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def join_checked(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    validate: str = "many_to_one",
    check: str = "raise",
) -> DataFrame:
    """Equi join with a uniqueness claim about the keys.

    ``check='raise'`` looks for duplicates first. ``check='inline'`` runs no extra
    job: the side claimed unique is aggregated on its keys and a repeated key fails
    the task that meets it.
    """
    sides = {"many_to_one": (False, True), "one_to_one": (True, True), "one_to_many": (True, False)}
    left_unique, right_unique = sides[validate]

    def unique(df):
        rest = [c for c in df.columns if c not in on]
        row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("x"))
        one = df.groupBy(*on).agg(F.min(row).alias("__row"), F.count("*").alias("__n"))
        fine = F.when(F.col("__n") == 1, F.col("__row")).otherwise(
            F.raise_error(F.lit(f"duplicate join key {list(on)}"))
        )
        one = one.withColumn("__row", fine)
        return one.select(*on, "__row.*") if rest else one.select(*on)

    if check == "raise":
        if left_unique:
            assert_unique(left, on)
        if right_unique:
            assert_unique(right, on)
    else:
        left = unique(left) if left_unique else left
        right = unique(right) if right_unique else right
    return left.join(right, list(on), how)


def merge_on_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column name the two frames share."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, "inner")


def lookup(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    value: str,
    name: str,
    default: Column | None = None,
    dim_key: str | None = None,
) -> DataFrame:
    """Dimension value per key; the key itself (or ``default``) when it is unknown."""
    small = dim.select(F.col(dim_key or key).alias("__k"), F.col(value).alias("__v"))
    out = df.join(small, F.col(key) == F.col("__k"), "left")
    fallback = F.col(key) if default is None else default
    return out.withColumn(name, F.coalesce(F.col("__v"), fallback)).drop("__k", "__v")


def flip_edges(edges: DataFrame, cue: str = "cue", target: str = "target") -> DataFrame:
    """Distinct edges in both directions."""
    pair = F.array(
        F.struct(F.col(cue).alias("a"), F.col(target).alias("b")),
        F.struct(F.col(target).alias("a"), F.col(cue).alias("b")),
    )
    return edges.select(F.explode(pair).alias("e")).select("e.a", "e.b").distinct()


def has_association(
    df: DataFrame, key: str, left_words: Column, right_words: Column, edges: DataFrame
) -> DataFrame:
    """Keys of the rows in which some left word is linked to some right word.

    Each row names its own few word pairs and asks the edge table for them by an
    equi join. Pairs are made distinct before the join, so frequent pairs are
    looked up once.
    """
    asked = (
        df.select(
            F.col(key),
            F.explode(F.array_distinct(left_words)).alias("a"),
            right_words.alias("__r"),
        )
        .select(key, "a", F.explode(F.array_distinct("__r")).alias("b"))
    )
    linked = asked.select("a", "b").distinct().join(flip_edges(edges), ["a", "b"], "left_semi")
    return asked.join(linked, ["a", "b"], "left_semi").select(key).distinct()


def zip_rows(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Row i of one table with row i of the other, by an explicit index."""
    return left.join(right, index)


def assign_opposite(
    targets: DataFrame,
    primes: DataFrame,
    target_index: str,
    prime_key: str,
    target_bucket: tuple[Column, Column],
    prime_bucket: tuple[Column, Column],
    seed: int,
    width: int = 100_000,
    require_all: bool = True,
) -> DataFrame:
    """One prime per target without reuse, from the bucket opposite in auxiliary and determiner.

    Both sides are numbered inside their bucket (targets by index, primes by a seeded
    md5) and joined on (bucket, number). A target left over means that its bucket ran
    out: an error, or a null prime when ``require_all`` is off.
    """
    def opposite(aux, family):
        return (
            F.when(aux == "is", "was").otherwise("is"),
            F.when(family == "indef", "def").otherwise("indef"),
        )

    need_aux, need_family = opposite(*target_bucket)
    t = targets.withColumns({"__aux": need_aux, "__fam": need_family})
    t = position_by_rank(t, ["__aux", "__fam"], [target_index], width, "__turn")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(prime_key).cast("string")))
    p = primes.withColumns(
        {"__aux": prime_bucket[0], "__fam": prime_bucket[1], "__draw": digest}
    )
    p = position_in_group(
        p,
        ["__aux", "__fam"],
        ["__draw", prime_key],
        hash_bucket(F.lit(str(seed)), F.col(prime_key)),
        "__turn",
    ).drop("__draw")
    keys = ["__aux", "__fam", "__turn"]
    out = null_safe_join(t, p.withColumn("__hit", F.lit(True)), keys, "left")
    if require_all:
        fine = F.when(F.col("__hit"), F.col("__hit")).otherwise(
            F.raise_error(
                F.concat(F.lit("no prime left for "), F.concat_ws("/", "__aux", "__fam"))
            )
        )
        out = out.withColumn("__hit", fine).where("__hit")
    return out.drop(*keys, "__hit")


def filter_edges(edges: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Edges between two vocabulary words, letters only, no self loops."""
    clean = edges.where(
        F.col("cue").rlike("^[a-z]+$")
        & F.col("target").rlike("^[a-z]+$")
        & (F.col("cue") != F.col("target"))
    )
    words = vocabulary.select(F.col(word).alias("cue")).distinct()
    return clean.join(words, "cue", "left_semi").join(
        words.withColumnRenamed("cue", "target"), "target", "left_semi"
    ).select(*edges.columns)


def build_edges(lines: DataFrame, vocabulary: DataFrame, value: str = "value") -> DataFrame:
    """Directed edges from raw comma-separated lines.

    Six fields or more; the sixth is the strength, kept when it is a positive number;
    the strongest line per pair wins.
    """
    fields = F.transform(F.split(F.col(value), ","), lambda x: F.trim(x))
    parsed = lines.select(fields.alias("f")).where(F.size("f") >= 6)
    edges = parsed.select(
        F.lower(F.get("f", 0)).alias("cue"),
        F.lower(F.get("f", 1)).alias("target"),
        F.get(F.col("f"), 5).try_cast("double").alias("fsg"),
    )
    edges = edges.where((F.col("fsg") > 0) & ~F.isnan("fsg"))
    best = edges.groupBy("cue", "target").agg(F.max("fsg").alias("fsg"))
    return filter_edges(best, vocabulary)


def edge_coverage(edges: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Vocabulary words that are an end of some edge, and those that are not."""
    ends = (
        edges.select(F.explode(F.array("cue", "target")).alias(word))
        .distinct()
        .withColumn("covered", F.lit(1))
    )
    words = vocabulary.select(word).distinct().join(ends, word, "left")
    return words.agg(
        F.count("*").alias("vocab_words"),
        F.count("covered").alias("covered_vocab_words"),
        (F.count("*") - F.count("covered")).alias("uncovered_vocab_words"),
    )


def join_effects(
    comprehension: DataFrame, scores: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Left join of two effect tables on keys compared as text."""
    right = scores.withColumns({k: F.col(k).cast("string") for k in keys})
    return comprehension.withColumns({k: F.col(k).cast("string") for k in keys}).join(
        right, list(keys), "left"
    )


def join_predictor(shifts: DataFrame, predictor: DataFrame, keys: Sequence[str]) -> DataFrame:
    return shifts.join(predictor, list(keys), "left")


def question_variants(
    df: DataFrame,
    first_template: str,
    extra: Sequence[str],
    values: Mapping[str, Column | str],
    name: str = "question",
) -> DataFrame:
    """One row per question template: the item's own first, then new ones, placeholders filled.

    A template with an unknown placeholder is kept raw.
    """
    own = F.array(F.col(first_template))
    templates = F.filter(
        F.array_distinct(F.concat(own, F.array(*[F.lit(t) for t in extra]))), lambda t: t != ""
    )
    out = df.select("*", F.posexplode(templates).alias("template_rank", "__template"))
    filled = F.col("__template")
    for key, value in values.items():
        filled = F.replace(filled, F.lit("{" + key + "}"), col(value).cast("string"))
    leftover = filled.rlike(r"\{[^{}]*\}")
    return out.withColumn(
        name, F.when(leftover, F.col("__template")).otherwise(filled)
    ).drop("__template")


def pool_tokens(pool_text: Column | str) -> Column:
    return text.plain_tokens(pool_text, "all_punctuation")
