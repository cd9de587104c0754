"""Corpus audits: every audit is one aggregation over per-row flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.core import literal_map
from .corpus import with_parses
from .joins import has_association, lookup


def _count(flags: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()]


def _nouns(active: str) -> Column:
    return F.array(F.col(f"{active}.agent"), F.col(f"{active}.patient"))


def lexical_overlap(df: DataFrame) -> DataFrame:
    """Rows with the same active verb, a shared noun, both nouns shared; counts and rates."""
    rows = with_parses(df)
    prime, target = _nouns("_pa"), _nouns("_ta")
    flags = {
        "same_active_verb": F.col("_pa.verb") == F.col("_ta.verb"),
        "shared_noun": F.arrays_overlap(prime, target),
        "shared_both_nouns": F.array_sort(F.array_distinct(prime))
        == F.array_sort(F.array_distinct(target)),
    }
    out = [F.count("*").alias("rows_evaluated")]
    for name, flag in flags.items():
        out += [
            F.count_if(flag).alias(f"{name}_rows"),
            F.avg(flag.cast("int")).alias(f"{name}_rate"),
        ]
    return rows.agg(*out)


def strict_flags(
    df: DataFrame,
    lemmas: DataFrame | None = None,
    tenses: DataFrame | None = None,
    index: str = "item_index",
) -> DataFrame:
    """Per row: the parsed parts and one 0/1/2 count per constraint.

    ``lemmas(form, lemma)`` and ``tenses(form, tense)`` are looked up; without them a form
    is its own lemma and its suffix gives the tense.
    """
    rows = with_parses(df).withColumns(
        {"prime_verb": F.col("_pa.verb"), "target_verb": F.col("_ta.verb")}
    )
    none = F.lit(None).cast("string")
    for side in ("prime", "target"):
        verb = f"{side}_verb"
        if lemmas is None:
            rows = rows.withColumn(f"{side}_lemma", F.col(verb))
        else:
            rows = lookup(rows, lemmas, verb, "lemma", f"{side}_lemma", dim_key="form")
        if tenses is None:
            rows = rows.withColumn(f"__{side}_known", none)
        else:
            rows = lookup(rows, tenses, verb, "tense", f"__{side}_known", none, "form")
        rows = rows.withColumn(
            f"{side}_tense", text.verb_tense(verb, F.col(f"__{side}_known"))
        ).drop(f"__{side}_known")
    parsed = (
        F.col("_pa").isNotNull() & F.col("_ta").isNotNull()
        & F.col("_pp").isNotNull() & F.col("_tp").isNotNull()
    )
    prime_family, target_family = text.det_family("_pa.det"), text.det_family("_ta.det")
    unknown = (prime_family == "unknown") | (target_family == "unknown")
    uneven = (text.det_family("_pa.patient_det") != prime_family) | (
        text.det_family("_ta.patient_det") != target_family
    )
    flags = {
        "shared_aux": F.col("_pp.aux") == F.col("_tp.aux"),
        "shared_noun": F.arrays_overlap(_nouns("_pa"), _nouns("_ta")),
        "shared_verb": F.col("prime_lemma") == F.col("target_lemma"),
        "same_det_family": prime_family == target_family,
        "prime_tense_mismatch": text.aux_tense("_pp.aux") != F.col("prime_tense"),
        "target_tense_mismatch": text.aux_tense("_tp.aux") != F.col("target_tense"),
    }
    out = {name: (parsed & flag).cast("int") for name, flag in flags.items()}
    out["det_side_mismatch"] = F.when(
        parsed, unknown.cast("int") + uneven.cast("int")
    ).otherwise(0)
    out["unknown_tokenization"] = (~parsed).cast("int")
    return rows.withColumns(out)


def strict_audit(
    df: DataFrame,
    edges: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    tenses: DataFrame | None = None,
    index: str = "item_index",
) -> DataFrame:
    """Nine violation counts of a paired corpus, semantic association included when ``edges``
    are given."""
    flags = strict_flags(df, lemmas, tenses, index)
    names = (
        "shared_aux", "shared_noun", "shared_verb", "same_det_family", "det_side_mismatch",
        "prime_tense_mismatch", "target_tense_mismatch", "unknown_tokenization",
    )
    counts = flags.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_rows") for n in names])
    if edges is None:
        return counts.withColumn("semantic_association_rows", F.lit(0).cast("bigint"))
    prime = F.array("_pa.agent", "_pa.patient", "prime_lemma")
    target = F.array("_ta.agent", "_ta.patient", "target_lemma")
    linked = has_association(
        flags.where("unknown_tokenization = 0"), index, target, prime, edges
    )
    return counts.withColumn(
        "semantic_association_rows", linked.agg(F.count("*")).scalar()
    )


def strict_preview(df: DataFrame, index: str = "item_index", n: int = 5) -> DataFrame:
    """First rows that break a constraint, with what they share."""
    flags = strict_flags(df, index=index)
    broken = (
        F.col("shared_aux") + F.col("shared_noun") + F.col("shared_verb")
        + F.col("same_det_family") + F.col("prime_tense_mismatch")
        + F.col("target_tense_mismatch") + F.col("unknown_tokenization")
    )
    return (
        flags.where(broken > 0)
        .orderBy(index)
        .limit(n)
        .select(
            index, "prime_lemma", "target_lemma",
            F.array_join(F.array_sort(F.array_distinct(_nouns("_pa"))), ";").alias("prime_nouns"),
            F.array_join(F.array_sort(F.array_distinct(_nouns("_ta"))), ";").alias("target_nouns"),
            F.col("_pp.aux").alias("prime_aux"),
            F.col("_tp.aux").alias("target_aux"),
        )
    )


def opposite_audit(df: DataFrame) -> DataFrame:
    """Six violation counts of a corpus with primes from the opposite cell."""
    rows = with_parses(df)
    return rows.agg(
        *_count(
            {
                "same_aux_rows": F.col("_pp.aux") == F.col("_tp.aux"),
                "same_det_family_rows": text.det_family("_pa.det") == text.det_family("_ta.det"),
                "shared_noun_rows": F.arrays_overlap(_nouns("_pa"), _nouns("_ta")),
                "same_active_verb_rows": F.col("_pa.verb") == F.col("_ta.verb"),
                "prime_tense_mismatch_rows": text.verb_tense("_pa.verb", lenient=True)
                != text.aux_tense("_pp.aux"),
                "target_tense_mismatch_rows": text.verb_tense("_ta.verb", lenient=True)
                != text.aux_tense("_tp.aux"),
            }
        )
    )


def assert_opposite(df: DataFrame) -> DataFrame:
    """Raise when a prime shares its auxiliary or determiner family with its target."""
    row = opposite_audit(df).first()
    if row.same_aux_rows or row.same_det_family_rows:
        raise ValueError(
            f"{row.same_aux_rows} rows share the auxiliary, "
            f"{row.same_det_family_rows} the determiner family"
        )
    return df


def nonce_audit(df: DataFrame) -> DataFrame:
    """Determiner, a/an agreement and repeats; a row counts once per offending noun phrase."""
    rows = with_parses(df)
    phrases = [
        (F.col(f"{side}.{det}"), F.col(f"{side}.{noun}"))
        for side in ("_pa", "_ta")
        for det, noun in (("det", "agent"), ("patient_det", "patient"))
    ]
    unknown, bad = F.lit(0), F.lit(0)
    for det, noun in phrases:
        consonant = noun.rlike("^[bcdfghjklmnpqrstvwxyz]")
        unknown = unknown + F.coalesce((text.det_family(det) == "unknown").cast("int"), F.lit(0))
        wrong = ((det == "a") & ~consonant) | ((det == "an") & consonant)
        bad = bad + F.coalesce(wrong.cast("int"), F.lit(0))
    counts = _count(
        {
            "same_active_fragment_rows": F.col("_pa.verb") == F.col("_ta.verb"),
            "same_aux_rows": F.col("_pp.aux") == F.col("_tp.aux"),
            "same_det_family_rows": text.det_family("_pa.det") == text.det_family("_ta.det"),
            "shared_noun_rows": F.arrays_overlap(_nouns("_pa"), _nouns("_ta")),
        }
    )
    return rows.agg(
        F.sum(unknown).alias("unknown_determiner_rows"),
        F.sum(bad).alias("bad_indefinite_article_uses"),
        *counts,
    )


def _function_words(sentence: str) -> Column:
    return F.array_distinct(
        F.filter(text.split_tokens(sentence), lambda t: t.isin(*fixed.FUNCTION_INVENTORY))
    )


def complex_np_audit(df: DataFrame) -> DataFrame:
    """Overlap of content and function words, preposition groups, per complexity."""
    group = literal_map({p: g for g, ps in fixed.PREPOSITION_GROUPS.items() for p in ps})
    prime = text.parse_active("prime_active")
    base = F.array("target_agent", "target_patient")
    mods = F.filter(F.array("agent_modifier_noun", "patient_modifier_noun"), lambda m: m != "")
    a_prep, p_prep = F.col("agent_modifier_prep"), F.col("patient_modifier_prep")
    a_mod, p_mod = F.col("agent_modifier_noun"), F.col("patient_modifier_noun")
    both = (a_prep != "") & (p_prep != "")
    rows = df.withColumns(
        {
            "_act": F.size(
                F.array_intersect(
                    _function_words("prime_active"), _function_words("target_active_complex")
                )
            ),
            "_pas": F.array_intersect(
                _function_words("prime_passive"), _function_words("target_passive_complex")
            ),
            "_prime": F.array(prime["agent"], prime["patient"]),
        }
    )
    only_by = F.col("_pas") == F.array(F.lit("by"))
    return rows.groupBy("complexity_condition").agg(
        F.count("*").alias("row_count"),
        *_count(
            {
                "content_noun_overlap_rows": F.arrays_overlap("_prime", F.concat(base, mods)),
                "agent_modifier_reuse_rows": (a_mod != "") & F.array_contains(base, a_mod),
                "patient_modifier_reuse_rows": (p_mod != "") & F.array_contains(base, p_mod),
                "same_modifier_rows": (a_mod != "") & (a_mod == p_mod),
                "same_passive_aux_rows": F.col("prime_passive_aux") == F.col("target_passive_aux"),
                "same_det_family_rows": F.col("prime_det_family") == F.col("target_det_family"),
                "same_verb_rows": F.col("prime_verb") == F.col("target_verb"),
                "same_preposition_rows": both & (a_prep == p_prep),
                "semantic_preposition_rows": both & (group[a_prep] == group[p_prep]),
                "uses_by_rows": (a_prep == "by") | (p_prep == "by"),
                "unavoidable_by_rows": only_by,
            }
        ),
        F.sum(
            (F.col("_act") > 0).cast("int")
            + ((F.size("_pas") > 0) & ~only_by).cast("int")
        ).alias("avoidable_function_rows"),
    )


def cell_counts(df: DataFrame, active: str = "ta", passive: str = "tp") -> DataFrame:
    cell = text.cell(text.parse_active(active), text.parse_passive(passive))
    return df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def length_audit(
    left: DataFrame, right: DataFrame, index: str, columns: Sequence[str] = fixed.QUARTET_COLUMNS
) -> DataFrame:
    """Word counts of two aligned corpora per column: min, max, mean, and their differences."""

    def lengths(df, name):
        return df.select(
            index, *[F.size(text.split_tokens(c)).alias(f"{name}_{c}") for c in columns]
        )

    both = lengths(left, "l").join(lengths(right, "r"), index)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"l_{c}").alias("l"), F.col(f"r_{c}").alias("r"))
            for c in columns
        ]
    )
    rows = both.select(F.explode(cells).alias("c")).select("c.*")
    diff = F.col("r") - F.col("l")
    stats = [
        f(c).alias(f"{name}_{side}")
        for side, c in (("left", F.col("l")), ("right", F.col("r")), ("diff", diff))
        for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
    ]
    return rows.groupBy("column_name").agg(
        *stats,
        F.count_if(diff == 0).alias("exact_match_rows"),
        F.count_if(diff != 0).alias("nonzero_diff_rows"),
        F.count_if(diff < 0).alias("negative_diff_rows"),
        F.count_if(diff > 0).alias("positive_diff_rows"),
    )
