"""Reshapes, set operations and vocabularies."""

from pyspark.sql import functions as F

from ..operators import ranking, reshape, validate
from ..sources import tables
from .effects import long_scores
from .registry import query

UNIT = ["model_condition", "lexicality_condition", "item_id"]


@query(
    "rs01_concat_frames",
    """SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(t):
    a = t.customer.select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    b = t.supplier.select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")
    )
    return tables.union_all([a, b])


@query(
    "rs02_dedupe",
    """SELECT model_condition, lexicality_condition, item_id, prime_condition, line_no, role_order FROM (SELECT *, row_number() OVER (PARTITION BY model_condition, lexicality_condition, item_id, prime_condition
  ORDER BY line_no, ts, active_choice_logprob, role_order) AS k FROM item_scores) x WHERE k = 1""",
)
def _(t):
    keys = [*UNIT, "prime_condition"]
    order = [F.col(c) for c in ("line_no", "ts", "active_choice_logprob", "role_order")]
    return ranking.dedupe(t.item_scores(), keys, order).select(*keys, "line_no", "role_order")


@query("rs03_dedupe_rows", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return reshape.dedupe_rows(t.documents, ["lang", "no_such_column", "source"])


@query(
    "rs04_duplicate_keys",
    """SELECT item_id, prime_condition, count(*) AS n_rows FROM item_scores GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(t):
    return validate.duplicate_keys(t.item_scores(), ["item_id", "prime_condition"])


_CONDITIONS = ["active", "passive", "filler", "no_prime"]


def _wide(values, fill=None):
    cells = [
        f"R6({'coalesce(' if fill is not None else ''}avg(CASE WHEN prime_condition = '{c}' THEN {v} END){f', {fill})' if fill is not None else ''}) AS {v}_{c}"
        for v in values
        for c in _CONDITIONS
    ]
    return ", ".join(cells)


@query(
    "rs05_to_wide",
    f"SELECT model_condition, lexicality_condition, item_id, {_wide(['active_choice_logprob'])} FROM item_scores GROUP BY 1, 2, 3",
)
def _(t):
    return reshape.to_wide(
        t.item_scores(), UNIT, "prime_condition", ["active_choice_logprob"], _CONDITIONS
    )


@query(
    "rs06_to_wide_two_keys",
    "SELECT item_id, lexicality_condition, "
    + ", ".join(
        f"R6(avg(CASE WHEN prime_condition = '{p}' THEN {v}_choice_logprob END)) AS logp_{v}_target_given_{p}_prime_mean"
        for v in ("active", "passive")
        for p in _CONDITIONS
    )
    + " FROM item_scores GROUP BY 1, 2",
)
def _(t):
    from ..operators import effects

    return effects.spread_scores(
        long_scores(t), ["item_id", "lexicality_condition"], "target_logprob_mean"
    )


@query(
    "rs07_to_wide_many_filled",
    f"SELECT item_id, {_wide(['active_choice_logprob', 'passive_choice_logprob'], '0.0')} FROM item_scores GROUP BY 1",
)
def _(t):
    return reshape.to_wide(
        t.item_scores(), ["item_id"], "prime_condition",
        ["active_choice_logprob", "passive_choice_logprob"], _CONDITIONS, fill=0.0,
    )


@query(
    "rs08_to_long",
    """SELECT item_id, line_no, 'active_choice_logprob' AS measure, R6(active_choice_logprob) AS value FROM item_scores
UNION ALL SELECT item_id, line_no, 'passive_choice_logprob', R6(passive_choice_logprob) FROM item_scores""",
)
def _(t):
    return reshape.to_long(
        t.item_scores(), ["item_id", "line_no"], ["active_choice_logprob", "passive_choice_logprob"]
    )


@query(
    "rs09_to_long_by_pattern",
    """SELECT item_id, line_no, 'active' AS target_voice, R6(active_choice_logprob) AS mean, R6(active_choice_logprob * 3) AS "sum" FROM item_scores
UNION ALL SELECT item_id, line_no, 'passive', R6(passive_choice_logprob), R6(passive_choice_logprob * 3) FROM item_scores""",
)
def _(t):
    rows = t.item_scores().select(
        "item_id", "line_no",
        *[
            (F.col(f"{v}_choice_logprob") * k).alias(f"pe_{v}_target_logprob_{m}_same_minus_other")
            for v in ("active", "passive")
            for m, k in (("mean", 1), ("sum", 3))
        ],
    )
    names = reshape.columns_by_pattern(
        rows.columns, r"pe_(active|passive)_target_logprob_(mean|sum)_same_minus_other"
    )
    return reshape.to_long_by_pattern(rows, ["item_id", "line_no"], names, "target_voice")


@query(
    "rs10_prompts_to_rows",
    """SELECT item_index, 'prompt_active' AS prompt_column, 'active' AS prime_condition, pa AS prompt FROM quartets UNION ALL SELECT item_index, 'prompt_passive', 'passive', pp FROM quartets
UNION ALL SELECT item_index, 'prompt_no_prime', 'no_prime', CASE WHEN item_index % 2 = 0 THEN ta ELSE tp END FROM quartets""",
)
def _(t):
    rows = t.quartets().select(
        "item_index", F.col("pa").alias("prompt_active"), F.col("pp").alias("prompt_passive"),
        F.when(F.col("item_index") % 2 == 0, F.col("ta")).alias("prompt_no_prime"),
        F.col("tp").alias("prompt_no_demo"),
    )
    return reshape.prompts_to_rows(
        rows, ["item_index"],
        {
            "prompt_active": ["prompt_active"],
            "prompt_passive": ["prompt_passive"],
            "prompt_no_prime": ["prompt_no_prime", "prompt_no_demo"],
        },
    )


@query(
    "rs11_primes_to_rows",
    """SELECT item_index, 'active' AS prime_condition, pa AS prime_sentence, concat('Event ', item_index, '. Mary answered, "') AS prime_context, pa AS declared_prime_sentence, true AS prime_sentence_matches_column FROM quartets
UNION ALL SELECT item_index, 'passive', pp, concat('Event ', item_index, '. Mary answered, "'), ta, rtrim(pp, ' .') = rtrim(ta, ' .') FROM quartets""",
)
def _(t):
    def prompt(c):
        return F.concat(
            F.lit("Event "), F.col("item_index").cast("string"), F.lit('. Mary answered, "'), F.col(c),
            F.lit('" Then Mary answered, "The'),
        )

    rows = t.quartets().select(
        "item_index", prompt("pa").alias("prompt_active"), prompt("pp").alias("prompt_passive"),
        F.col("pa").alias("prime_active_sentence"), F.col("ta").alias("prime_passive_sentence"),
    )
    return reshape.primes_to_rows(rows, ["item_index"])


@query("rs12_order_columns", "SELECT doc_id, source, lang, n_chars FROM documents")
def _(t):
    return tables.order_columns(
        t.documents.drop("text"), ["doc_id", "absent", "source"]
    )


@query(
    "rs13_content_words",
    """SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) x
WHERE regexp_full_match(w, '[a-z]+') AND w NOT IN ('the', 'a', 'an', 'is', 'was', 'by', '.')""",
)
def _(t):
    return reshape.content_words(t.documents, ["text"])


@query(
    "rs14_vocab_union",
    """SELECT DISTINCT word FROM (SELECT lower(trim(c_mktsegment)) AS word FROM customer UNION ALL SELECT lower(trim(n_name)) FROM nation UNION ALL SELECT lower(trim(r_name)) FROM region
UNION ALL SELECT lower(trim(lang)) FROM documents UNION ALL SELECT lower(trim(source)) FROM documents) x WHERE regexp_full_match(word, '[a-z]+')""",
)
def _(t):
    return reshape.vocab_union(
        [
            (t.customer, ["c_mktsegment"]), (t.nation, ["n_name"]), (t.region, ["r_name"]),
            (t.documents, ["lang", "source"]),
        ]
    )

