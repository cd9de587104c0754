"""Projections, filters, predicates and validation."""

from pyspark.sql import functions as F

from ..functions import clean, fixed
from ..operators import reshape, validate
from .registry import query


@query(
    "pf01_require_columns",
    """SELECT item_id, line_no, prime_condition FROM item_scores""",
)
def _(t):
    wanted = ["item_id", "line_no", "prime_condition"]
    return validate.require_columns(t.item_scores(), wanted).select(*wanted)


@query(
    "pf02_coerce_strings",
    """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality,
  coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return clean.coerce_strings(rows, ["quality", "toxic"])


@query(
    "pf03_to_number",
    """SELECT event_id, TRY_CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) AS good,
  TRY_CAST(props AS DOUBLE) AS bad, CAST(NULL AS DOUBLE) AS absent FROM events""",
)
def _(t):
    rows = t.events.withColumn("k", F.regexp_replace("props", r'\{"k": |\}', ""))
    return rows.select(
        "event_id",
        clean.to_number(rows, "k").alias("good"),
        clean.to_number(rows, "props").alias("bad"),
        clean.to_number(rows, "no_such_column").alias("absent"),
    )


@query(
    "pf04_canonical_condition",
    """SELECT item_id, line_no, CASE prime_condition_raw WHEN 'passive_prime' THEN 'passive'
  WHEN 'no_demo' THEN 'no_prime' ELSE prime_condition_raw END AS prime_condition FROM item_scores""",
)
def _(t):
    raw = F.concat(F.lit("  "), F.upper("prime_condition_raw"), F.lit(" "))
    return t.item_scores().select(
        "item_id", "line_no", clean.canonical_condition(raw).alias("prime_condition")
    )


@query(
    "pf05_substring_condition",
    """SELECT item_id, line_no, concat('x_', CASE prime_condition_raw WHEN 'passive_prime' THEN 'passive'
  WHEN 'no_demo' THEN 'no_prime' ELSE prime_condition_raw END, '_y') AS prime_condition FROM item_scores""",
)
def _(t):
    aliases = {k: v for k, v in fixed.CONDITION_ALIASES.items() if k != "none"}
    raw = F.concat(F.lit("x_"), F.col("prime_condition_raw"), F.lit("_y"))
    return t.item_scores().select(
        "item_id", "line_no",
        clean.canonical_condition(raw, aliases, "substring").alias("prime_condition"),
    )


@query(
    "pf06_unknown_values",
    """SELECT 'prime_condition' AS column_name, prime_condition_raw AS value, count(*) AS n_rows FROM item_scores
WHERE prime_condition_raw NOT IN ('active', 'passive', 'filler', 'no_prime') GROUP BY 1, 2
UNION ALL SELECT 'lexicality_condition', lexicality_condition, count(*) FROM item_scores
WHERE lexicality_condition NOT IN ('real', 'nonce') GROUP BY 1, 2""",
)
def _(t):
    rows = t.item_scores().withColumn("prime_condition", F.col("prime_condition_raw"))
    return validate.unknown_values(rows, validate.DEFAULT_DOMAINS)


@query(
    "pf07_select_subset",
    """SELECT item_id, line_no, prime_condition, lexicality_condition FROM item_scores
WHERE prime_condition IN ('active', 'passive') AND lexicality_condition IN ('core') AND role_order IN ('agent_first')""",
)
def _(t):
    wanted = {
        "prime_condition": ["active", "passive"],
        "lexicality_condition": ["core"],
        "role_order": ["agent_first"],
    }
    return validate.select_subset(t.item_scores(), wanted).select(
        "item_id", "line_no", "prime_condition", "lexicality_condition"
    )


@query(
    "pf08_normalize_lexicality",
    """SELECT doc_id, CASE WHEN lower(lang) = 'en' THEN 'core' WHEN lower(lang) = 'de' THEN 'jabberwocky'
  WHEN doc_id % 5 = 0 THEN 'mixed' WHEN doc_id % 5 = 1 THEN 'core' WHEN doc_id % 5 = 2 THEN 'jabberwocky'
  WHEN doc_id % 5 = 3 THEN 'other_set' ELSE 'unspecified' END AS lexicality FROM documents""",
)
def _(t):
    label = F.when(F.col("lang") == "en", " Real ").when(F.col("lang") == "de", "NONCE")
    k = F.col("doc_id") % 5
    data = (
        F.when(k == 0, "run/core_targets_jabberwocky_primes")
        .when(k == 1, "Core")
        .when(k == 2, "jabberwocky")
        .when(k == 3, "other_set")
    )
    return t.documents.select(
        "doc_id", clean.normalize_lexicality(label, data).alias("lexicality")
    )


@query(
    "pf09_with_defaults",
    """SELECT item_id, line_no, role_order, 'unspecified' AS task_type, concat('unspecified', '_', 'base') AS run_label
FROM item_scores""",
)
def _(t):
    rows = t.item_scores().select("item_id", "line_no", "role_order")
    return clean.with_defaults(
        rows,
        {
            "role_order": "not_applicable",
            "task_type": "unspecified",
            "run_label": F.concat_ws("_", F.lit("unspecified"), F.lit("base")),
        },
    )


@query(
    "pf10_first_present",
    """SELECT doc_id, coalesce(nullif(trim(lang), ''), source) AS first_filled, source AS first_present FROM documents""",
)
def _(t):
    d = t.documents
    name = clean.first_present(d, ["no_such_column", "source", "lang"])
    return d.select(
        "doc_id",
        clean.first_filled(d, ["missing", "lang", "source"]).alias("first_filled"),
        F.col(name).alias("first_present"),
    )


@query(
    "pf11_item_id",
    """SELECT event_id, concat('exp1_', event_type, '_', lpad(CAST(event_id AS VARCHAR), CAST(greatest(5, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0')) AS item_id FROM events""",
)
def _(t):
    made = clean.item_id(F.lit("exp1"), F.col("event_type"), F.col("event_id"))
    return t.events.select("event_id", made.alias("item_id"))


@query(
    "pf12_index_from_id",
    """SELECT event_id, event_id AS good, CAST(NULL AS BIGINT) AS bad FROM events""",
)
def _(t):
    made = clean.item_id(F.lit("exp1"), F.col("event_type"), F.col("event_id"))
    return t.events.select(
        "event_id",
        clean.index_from_id(made).alias("good"),
        clean.index_from_id(F.concat(made, F.lit("x"))).alias("bad"),
    )


@query(
    "pf13_as_bool",
    """SELECT d.doc_id, coalesce(l.quality = 1, false) AS flag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    value = F.when(F.col("quality") == 1, " Yes ").when(F.col("quality") == 0, "no")
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", clean.as_bool(value).alias("flag"))


@query(
    "pf14_needs_review",
    """SELECT item_index, prime_condition, ((item_index % 3 = 0) OR (item_index * 7) % 6 = 3) AS needed FROM generations""",
)
def _(t):
    rows = t.generations().withColumns(
        {
            "review_remaining_strict": F.when(F.col("item_index") % 3 == 0, "TRUE").otherwise("0"),
            "generation_class_lax": F.when(F.col("item_index") * 7 % 6 == 3, "other").otherwise("active"),
        }
    )
    return rows.select("item_index", "prime_condition", clean.needs_review(rows).alias("needed"))


@query(
    "pf15_drop_nonfinite",
    """SELECT item_id, line_no, R6(active_choice_logprob) AS value FROM item_scores
WHERE line_no NOT IN (1, 2, 3)""",
)
def _(t):
    value = (
        F.when(F.col("line_no") == 1, float("inf"))
        .when(F.col("line_no") == 2, float("nan"))
        .when(F.col("line_no") == 3, float("-inf"))
        .otherwise(F.col("active_choice_logprob"))
    )
    rows = t.item_scores().select("item_id", "line_no", value.alias("value"))
    return clean.drop_nonfinite(rows, ["value"])


@query(
    "pf16_index_key",
    """SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS from_double, CAST(o_orderkey AS VARCHAR) AS from_text,
  CAST(NULL AS VARCHAR) AS from_bad FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        clean.index_key(F.floor("o_totalprice").cast("double")).alias("from_double"),
        clean.index_key(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("from_text"),
        clean.index_key("o_orderpriority").alias("from_bad"),
    )


@query(
    "pf17_class_indicators",
    """SELECT item_id, line_no, CAST(prime_condition = 'active' AS BIGINT) AS is_active,
  CAST(prime_condition = 'passive' AS BIGINT) AS is_passive, CAST(prime_condition = 'other' AS BIGINT) AS is_other,
  CAST((prime_condition = 'active' AND line_no < 4) OR (prime_condition = 'passive') AS BIGINT) AS is_congruent
FROM item_scores""",
)
def _(t):
    cond = F.when((F.col("prime_condition") == "active") & (F.col("line_no") >= 4), "passive").otherwise(
        F.col("prime_condition")
    )
    rows = t.item_scores().withColumn("label", F.col("prime_condition")).withColumn("shown", cond)
    flags = clean.class_indicators("label", condition="shown")
    return rows.select("item_id", "line_no", *[c.alias(n) for n, c in flags.items()])


@query(
    "pf18_choose_structure",
    """SELECT item_id, line_no, CASE WHEN passive_choice_logprob > active_choice_logprob THEN 'passive' ELSE 'active' END AS chosen_structure
FROM item_scores""",
)
def _(t):
    chosen = clean.choose_structure("active_choice_logprob", "passive_choice_logprob")
    return t.item_scores().select("item_id", "line_no", chosen.alias("chosen_structure"))


@query(
    "pf19_pairwise_preference",
    """WITH m AS (SELECT item_id, line_no, active_choice_logprob AS a, passive_choice_logprob AS p,
  active_choice_logprob / greatest(1, active_target_token_count) AS am,
  passive_choice_logprob / greatest(1, passive_target_token_count) AS pm FROM item_scores)
SELECT item_id, line_no, R6(am) AS active_choice_logprob, R6(pm) AS passive_choice_logprob, R6(a - p) AS preference_total,
  R6(am - pm) AS preference_mean, R6(pm - am) AS passive_minus_active_logprob, R6(p - a) AS passive_minus_active_logprob_sum,
  CASE WHEN pm > am THEN 'passive' ELSE 'active' END AS chosen_structure,
  CASE WHEN pm > am THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS passive_choice_indicator FROM m""",
)
def _(t):
    out = clean.pairwise_preference(
        "active_choice_logprob", "passive_choice_logprob",
        "active_target_token_count", "passive_target_token_count",
    )
    return t.item_scores().select("item_id", "line_no", *[c.alias(n) for n, c in out.items()])


@query(
    "pf20_finalize_scores",
    """SELECT item_id, line_no, R6(passive_choice_logprob - active_choice_logprob) AS logodds_passive,
  CAST(NULL AS DOUBLE) AS logodds_passive_sum, CAST(passive_target_token_count - active_target_token_count AS DOUBLE) AS token_count_diff
FROM item_scores""",
)
def _(t):
    return clean.finalize_scores(t.item_scores()).select(
        "item_id", "line_no", "logodds_passive", "logodds_passive_sum", "token_count_diff"
    )


@query(
    "pf21_prime_relation",
    """SELECT item_index, prime_condition, target_voice, question_type, CASE WHEN prime_condition = 'no_prime' THEN 'no_prime'
  WHEN prime_condition = target_voice THEN 'congruent' ELSE 'incongruent' END AS prime_relation FROM role_answers""",
)
def _(t):
    return t.role_answers().select(
        "item_index", "prime_condition", "target_voice", "question_type",
        clean.prime_relation("prime_condition", "target_voice").alias("prime_relation"),
    )


@query(
    "pf22_congruent_shift",
    """SELECT item_id, line_no, R6(CASE prime_condition WHEN 'passive' THEN x WHEN 'active' THEN -x END) AS strict_shift,
  R6(CASE WHEN prime_condition = 'passive' THEN x ELSE -x END) AS lenient_shift
FROM (SELECT *, passive_choice_logprob - active_choice_logprob AS x FROM item_scores) s""",
)
def _(t):
    x = F.col("passive_choice_logprob") - F.col("active_choice_logprob")
    return t.item_scores().select(
        "item_id", "line_no",
        clean.congruent_shift("prime_condition", x).alias("strict_shift"),
        clean.congruent_shift("prime_condition", x, strict=False).alias("lenient_shift"),
    )


@query(
    "pf23_congruent_generation",
    """SELECT item_index, prime_condition, voice, CAST(CASE WHEN prime_condition IN ('active', 'passive') AND voice IN ('active', 'passive')
  THEN CASE WHEN prime_condition = voice THEN 1 ELSE 0 END END AS BIGINT) AS congruent_generation
FROM (SELECT *, CASE item_index % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'passive' ELSE 'other' END AS voice FROM generations) g""",
)
def _(t):
    k = F.col("item_index") % 3
    rows = t.generations().withColumn(
        "voice", F.when(k == 0, "active").when(k == 1, "passive").otherwise("other")
    )
    return rows.select(
        "item_index", "prime_condition", "voice",
        clean.congruent_generation("prime_condition", "voice").alias("congruent_generation"),
    )


@query(
    "pf24_ceiling_flag",
    """SELECT o_orderpriority, R6(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END)) AS accuracy,
  avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) >= 0.33 AS is_near_ceiling, 0.33::DOUBLE AS ceiling_threshold
FROM orders GROUP BY 1""",
)
def _(t):
    rate = F.avg((F.col("o_orderstatus") == "O").cast("int"))
    rows = t.orders.groupBy("o_orderpriority").agg(rate.alias("accuracy"))
    return rows.withColumns(clean.ceiling_flag("accuracy", 0.33))


@query(
    "pf25_load_items",
    """SELECT CAST(item_id AS VARCHAR) AS item_id, line_no, prime_condition,
  CASE lexicality_condition WHEN 'core' THEN 'real' ELSE 'nonce' END AS lexicality_condition,
  CASE WHEN line_no = 1 THEN 'agent_first' ELSE role_order END AS role_order, '' AS notes FROM item_scores""",
)
def _(t):
    raw = t.item_scores().withColumns(
        {
            "prime_condition": F.upper("prime_condition_raw"),
            "lexicality_condition": F.when(F.col("lexicality_condition") == "core", "real").otherwise("nonce"),
            "role_order": F.when(F.col("line_no") != 1, F.col("role_order")),
            **{
                c: F.lit(None).cast("string")
                for c in fixed.ITEM_COLUMNS
                if c not in ("item_id", "model_condition", "prime_condition", "lexicality_condition")
            },
        }
    )
    return validate.load_items(raw).select(
        "item_id", "line_no", "prime_condition", "lexicality_condition", "role_order", "notes"
    )


@query(
    "pf26_rank_filter",
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size BETWEEN 5 AND 20""",
)
def _(t):
    rank = (
        F.when(F.col("p_size") < 5, "")
        .when(F.col("p_size") > 45, "n/a")
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".7")))
    )
    rows = t.part.withColumn("F_rank", rank)
    return clean.rank_filter(rows, "F_rank", 20).select("p_partkey", "p_size")


@query(
    "pf27_select_nouns",
    """SELECT lower(trim(split_part(p_name, ' ', 1))) AS noun, CAST(min(p_size) AS BIGINT) AS best_rank FROM part
WHERE p_size BETWEEN 5 AND 40 GROUP BY 1""",
)
def _(t):
    rows = t.part.withColumn("first_word", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return reshape.select_nouns(rows, "first_word", "p_size", F.col("p_size").between(5, 40))


@query(
    "pf28_candidate_voice",
    """SELECT item_id, line_no, CASE WHEN line_no % 3 = 0 THEN 'active' WHEN line_no % 3 = 1 THEN 'passive' ELSE 'by_slot' END AS voice
FROM item_scores""",
)
def _(t):
    k = F.col("line_no") % 3
    label = F.when(k == 0, "ACTIVE_passive_completion").when(k == 1, "the Passive one")
    return t.item_scores().select(
        "item_id", "line_no", clean.candidate_voice(label, "by_slot").alias("voice")
    )


@query(
    "pf29_normalize_quartets",
    """SELECT pa, pp, ta, tp FROM quartets""",
)
def _(t):
    raw = t.quartets().withColumnsRenamed({"pa": " PA", "pp": "Pp ", "ta": "TA", "tp": " tp "})
    return validate.normalize_quartets(raw)


@query(
    "pf30_condition_order",
    """SELECT o.o_orderkey, c.prime_condition, CAST(c.place AS BIGINT) AS place FROM orders o
CROSS JOIN (SELECT 'passive' AS prime_condition, 0 AS place UNION ALL SELECT 'no_prime', 1 UNION ALL SELECT 'active', 2) c""",
)
def _(t):
    names = validate.condition_order([" Passive_Prime", "no_demo", "none", "active", "passive"])
    pairs = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("place", "prime_condition")
    return t.orders.select("o_orderkey", pairs)


@query(
    "pf31_infer_domain",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'jabberwocky' ELSE 'core' END AS domain FROM documents""",
)
def _(t):
    path = F.when(F.col("doc_id") % 3 == 0, "x/JABBERWOCKY_strict.csv").otherwise("x/core.csv")
    return t.documents.select("doc_id", clean.infer_domain(path, F.col("source")).alias("domain"))
