"""Group summaries."""

from pyspark.sql import functions as F

from ..functions import clean, labels, text
from ..operators import audits, corpus, joins, neighbors, ranking, review, summaries, validate, vectors
from ..sources.shared import materialize
from .registry import query

GROUP = ["model_condition", "lexicality_condition"]


def _scores(t):
    """Item scores with the standard measures."""
    a, p = F.col("active_choice_logprob"), F.col("passive_choice_logprob")
    return t.item_scores().withColumns(
        {
            "preference_total": a - p,
            "passive_minus_active_logprob": p - a,
            "chosen_structure": clean.choose_structure(a, p),
            "logodds_passive": p - a,
        }
    )


_SCORES = """(SELECT *, active_choice_logprob - passive_choice_logprob AS preference_total,
  passive_choice_logprob - active_choice_logprob AS passive_minus_active_logprob,
  passive_choice_logprob - active_choice_logprob AS logodds_passive,
  CASE WHEN passive_choice_logprob > active_choice_logprob THEN 'passive' ELSE 'active' END AS chosen_structure
  FROM item_scores) s"""


@query(
    "ag01_summarize",
    f"""SELECT model_condition, prime_condition, count(*) AS n_rows, R6(avg(preference_total)) AS preference_total_mean,
  R6(stddev_samp(preference_total)) AS preference_total_std, R6(stddev_samp(preference_total) / sqrt(count(*))) AS preference_total_se,
  R6(avg(active_choice_logprob)) AS active_choice_logprob_mean, R6(stddev_samp(active_choice_logprob)) AS active_choice_logprob_std,
  R6(stddev_samp(active_choice_logprob) / sqrt(count(*))) AS active_choice_logprob_se
FROM {_SCORES} GROUP BY 1, 2""",
)
def _(t):
    return summaries.summarize(
        _scores(t), ["model_condition", "prime_condition"],
        ["preference_total", "active_choice_logprob"],
    )


_MEASURES = ["preference_total", "active_choice_logprob", "passive_choice_logprob"]


@query(
    "ag02_summarize_measures",
    "\nUNION ALL ".join(
        f"""SELECT model_condition, lexicality_condition, prime_condition, '{m}' AS measure, count(x) AS n_rows, R6(avg(x)) AS mean,
  R6(stddev_samp(x)) AS std, R6(stddev_samp(x) / sqrt(nullif(count(x), 0))) AS se
FROM (SELECT *, CASE WHEN line_no <> 5 THEN {m} END AS x FROM {_SCORES}) q GROUP BY 1, 2, 3"""
        for m in _MEASURES
    ),
)
def _(t):
    rows = _scores(t).withColumns(
        {m: F.when(F.col("line_no") != 5, F.col(m)) for m in _MEASURES}
    )
    return summaries.summarize_measures(rows, [*GROUP, "prime_condition"], _MEASURES)


_SETS = {
    "by_model": ["model_condition"],
    "by_prime": ["model_condition", "prime_condition"],
    "by_lexicality": ["model_condition", "lexicality_condition"],
    "by_task": [],
    "by_role_order": ["model_condition", "prime_condition", "role_order"],
}
_KEYS = ["model_condition", "prime_condition", "lexicality_condition", "role_order"]


@query(
    "ag03_standard_summaries",
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS summary, {', '.join(k if k in cols else f'CAST(NULL AS VARCHAR) AS {k}' for k in _KEYS)},
  CAST(count(*) AS BIGINT) AS n_rows, R6(avg(preference_total)) AS preference_total_mean, R6(stddev_samp(preference_total)) AS preference_total_std,
  R6(stddev_samp(preference_total) / sqrt(count(*))) AS preference_total_se
FROM {_SCORES} {'GROUP BY ' + ', '.join(cols) if cols else ''}"""
        for name, cols in _SETS.items()
    ),
)
def _(t):
    return summaries.standard_summaries(_scores(t), _SETS, ["preference_total"])


def _answers(t):
    return review.score_answers(t.role_answers(), "answer_raw", "correct_head", "foil_head")


# What the labelling of the answer binding amounts to: the raw answer names one head,
# the other, or both; equal heads are both correct and foil.
ANSWERS = """(SELECT *, CASE WHEN c AND f THEN 'ambiguous' WHEN c THEN 'correct' WHEN f THEN 'foil' ELSE 'other' END AS matched_label
FROM (SELECT *, list_contains(regexp_extract_all(lower(answer_raw), '[a-z]+'), correct_head) AS c,
  list_contains(regexp_extract_all(lower(answer_raw), '[a-z]+'), foil_head) AS f FROM role_answers) x) s"""
_ACC = """count(*) AS n_items, R6(avg(CASE WHEN matched_label = 'correct' THEN 1.0 ELSE 0.0 END)) AS accuracy,
  CAST(count_if(matched_label = 'correct') AS BIGINT) AS correct_n, CAST(count_if(matched_label = 'foil') AS BIGINT) AS foil_n,
  CAST(count_if(matched_label = 'ambiguous') AS BIGINT) AS ambiguous_n, CAST(count_if(matched_label = 'other') AS BIGINT) AS other_n"""


@query(
    "ag04_accuracy_summary",
    f"SELECT lexicality_condition, prime_condition, target_voice, {_ACC} FROM {ANSWERS} GROUP BY 1, 2, 3",
)
def _(t):
    return summaries.accuracy_summary(
        _answers(t), ["lexicality_condition", "prime_condition", "target_voice"]
    )


def _rate(cond):
    return f"avg(CASE WHEN {cond} THEN CASE WHEN matched_label = 'correct' THEN 1.0 ELSE 0.0 END END)"


def _foil(cond):
    return f"avg(CASE WHEN {cond} THEN CASE WHEN matched_label = 'foil' THEN 1.0 ELSE 0.0 END END)"


@query(
    "ag05_baseline_vs_primed",
    f"""WITH m AS (SELECT lexicality_condition, count(*) AS n_items,
  {_rate("prime_condition = 'active'")} AS a, {_rate("prime_condition = 'passive'")} AS p,
  {_rate("prime_condition = 'filler'")} AS f, {_rate("prime_condition = 'no_prime'")} AS n,
  {_rate("prime_condition = 'no_prime' AND target_voice = 'active'")} AS na, {_rate("prime_condition = 'no_prime' AND target_voice = 'passive'")} AS np,
  {_rate("prime_condition = 'filler' AND target_voice = 'active'")} AS fa, {_rate("prime_condition = 'filler' AND target_voice = 'passive'")} AS fp,
  {_foil("prime_condition = 'no_prime' AND target_voice = 'passive'")} AS fnp, {_foil("prime_condition = 'filler' AND target_voice = 'passive'")} AS ffp
  FROM {ANSWERS} GROUP BY 1)
SELECT lexicality_condition, n_items, R6(a) AS accuracy_active_prime, R6(p) AS accuracy_passive_prime, R6(f) AS accuracy_filler, R6(n) AS accuracy_no_prime,
  R6(a - p) AS priming_active_minus_passive, R6(a - n) AS active_minus_no_prime, R6(p - n) AS passive_minus_no_prime,
  R6(a - f) AS active_minus_filler, R6(p - f) AS passive_minus_filler,
  R6(na) AS accuracy_no_prime_active_target, R6(np) AS accuracy_no_prime_passive_target,
  R6(fa) AS accuracy_filler_active_target, R6(fp) AS accuracy_filler_passive_target,
  R6(np - na) AS baseline_no_prime_passive_minus_active, R6(fp - fa) AS baseline_filler_passive_minus_active,
  R6(fnp) AS foil_rate_no_prime_passive_target, R6(ffp) AS foil_rate_filler_passive_target FROM m""",
)
def _(t):
    return summaries.baseline_vs_primed(_answers(t), ["lexicality_condition"])


@query(
    "ag06_ceiling_diagnostics",
    f"""SELECT *, accuracy >= 0.25 AS is_near_ceiling, 0.25::DOUBLE AS ceiling_threshold
FROM (SELECT lexicality_condition, prime_condition, target_voice, question_type, {_ACC} FROM {ANSWERS} GROUP BY 1, 2, 3, 4) g""",
)
def _(t):
    keys = ["lexicality_condition", "prime_condition", "target_voice", "question_type"]
    return summaries.ceiling_diagnostics(_answers(t), keys, 0.25)


# The template a generated sentence came from decides its class; see the binding.
_VOICE = """(SELECT *, CASE (item_index * 7 + CASE prime_condition WHEN 'active' THEN 0 WHEN 'filler' THEN 1 WHEN 'no_prime' THEN 2 ELSE 3 END) % 6
  WHEN 0 THEN 'active' WHEN 1 THEN 'passive' WHEN 5 THEN 'active' WHEN 2 THEN 'passive' ELSE 'other' END AS voice,
  length(generated) % 2 = 0 AS reviewed FROM generations) s"""


def _voices(t):
    k = F.expr("CASE prime_condition WHEN 'active' THEN 0 WHEN 'filler' THEN 1 WHEN 'no_prime' THEN 2 ELSE 3 END")
    slot = (F.col("item_index") * 7 + k) % 6
    voice = F.when(slot.isin(0, 5), "active").when(slot.isin(1, 2), "passive").otherwise("other")
    return t.generations().withColumns(
        {"voice": voice, "reviewed": F.length("generated") % 2 == 0}
    )


@query(
    "ag07_label_shares",
    f"""SELECT *, R6(n_items * 1.0 / total_items) AS share FROM (SELECT *, CAST(sum(n_items) OVER (PARTITION BY prompt_column, prime_condition) AS BIGINT) AS total_items
FROM (SELECT prompt_column, prime_condition, voice, count(*) AS n_items FROM {_VOICE} GROUP BY 1, 2, 3) c) d""",
)
def _(t):
    return summaries.label_shares(_voices(t), "voice")


_RATES = """count(*) AS n_items, R6(avg(CAST(voice = 'active' AS INT))) AS active_rate, R6(avg(CAST(voice = 'passive' AS INT))) AS passive_rate,
  R6(avg(CAST(voice = 'other' AS INT))) AS other_rate, R6(avg(CAST(prime_condition IN ('active', 'passive') AND prime_condition = voice AS INT))) AS congruent_rate"""


@query(
    "ag08_class_rates",
    f"""SELECT prompt_column, prime_condition, {_RATES}, R6(avg(CAST(reviewed AS INT))) AS reviewed_rate FROM {_VOICE} GROUP BY 1, 2""",
)
def _(t):
    return summaries.class_rates(_voices(t), "voice", reviewed="reviewed")


@query(
    "ag09_class_rates_by_role_order",
    f"""SELECT prompt_column, prime_condition, role_order, {_RATES} FROM {_VOICE} GROUP BY 1, 2, 3""",
)
def _(t):
    by = ["prompt_column", "prime_condition", "role_order"]
    return summaries.class_rates(_voices(t), "voice", by)


# Class of a generated sentence against its targets, for the six templates of the binding.
CLASSES = """(SELECT *, CASE WHEN generated = target_active THEN 'active_exact' WHEN generated = target_passive THEN 'passive_exact' ELSE 'other' END AS generation_class FROM generations) s"""


@query(
    "ag10_quality_rates",
    f"""SELECT prompt_column, prime_condition, count(*) AS n_items, R6(avg(CAST(generation_class = 'active_exact' AS INT))) AS active_like_rate,
  R6(avg(CAST(generation_class = 'passive_exact' AS INT))) AS passive_like_rate, R6(avg(CAST(generation_class <> 'other' AS INT))) AS exact_rate,
  0.0::DOUBLE AS prefix_rate, 0.0::DOUBLE AS structural_rate,
  R6(avg(CAST((prime_condition = 'active' AND generation_class = 'active_exact') OR (prime_condition = 'passive' AND generation_class = 'passive_exact') AS INT))) AS congruent_rate
FROM {CLASSES} GROUP BY 1, 2""",
)
def _(t):
    rows = t.generations().withColumn(
        "generation_class",
        labels.classify_structure("generated", "target_active", "target_passive"),
    )
    return summaries.quality_rates(rows, "generation_class")


_CHOICE = f"""SELECT lexicality_condition, prime_condition, count(*) AS n_items, CAST(count_if(chosen_structure = 'active') AS BIGINT) AS n_active_choice,
  CAST(count_if(chosen_structure = 'passive') AS BIGINT) AS n_passive_choice, count_if(chosen_structure = 'active') / count(*) AS active_choice_rate,
  count_if(chosen_structure = 'passive') / count(*) AS passive_choice_rate, avg(passive_minus_active_logprob) AS mean_passive_minus_active_logprob,
  coalesce(stddev_samp(passive_minus_active_logprob), 0) AS sd_passive_minus_active_logprob FROM {_SCORES} GROUP BY 1, 2"""


@query(
    "ag11_choice_summary",
    f"""SELECT lexicality_condition, prime_condition, n_items, n_active_choice, n_passive_choice, R6(active_choice_rate) AS active_choice_rate,
  R6(passive_choice_rate) AS passive_choice_rate, R6(mean_passive_minus_active_logprob) AS mean_passive_minus_active_logprob,
  R6(sd_passive_minus_active_logprob) AS sd_passive_minus_active_logprob FROM ({_CHOICE}) c""",
)
def _(t):
    return summaries.choice_summary(_scores(t), ["lexicality_condition", "prime_condition"])


@query(
    "ag12_condition_contrasts",
    f"""WITH c AS ({_CHOICE}), k AS (SELECT *, CASE prime_condition WHEN 'active' THEN 0 WHEN 'passive' THEN 1 WHEN 'no_prime' THEN 2 ELSE 3 END AS r FROM c)
SELECT a.lexicality_condition, a.prime_condition AS condition_a, b.prime_condition AS condition_b,
  R6(a.passive_choice_rate) AS passive_choice_rate_a, R6(b.passive_choice_rate) AS passive_choice_rate_b,
  R6(b.passive_choice_rate - a.passive_choice_rate) AS passive_choice_rate_diff_b_minus_a,
  R6(a.mean_passive_minus_active_logprob) AS mean_logprob_a, R6(b.mean_passive_minus_active_logprob) AS mean_logprob_b,
  R6(b.mean_passive_minus_active_logprob - a.mean_passive_minus_active_logprob) AS mean_logprob_diff_b_minus_a
FROM k a JOIN k b ON a.lexicality_condition = b.lexicality_condition AND b.r > a.r""",
)
def _(t):
    summary = summaries.choice_summary(_scores(t), ["lexicality_condition", "prime_condition"])
    return summaries.condition_contrasts(
        summary, ["lexicality_condition"], "prime_condition",
        ["active", "passive", "no_prime", "filler"],
        {
            "passive_choice_rate": "passive_choice_rate",
            "mean_logprob": "mean_passive_minus_active_logprob",
        },
    )


def _effects_sql(measure):
    means = ", ".join(
        f"avg(CASE WHEN prime_condition = '{c}' THEN {measure} END) AS {c}"
        for c in ("active", "passive", "filler", "no_prime")
    )
    return f"""SELECT model_condition, lexicality_condition, '{measure}' AS measure, R6(active) AS active_mean, R6(passive) AS passive_mean, R6(filler) AS filler_mean,
  R6(no_prime) AS no_prime_mean, R6(active - passive) AS priming_effect_active_minus_passive, R6(active - no_prime) AS active_minus_no_prime,
  R6(passive - no_prime) AS passive_minus_no_prime, R6(active - filler) AS active_minus_filler, R6(passive - filler) AS passive_minus_filler
FROM (SELECT model_condition, lexicality_condition, {means} FROM {_SCORES} GROUP BY 1, 2) m"""


@query(
    "ag13_priming_effects",
    f"SELECT * EXCLUDE (measure) FROM ({_effects_sql('preference_total')}) e",
)
def _(t):
    return summaries.priming_effects(_scores(t), GROUP, "preference_total")


@query("ag14_priming_effects_all", "\nUNION ALL ".join(_effects_sql(m) for m in _MEASURES))
def _(t):
    return summaries.priming_effects_all(_scores(t), GROUP, _MEASURES)


def missing(df):
    value = F.when(F.col("line_no") != 6, F.col("active_choice_logprob"))
    return df.withColumn("value", value)


@query(
    "ag25_scored_bias_by_verb",
    f"""SELECT lexicality_condition, role_order, count(*) AS n_items, R6(avg(logodds_passive)) AS mean_logodds_passive,
  R6(stddev_samp(logodds_passive)) AS sd_logodds_passive, R6(avg(2 * logodds_passive)) AS mean_logodds_passive_sum,
  R6(avg(passive_target_token_count - active_target_token_count)) AS mean_token_count_diff
FROM {_SCORES} WHERE prime_condition = 'no_prime' GROUP BY 1, 2""",
)
def _(t):
    rows = _scores(t).where(F.col("prime_condition") == "no_prime").withColumns(
        {
            "logodds_passive_sum": 2 * F.col("logodds_passive"),
            "token_count_diff": F.col("passive_target_token_count") - F.col("active_target_token_count"),
        }
    )
    return summaries.scored_bias_by_verb(rows, ["lexicality_condition", "role_order", "absent"])


def labelled(t):
    rows = labels.label_structure(t.generations(), "generated")
    rows = labels.label_arguments(rows, "generated")
    return labels.add_binary_classes(rows)


_LAX = """(SELECT *, CASE (item_index * 7 + CASE prime_condition WHEN 'active' THEN 0 WHEN 'filler' THEN 1 WHEN 'no_prime' THEN 2 ELSE 3 END) % 6
  WHEN 0 THEN 'active' WHEN 1 THEN 'passive' WHEN 2 THEN 'passive' ELSE 'other' END AS lax,
  CASE (item_index * 7 + CASE prime_condition WHEN 'active' THEN 0 WHEN 'filler' THEN 1 WHEN 'no_prime' THEN 2 ELSE 3 END) % 6
  WHEN 0 THEN 'active' WHEN 1 THEN 'passive' ELSE 'other' END AS strict, split_part(target_active, ' ', 3) AS verb FROM generations) s"""
_BIAS = f"""SELECT item_index, verb, count(*) AS n_outputs, CAST(count_if(lax = 'active') AS BIGINT) AS n_active_lax, CAST(count_if(lax = 'passive') AS BIGINT) AS n_passive_lax,
  CAST(count_if(lax = 'other') AS BIGINT) AS n_other_lax, CAST(count_if(strict = 'active') AS BIGINT) AS n_active_strict,
  CAST(count_if(strict = 'passive') AS BIGINT) AS n_passive_strict, CAST(count_if(strict = 'other') AS BIGINT) AS n_other_strict FROM {_LAX} GROUP BY 1, 2"""
_BIAS_RATES = f"""SELECT *, n_active_lax + n_passive_lax AS n_classifiable_lax, n_active_lax / n_outputs AS ra, n_passive_lax / n_outputs AS rp, n_other_lax / n_outputs AS ro,
  n_active_lax / nullif(n_active_lax + n_passive_lax, 0) AS ca, n_passive_lax / nullif(n_active_lax + n_passive_lax, 0) AS cp,
  ln((n_passive_lax + 0.5) / (n_active_lax + 0.5)) AS lo, ln((n_passive_lax + 0.5) / (n_active_lax + n_other_lax + 0.5)) AS ln FROM ({_BIAS}) b"""


def _bias(t):
    rows = labelled(t).withColumn("verb", F.split_part("target_active", F.lit(" "), F.lit(3)))
    return summaries.generation_bias(
        rows, ["item_index", "verb", "absent"], "generation_class_lax", "generation_class_strict"
    )


@query(
    "ag23_generation_bias",
    f"""SELECT item_index, verb, n_outputs, n_active_lax, n_passive_lax, n_other_lax, n_active_strict, n_passive_strict, n_other_strict, n_classifiable_lax,
  R6(ra) AS active_rate_all_lax, R6(rp) AS passive_rate_all_lax, R6(ro) AS other_rate_all_lax, R6(ca) AS active_rate_classifiable_lax,
  R6(cp) AS passive_rate_classifiable_lax, R6(lo) AS passive_vs_active_logodds_lax, R6(ln) AS passive_vs_nonpassive_logodds_lax FROM ({_BIAS_RATES}) r""",
)
def _(t):
    return _bias(t)


@query(
    "ag24_generation_bias_by_verb",
    f"""SELECT verb, count(*) AS n_items, CAST(sum(n_outputs) AS BIGINT) AS n_outputs, CAST(sum(n_active_lax) AS BIGINT) AS n_active_lax,
  CAST(sum(n_passive_lax) AS BIGINT) AS n_passive_lax, CAST(sum(n_other_lax) AS BIGINT) AS n_other_lax,
  R6(avg(rp)) AS mean_passive_rate_all_lax, R6(avg(cp)) AS mean_passive_rate_classifiable_lax,
  R6(avg(lo)) AS mean_passive_vs_active_logodds_lax, R6(avg(ln)) AS mean_passive_vs_nonpassive_logodds_lax FROM ({_BIAS_RATES}) r GROUP BY 1""",
)
def _(t):
    return summaries.generation_bias_by_verb(_bias(t), ["verb"])


@query(
    "ag28_similarity_summary",
    """WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.vec_id, a.label, list_cosine_similarity(a.e, b.e) AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC) AS r FROM q a JOIN q b ON a.label = 0 AND b.label <> 0),
k AS (SELECT vec_id, max(s) AS mx, avg(s) AS mk FROM c WHERE r <= 5 GROUP BY 1)
SELECT 'nonce' AS query_type, count(*) AS n_words, R6(avg(mx)) AS mean_max_cosine, R6(max(mx)) AS max_max_cosine, R6(avg(mk)) AS mean_topk_cosine FROM k""",
)
def _(t):
    e = t.embeddings
    near = vectors.cosine_topk(e.where("label = 0"), e.where("label <> 0"), "vec_id", "embedding", 5)
    return summaries.similarity_summary(near.withColumn("query_type", F.lit("nonce")), ["query_type"])


@query(
    "ag29_lexicon_summary",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations),
r AS (SELECT word FROM b UNION SELECT word FROM c),
blk AS (SELECT DISTINCT substr(word, 1, 1) AS i, length(word) AS n FROM r),
lonely AS (SELECT word FROM w WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.i = substr(w.word, 1, 1) AND abs(blk.n - length(w.word)) <= 2)),
p AS (SELECT w.word, min(levenshtein(w.word, r.word)) AS d FROM w JOIN r ON substr(w.word, 1, 1) = substr(r.word, 1, 1)
  AND abs(length(w.word) - length(r.word)) <= 2 AND w.word <> r.word GROUP BY 1
  UNION ALL SELECT l.word, min(levenshtein(l.word, r.word)) FROM lonely l JOIN r ON abs(length(l.word) - length(r.word)) <= 2 AND l.word <> r.word GROUP BY 1),
st AS (SELECT word, unnest([CASE WHEN word LIKE '%ed' AND length(word) > 3 THEN left(word, -2) END,
  CASE WHEN word LIKE '%ied' AND length(word) > 3 THEN concat(left(word, -3), 'y') END,
  CASE WHEN word LIKE '%es' AND length(word) > 3 THEN left(word, -2) END, CASE WHEN word LIKE '%s' AND length(word) > 2 THEN left(word, -1) END,
  CASE WHEN word LIKE '%es' AND length(word) > 2 THEN left(word, -2) END, CASE WHEN word LIKE '%ing' AND length(word) > 4 THEN left(word, -3) END]) AS stem FROM w),
sb AS (SELECT DISTINCT st.word FROM st JOIN b ON st.stem = b.word WHERE st.stem <> st.word),
sc AS (SELECT DISTINCT st.word FROM st JOIN c ON st.stem = c.word WHERE st.stem <> st.word)
SELECT count(*) AS n_content_words, CAST(count_if(w.word IN (SELECT word FROM b)) AS BIGINT) AS n_exact_english,
  CAST(count_if(w.word IN (SELECT word FROM c)) AS BIGINT) AS n_exact_controlled,
  CAST(count_if(w.word IN (SELECT word FROM sb)) AS BIGINT) AS n_english_stem_overlap,
  CAST(count_if(w.word IN (SELECT word FROM sc)) AS BIGINT) AS n_controlled_stem_overlap,
  CAST(count_if(p.d <= 1) AS BIGINT) AS n_distance_le_1, CAST(count_if(p.d <= 2) AS BIGINT) AS n_distance_le_2
FROM w LEFT JOIN p ON w.word = p.word""",
)
def _(t):
    def vocabulary(df):
        found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
        return df.select(F.explode(F.array_distinct(found)).alias("word")).distinct()

    audit = neighbors.lexicon_audit(
        vocabulary(t.documents), vocabulary(t.benchmark), vocabulary(t.conversations)
    )
    return neighbors.lexicon_summary(audit)


@query(
    "ag30_balance_table",
    """SELECT model_condition, lexicality_condition, prime_condition, role_order, count(*) AS n FROM item_scores GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return summaries.balance_table(
        t.item_scores(), ["model_condition", "lexicality_condition", "prime_condition", "role_order"]
    )


@query(
    "ag30_balance_tables",
    """SELECT 'prime' AS table_name, prime_condition, CAST(NULL AS VARCHAR) AS role_order, CAST(count(*) AS BIGINT) AS n FROM item_scores GROUP BY prime_condition
UNION ALL SELECT 'role', NULL, role_order, CAST(count(*) AS BIGINT) FROM item_scores GROUP BY role_order
UNION ALL SELECT 'both', prime_condition, role_order, CAST(count(*) AS BIGINT) FROM item_scores GROUP BY prime_condition, role_order""",
)
def _(t):
    return summaries.balance_tables(
        t.item_scores(),
        {"prime": ["prime_condition"], "role": ["role_order"], "both": ["prime_condition", "role_order"]},
    )


@query(
    "ag31_missing_summary",
    """SELECT model_condition, count(*) AS n, CAST(count_if(line_no = 6) AS BIGINT) AS n_missing,
  R6(avg(CASE WHEN line_no <> 6 THEN active_choice_logprob END)) AS mean FROM item_scores GROUP BY 1""",
)
def _(t):
    return summaries.missing_summary(missing(t.item_scores()), "value", ["model_condition"])


@query(
    "ag32_binomial_cells",
    f"""SELECT lexicality_condition, target_voice, question_type, CAST(count_if(matched_label = 'correct') AS BIGINT) AS correct, count(*) AS total,
  CAST(count_if(matched_label <> 'correct') AS BIGINT) AS incorrect FROM {ANSWERS} GROUP BY 1, 2, 3""",
)
def _(t):
    return summaries.binomial_cells(
        _answers(t), ["lexicality_condition", "target_voice", "question_type"], "is_correct"
    )


@query(
    "ag33_within_share",
    f"""SELECT lexicality_condition, question_type, matched_label, n, R6(n / sum(n) OVER (PARTITION BY lexicality_condition, question_type)) AS prop
FROM (SELECT lexicality_condition, question_type, matched_label, count(*) AS n FROM {ANSWERS} GROUP BY 1, 2, 3) c""",
)
def _(t):
    return summaries.within_share(
        _answers(t), ["lexicality_condition", "question_type"], "matched_label"
    )


@query(
    "ag34_class_rate_wide",
    f"""SELECT prime_condition, active, passive, active + passive AS total, R6(active / nullif(active + passive, 0)) AS active_rate,
  R6(passive / nullif(active + passive, 0)) AS passive_rate
FROM (SELECT prime_condition, CAST(count_if(voice = 'active') AS BIGINT) AS active, CAST(count_if(voice = 'passive') AS BIGINT) AS passive FROM {_VOICE} GROUP BY 1) c""",
)
def _(t):
    return summaries.class_rate_wide(_voices(t), ["prime_condition"], "voice")


@query(
    "ag35_level_counts",
    """SELECT model_condition, item_id, count(DISTINCT prime_condition) AS n_levels FROM item_scores GROUP BY 1, 2""",
)
def _(t):
    return validate.level_counts(t.item_scores(), ["model_condition", "item_id"], "prime_condition")


@query(
    "ag36_value_counts",
    """SELECT prime_condition_raw AS value, count(*) AS n FROM item_scores GROUP BY 1""",
)
def _(t):
    return summaries.value_counts(t.item_scores(), "prime_condition_raw")


_W = """(SELECT item_index, string_split(pa, ' ') AS a, string_split(ta, ' ') AS b, string_split(pp, ' ') AS c, string_split(tp, ' ') AS d FROM quartets) w"""
_FAM = "CASE WHEN {0} = 'the' THEN 'def' WHEN {0} IN ('a', 'an') THEN 'indef' ELSE 'unknown' END"
_TENSE = "CASE WHEN {0} LIKE '%ed' THEN 'past' WHEN {0} LIKE '%s' THEN 'present' ELSE 'unknown' END"
_AUX = "CASE {0} WHEN 'is' THEN 'present' WHEN 'was' THEN 'past' ELSE 'unknown' END"
_SHARED = "(a[2] IN (b[2], b[5]) OR a[5] IN (b[2], b[5]))"


@query(
    "ag37_lexical_overlap",
    f"""SELECT count(*) AS rows_evaluated, CAST(count_if(a[3] = b[3]) AS BIGINT) AS same_active_verb_rows, R6(avg(CAST(a[3] = b[3] AS INT))) AS same_active_verb_rate,
  CAST(count_if({_SHARED}) AS BIGINT) AS shared_noun_rows, R6(avg(CAST({_SHARED} AS INT))) AS shared_noun_rate,
  CAST(count_if(list_sort(list_distinct([a[2], a[5]])) = list_sort(list_distinct([b[2], b[5]]))) AS BIGINT) AS shared_both_nouns_rows,
  R6(avg(CAST(list_sort(list_distinct([a[2], a[5]])) = list_sort(list_distinct([b[2], b[5]])) AS INT))) AS shared_both_nouns_rate FROM {_W}""",
)
def _(t):
    return audits.lexical_overlap(t.quartets())


_EDGE_SQL = """SELECT DISTINCT split_part(ta, ' ', 2) AS cue, split_part(ta, ' ', 5) AS target FROM quartets"""


def edges_of(t):
    """Directed word pairs: the two people of the active target."""
    ta = text.parse_active("ta")
    return t.quartets().select(ta["agent"].alias("cue"), ta["patient"].alias("target")).distinct()


@query(
    "ag38_strict_audit",
    f"""WITH e0 AS ({_EDGE_SQL}), e AS (SELECT cue AS x, target AS y FROM e0 UNION SELECT target, cue FROM e0),
k AS (SELECT *, {_FAM.format('a[1]')} AS pf, {_FAM.format('b[1]')} AS tf FROM {_W}),
ws AS (SELECT item_index, unnest([b[2], b[5], b[3]]) AS x, [a[2], a[5], a[3]] AS p FROM k), pr AS (SELECT item_index, x, unnest(p) AS y FROM ws)
SELECT CAST(count_if(c[3] = d[3]) AS BIGINT) AS shared_aux_rows, CAST(count_if({_SHARED}) AS BIGINT) AS shared_noun_rows, CAST(count_if(a[3] = b[3]) AS BIGINT) AS shared_verb_rows,
  CAST(count_if(pf = tf) AS BIGINT) AS same_det_family_rows,
  CAST(sum(CAST(pf = 'unknown' OR tf = 'unknown' AS INT) + CAST({_FAM.format('a[4]')} <> pf OR {_FAM.format('b[4]')} <> tf AS INT)) AS BIGINT) AS det_side_mismatch_rows,
  CAST(count_if({_AUX.format('c[3]')} <> {_TENSE.format('a[3]')}) AS BIGINT) AS prime_tense_mismatch_rows,
  CAST(count_if({_AUX.format('d[3]')} <> {_TENSE.format('b[3]')}) AS BIGINT) AS target_tense_mismatch_rows, CAST(0 AS BIGINT) AS unknown_tokenization_rows,
  (SELECT count(DISTINCT item_index) FROM pr JOIN e USING (x, y)) AS semantic_association_rows FROM k""",
)
def _(t):
    return audits.strict_audit(t.quartets(), edges_of(t))


@query(
    "ag38_strict_preview",
    f"""SELECT item_index, a[3] AS prime_lemma, b[3] AS target_lemma, array_to_string(list_sort(list_distinct([a[2], a[5]])), ';') AS prime_nouns,
  array_to_string(list_sort(list_distinct([b[2], b[5]])), ';') AS target_nouns, c[3] AS prime_aux, d[3] AS target_aux
FROM {_W} WHERE c[3] = d[3] OR {_SHARED} OR a[3] = b[3] OR {_FAM.format('a[1]')} = {_FAM.format('b[1]')} OR {_AUX.format('c[3]')} <> {_TENSE.format('a[3]')}
  OR {_AUX.format('d[3]')} <> {_TENSE.format('b[3]')} ORDER BY item_index LIMIT 5""",
)
def _(t):
    return audits.strict_preview(t.quartets())


_LENIENT = "CASE WHEN {0} LIKE '%s' THEN 'present' ELSE 'past' END"


@query(
    "ag39_opposite_audit",
    f"""SELECT CAST(count_if(c[3] = d[3]) AS BIGINT) AS same_aux_rows, CAST(count_if({_FAM.format('a[1]')} = {_FAM.format('b[1]')}) AS BIGINT) AS same_det_family_rows,
  CAST(count_if({_SHARED}) AS BIGINT) AS shared_noun_rows, CAST(count_if(a[3] = b[3]) AS BIGINT) AS same_active_verb_rows,
  CAST(count_if({_LENIENT.format('a[3]')} <> {_AUX.format('c[3]')}) AS BIGINT) AS prime_tense_mismatch_rows,
  CAST(count_if({_LENIENT.format('b[3]')} <> {_AUX.format('d[3]')}) AS BIGINT) AS target_tense_mismatch_rows FROM {_W}""",
)
def _(t):
    return audits.opposite_audit(t.quartets())


_BAD = "CAST(({0} = 'a' AND NOT regexp_matches({1}, '^[bcdfghjklmnpqrstvwxyz]')) OR ({0} = 'an' AND regexp_matches({1}, '^[bcdfghjklmnpqrstvwxyz]')) AS INT)"


@query(
    "ag40_nonce_audit",
    f"""SELECT CAST(sum({' + '.join(f"CAST({_FAM.format(x)} = 'unknown' AS INT)" for x in ('a[1]', 'a[4]', 'b[1]', 'b[4]'))}) AS BIGINT) AS unknown_determiner_rows,
  CAST(sum({' + '.join(_BAD.format(*x) for x in (('a[1]', 'a[2]'), ('a[4]', 'a[5]'), ('b[1]', 'b[2]'), ('b[4]', 'b[5]')))}) AS BIGINT) AS bad_indefinite_article_uses,
  CAST(count_if(a[3] = b[3]) AS BIGINT) AS same_active_fragment_rows, CAST(count_if(c[3] = d[3]) AS BIGINT) AS same_aux_rows,
  CAST(count_if({_FAM.format('a[1]')} = {_FAM.format('b[1]')}) AS BIGINT) AS same_det_family_rows, CAST(count_if({_SHARED}) AS BIGINT) AS shared_noun_rows FROM {_W}""",
)
def _(t):
    return audits.nonce_audit(t.quartets())


@query(
    "ag42_cell_counts",
    f"""SELECT concat(CASE WHEN {_FAM.format('b[1]')} = {_FAM.format('b[4]')} THEN {_FAM.format('b[1]')} ELSE 'mixed' END, '_', {_AUX.format('d[3]')}) AS cell, count(*) AS n
FROM {_W} GROUP BY 1""",
)
def _(t):
    return audits.cell_counts(t.quartets())


@query(
    "ag43_length_audit",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, min(l) AS min_left, max(l) AS max_left, R6(avg(l)) AS mean_left, min(r) AS min_right, max(r) AS max_right, R6(avg(r)) AS mean_right,
  min(r - l) AS min_diff, max(r - l) AS max_diff, R6(avg(r - l)) AS mean_diff, CAST(count_if(r = l) AS BIGINT) AS exact_match_rows, CAST(count_if(r <> l) AS BIGINT) AS nonzero_diff_rows,
  CAST(count_if(r < l) AS BIGINT) AS negative_diff_rows, CAST(count_if(r > l) AS BIGINT) AS positive_diff_rows
FROM (SELECT CAST(len(string_split(q.{c}, ' ')) AS BIGINT) AS l, CAST(len(string_split(q.{o}, ' ')) AS BIGINT) AS r FROM quartets q) x"""
        for c, o in (("pa", "tp"), ("pp", "ta"), ("ta", "pa"), ("tp", "pp"))
    ),
)
def _(t):
    q = t.quartets()
    other = q.select("item_index", F.col("tp").alias("pa"), F.col("ta").alias("pp"),
                     F.col("pa").alias("ta"), F.col("pp").alias("tp"))
    return audits.length_audit(q, other, "item_index")


@query(
    "ag44_edge_coverage",
    f"""WITH e AS ({_EDGE_SQL}), v AS (SELECT DISTINCT unnest(string_split(concat(pa, ' ', ta), ' ')) AS word FROM quartets), x AS (SELECT cue AS word FROM e UNION SELECT target FROM e)
SELECT count(*) AS vocab_words, CAST(count_if(word IN (SELECT word FROM x)) AS BIGINT) AS covered_vocab_words,
  CAST(count_if(word NOT IN (SELECT word FROM x)) AS BIGINT) AS uncovered_vocab_words FROM v""",
)
def _(t):
    words = F.array_distinct(F.split(F.concat_ws(" ", "pa", "ta"), " "))
    vocabulary = t.quartets().select(F.explode(words).alias("word"))
    return joins.edge_coverage(edges_of(t), vocabulary)


@query(
    "ag41_complex_np_audit",
    """SELECT complexity_condition, count(*) AS row_count, CAST(0 AS BIGINT) AS uses_by_rows, CAST(0 AS BIGINT) AS same_preposition_rows,
  CAST(0 AS BIGINT) AS semantic_preposition_rows, CAST(0 AS BIGINT) AS agent_modifier_reuse_rows, CAST(0 AS BIGINT) AS patient_modifier_reuse_rows,
  CAST(0 AS BIGINT) AS same_modifier_rows, CAST(count_if(a[2] IN (b[2], b[5]) OR a[5] IN (b[2], b[5])) AS BIGINT) AS content_noun_overlap_rows,
  CAST(count_if(a[3] = b[3]) AS BIGINT) AS same_verb_rows, CAST(0 AS BIGINT) AS same_passive_aux_rows, CAST(0 AS BIGINT) AS same_det_family_rows,
  count(*) AS unavoidable_by_rows, CAST(0 AS BIGINT) AS avoidable_function_rows
FROM (SELECT string_split(pa, ' ') AS a, string_split(ta, ' ') AS b FROM quartets) w
CROSS JOIN (SELECT 'agent_complex' AS complexity_condition UNION ALL SELECT 'patient_complex' UNION ALL SELECT 'both_complex') k GROUP BY 1""",
)
def _(t):
    return audits.complex_np_audit(corpus.build_complex(t.quartets(), people_pool(t), "core"))


def people_pool(t):
    """The distinct nouns of all sentences, numbered in alphabetical order."""
    nouns = t.quartets().select(
        F.explode(F.array(*[text.parse_active(c)[r] for c in ("pa", "ta") for r in ("agent", "patient")])).alias("word")
    ).distinct()
    nouns = materialize(nouns, "nouns")  # read twice, and few
    block = F.ascii("word") * 256 + F.ascii(F.substring("word", 2, 1))
    return ranking.position_in_group(nouns, [], ["word"], block)


@query(
    "ag45_review_coverage",
    """WITH x AS (SELECT d.doc_id, d.source, d.lang, l.quality, d.doc_id % 3 = 0 AS need FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, count(*) AS n_rows, CAST(count_if(need) AS BIGINT) AS n_review_needed, CAST(count_if(need AND quality IS NOT NULL) AS BIGINT) AS n_review_matches,
  CAST(count_if(need AND quality IS NULL) AS BIGINT) AS n_review_missing,
  CAST(count_if(CASE WHEN need AND quality IS NOT NULL THEN quality = 0 ELSE lang = 'en' END) AS BIGINT) AS n_strict_other_final,
  CAST(count_if(lang = 'en') AS BIGINT) AS n_lax_other_final FROM x GROUP BY 1""",
)
def _(t):
    auto = F.when(F.col("lang") == "en", "other").otherwise("active")
    rows = t.documents.select(
        "doc_id", "source", (F.col("doc_id") % 3 == 0).alias("need"),
        auto.alias("generation_class_strict"), auto.alias("generation_class_lax"),
    )
    reviews = t.labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, "other").otherwise("passive").alias("reviewed_generation_class_strict"),
        F.lit("").alias("reviewed_generation_class_lax"),
    )
    columns = ["generation_class_strict", "generation_class_lax"]
    merged = review.add_review_flags(
        review.overlay_reviews(rows, reviews, ["doc_id"], columns, "needed_only", "need")
    )
    return summaries.review_coverage(merged, ["source"], "manually_reviewed", "need")


@query(
    "ag26_prime_surprisal_summary",
    """SELECT role, CAST(turn AS BIGINT) % 2 AS part, count(*) AS n_items, R6(avg(length(text) / 10.0)) AS prime_surprisal_mean, R6(avg(length(text))) AS prime_surprisal_sum,
  R6(avg(len(string_split(text, ' ')))) AS prime_token_count, R6(avg(CAST(text LIKE '%a%' AS INT))) AS match_rate FROM conversations GROUP BY 1, 2""",
)
def _(t):
    rows = t.conversations.select(
        "role", (F.col("turn") % 2).alias("part"),
        (F.length("text") / 10.0).alias("prime_surprisal_mean"),
        F.length("text").alias("prime_surprisal_sum"),
        F.size(F.split("text", " ")).alias("prime_token_count"),
        F.col("text").contains("a").alias("prime_sentence_matches_column"),
    )
    return summaries.prime_surprisal_summary(rows, ["role", "part"])

