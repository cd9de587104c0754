"""Paired effects and shifts."""

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import effects, review
from .aggregates import ANSWERS
from .registry import query
from .windows import SHIFT, UNIT, shifts

GROUP = ["model_condition", "lexicality_condition"]

_CELLS = ", ".join(
    f"avg(CASE WHEN prime_condition = '{p}' THEN {v}_choice_logprob END) AS {v[0]}{p[0]}"
    for v in ("active", "passive")
    for p in ("active", "passive")
)
PE = f"""(SELECT *, aa - ap AS pa, pp - pa AS pb FROM (SELECT model_condition, lexicality_condition, item_id, {_CELLS} FROM item_scores GROUP BY 1, 2, 3) m
  WHERE aa IS NOT NULL AND ap IS NOT NULL AND pa IS NOT NULL AND pp IS NOT NULL) e"""
PE = PE.replace("aa - ap AS pa, pp - pa AS pb", "aa - ap AS ea, pp - m.pa AS ep")


def item_effects(t):
    return effects.paired_effect(t.item_scores(), GROUP, "item_id")


@query(
    "st01_paired_effect",
    f"""SELECT model_condition, lexicality_condition, item_id, R6(aa) AS logp_active_target_given_active_prime, R6(ap) AS logp_active_target_given_passive_prime,
  R6(pa) AS logp_passive_target_given_active_prime, R6(pp) AS logp_passive_target_given_passive_prime, R6(ea) AS pe_active_target_logprob_same_minus_other,
  R6(ep) AS pe_passive_target_logprob_same_minus_other, R6(ep - ea) AS pe_logprob_imbalance_passive_minus_active FROM {PE}""",
)
def _(t):
    return item_effects(t)


# Long target scores: one row per unit, voice and prime.
_LONG = """(SELECT item_id, lexicality_condition, prime_condition, 'active' AS target_voice, active_choice_logprob * 3 AS s, active_choice_logprob AS m FROM item_scores
  UNION ALL SELECT item_id, lexicality_condition, prime_condition, 'passive', passive_choice_logprob * 3, passive_choice_logprob FROM item_scores)"""


def long_scores(t):
    cells = F.array(
        *[
            F.struct(
                F.lit(v).alias("target_voice"),
                (F.col(f"{v}_choice_logprob") * 3).alias("target_logprob_sum"),
                F.col(f"{v}_choice_logprob").alias("target_logprob_mean"),
            )
            for v in ("active", "passive")
        ]
    )
    rows = t.item_scores().select(
        "item_id", "lexicality_condition", "prime_condition", F.explode(cells).alias("c")
    )
    return rows.select("item_id", "lexicality_condition", "prime_condition", "c.*")


def _spread(metric):
    names = [(v, p) for v in ("active", "passive") for p in ("active", "passive", "filler", "no_prime")]
    return ", ".join(
        f"avg(CASE WHEN target_voice = '{v}' AND prime_condition = '{p}' THEN {metric[0]} END) AS logp_{v}_target_given_{p}_prime_{metric}"
        for v, p in names
    )


def effect_columns(metric):
    def c(v, p):
        return f"logp_{v}_target_given_{p}_prime_{metric}"

    a = f"({c('active', 'active')} - {c('active', 'passive')})"
    b = f"({c('passive', 'passive')} - {c('passive', 'active')})"
    out = {
        f"pe_active_target_logprob_{metric}_same_minus_other": a,
        f"pe_passive_target_logprob_{metric}_same_minus_other": b,
        f"pe_logprob_{metric}_imbalance_passive_minus_active": f"({b} - {a})",
    }
    for base in ("no_prime", "filler"):
        out[f"active_target_shift_active_minus_{base}_{metric}"] = f"({c('active', 'active')} - {c('active', base)})"
        out[f"passive_target_shift_passive_minus_{base}_{metric}"] = f"({c('passive', 'passive')} - {c('passive', base)})"
        out[f"baseline_{base}_passive_minus_active_logprob_{metric}"] = f"({c('passive', base)} - {c('active', base)})"
    return out


WIDE = f"(SELECT item_id, lexicality_condition, {_spread('sum')}, {_spread('mean')} FROM {_LONG} l GROUP BY 1, 2) w"
_ALL = {**effect_columns("sum"), **effect_columns("mean")}


@query(
    "st02_paired_effect_long",
    f"SELECT item_id, lexicality_condition, {', '.join(f'R6({e}) AS {n}' for n, e in _ALL.items())} FROM {WIDE}",
)
def _(t):
    out = effects.paired_effect_long(long_scores(t), ["item_id", "lexicality_condition"])
    return out.select("item_id", "lexicality_condition", *_ALL)


@query("st04_baseline_shift_table", SHIFT)
def _(t):
    return shifts(t)


@query(
    "st05_scored_baseline",
    """SELECT item_index, ta AS target_active_text_for_bias, split_part(ta, ' ', 3) AS target_verb_form, concat(left(split_part(ta, ' ', 3), 3), '*') AS target_verb_lemma,
  concat(split_part(ta, ' ', 2), '|', split_part(ta, ' ', 3), '|', split_part(ta, ' ', 5)) AS target_content_frame, 'scored_candidate_no_prime' AS baseline_bias_type
FROM (SELECT *, CASE item_index % 4 WHEN 3 THEN 'no_prime' ELSE 'other' END AS prime_condition FROM quartets) q WHERE prime_condition = 'no_prime'""",
)
def _(t):
    pairs = t.scored_pairs()
    verbs = t.quartets().select(F.split_part("ta", F.lit(" "), F.lit(3)).alias("form")).distinct()
    lemmas = verbs.withColumn("lemma", F.concat(F.substring("form", 1, 3), F.lit("*")))
    keep = [
        "item_index", "no_such_column", "target_active_text_for_bias", "target_verb_form",
        "target_verb_lemma", "target_content_frame", "baseline_bias_type",
    ]
    return effects.scored_baseline(pairs, keep, lemmas)


@query(
    "st18_prime_event_bias",
    """WITH r AS (SELECT item_index, target_structure AS prime_condition, list_sum(congruent) AS s, list_avg(congruent) AS m, CAST(len(congruent) AS BIGINT) AS n FROM token_lists)
SELECT a.item_index, R6(a.s) AS prime_active_logprob_sum, R6(p.s) AS prime_passive_logprob_sum, R6(a.m) AS prime_active_logprob_mean, R6(p.m) AS prime_passive_logprob_mean,
  a.n AS prime_active_token_count, p.n AS prime_passive_token_count, R6(p.s - a.s) AS prime_logodds_passive_sum, R6(p.m - a.m) AS prime_logodds_passive_mean,
  p.n - a.n AS prime_passive_minus_active_token_count FROM r a JOIN r p ON a.item_index = p.item_index AND a.prime_condition = 'active' AND p.prime_condition = 'passive'""",
)
def _(t):
    from ..functions import arrays

    rows = t.token_lists().select(
        "item_index", F.col("target_structure").alias("prime_condition"),
        arrays.array_sum(F.col("congruent")).alias("logprob_sum"),
        arrays.array_mean(F.col("congruent")).alias("logprob_mean"),
        F.size("congruent").alias("token_count"),
    )
    return effects.prime_event_bias(
        rows, ["item_index"], ["logprob_sum", "logprob_mean", "token_count"]
    )


@query(
    "st19_match_prime_surprisal",
    """WITH s AS (SELECT q.item_index, c.prime_condition, CASE c.prime_condition WHEN 'active' THEN pa WHEN 'passive' THEN pp ELSE '' END AS prime_text,
  length(ta) * 0.5 + c.k AS y FROM quartets q CROSS JOIN (SELECT 0 AS k, 'active' AS prime_condition UNION ALL SELECT 1, 'passive' UNION ALL SELECT 2, 'no_prime') c),
p AS (SELECT item_index, 'active' AS prime_condition, pa AS sent, length(pa) / 4.0 AS u FROM quartets UNION ALL SELECT item_index, 'passive', tp, length(pp) / 4.0 FROM quartets)
SELECT s.item_index, s.prime_condition, R6(p.u) AS prime_surprisal_mean, R6(s.y - b.y) AS target_shift_from_no_prime,
  R6(CASE WHEN s.prime_condition = 'passive' THEN s.y - b.y ELSE b.y - s.y END) AS congruent_shift_from_no_prime,
  CASE WHEN p.u IS NULL THEN 'missing_or_mismatch' ELSE 'exact_sentence_match' END AS prime_surprisal_match_status
FROM s JOIN s b ON b.item_index = s.item_index AND b.prime_condition = 'no_prime' LEFT JOIN p ON p.item_index = s.item_index AND p.prime_condition = s.prime_condition AND p.sent = s.prime_text
WHERE s.prime_condition <> 'no_prime'""",
)
def _(t):
    q = t.quartets()
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("prime_condition"), F.col(x).alias("prime_text"), F.lit(k).alias("k"))
            for k, (c, x) in enumerate((("active", "pa"), ("passive", "pp"), ("no_prime", "empty")))
        ]
    )
    scores = q.withColumn("empty", F.lit("")).select(
        "item_index", "ta", F.explode(cells).alias("c")
    ).select(
        "item_index", "c.*", (F.length("ta") * 0.5 + F.col("c.k")).cast("double").alias("logodds_passive"),
        F.lit(0).alias("row_id"),
    )
    shown = F.array(
        F.struct(F.lit("active").alias("prime_condition"),
                 F.concat(F.upper("pa"), F.lit("  ")).alias("prime_sentence"),
                 (F.length("pa") / 4.0).alias("prime_surprisal_mean")),
        F.struct(F.lit("passive").alias("prime_condition"), F.col("tp").alias("prime_sentence"),
                 (F.length("pp") / 4.0).alias("prime_surprisal_mean")),
    )
    primes = q.select(F.col("item_index").cast("string").alias("item_index"), F.explode(shown).alias("c")).select(
        "item_index", "c.*", F.lit(0).alias("row_id")
    )
    out = effects.match_prime_surprisal(
        scores.withColumn("run", F.lit("r")), primes.withColumn("run", F.lit("r")),
        ["item_index"], ["run"],
    )
    return out.select(
        "item_index", "prime_condition", "prime_surprisal_mean", "target_shift_from_no_prime",
        "congruent_shift_from_no_prime", "prime_surprisal_match_status",
    )


@query(
    "st20_token_surprisal",
    """SELECT condition, target_structure, item_index, R6(avg(-congruent_log_prob)) AS prime_surprisal_mean, R6(sum(-congruent_log_prob)) AS prime_surprisal_sum,
  count(*) AS prime_token_count FROM token_rows GROUP BY 1, 2, 3""",
)
def _(t):
    rows = t.token_rows().withColumn("token_surprisal", -F.col("congruent_log_prob"))
    return effects.token_surprisal(rows, ["condition", "target_structure", "item_index"])


@query(
    "st21_roi_facilitation",
    """WITH r AS (SELECT l_orderkey AS item_id, l_returnflag AS roi, l_linenumber % 4 AS k, l_discount * 10 + 1 AS s FROM lineitem),
w AS (SELECT item_id, roi, avg(CASE WHEN k = 0 THEN s END) AS no_prime, avg(CASE WHEN k = 2 THEN s END) AS passive FROM r GROUP BY 1, 2)
SELECT item_id, roi, R6(no_prime) AS no_prime, R6(passive) AS passive, R6(no_prime - passive) AS facilitation FROM w WHERE no_prime IS NOT NULL AND passive IS NOT NULL""",
)
def _(t):
    k = F.col("l_linenumber") % 4
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("roi"),
        F.when(k == 0, "no_prime").when(k == 2, "passive").otherwise("rest").alias("prime_condition"),
        (F.col("l_discount") * 10 + 1).alias("roi_surprisal_mean"),
    )
    return effects.roi_facilitation(rows, ["item_id", "roi"])


@query("st22_abs_shift", f"SELECT *, abs(shift_from_no_prime) AS abs_shift_from_no_prime FROM ({SHIFT}) s")
def _(t):
    return effects.abs_shift(shifts(t))


@query(
    "st23_congruency_effect",
    f"""WITH r AS (SELECT item_index, target_voice, prime_condition = target_voice AS cong, CAST(matched_label = 'correct' AS INT) AS hit FROM {ANSWERS} WHERE prime_condition <> 'no_prime'),
g AS (SELECT item_index, target_voice, sum(CASE WHEN cong THEN hit END) AS c1, count_if(cong) AS n1, sum(CASE WHEN NOT cong THEN hit END) AS c0, count_if(NOT cong) AS n0 FROM r GROUP BY 1, 2)
SELECT item_index, target_voice, R6(c1 / n1) AS accuracy_congruent, R6(c0 / n0) AS accuracy_incongruent, R6(ln((c1 + 0.5) / (n1 - c1 + 0.5))) AS elogit_accuracy_congruent,
  R6(ln((c0 + 0.5) / (n0 - c0 + 0.5))) AS elogit_accuracy_incongruent, R6(c1 / n1 - c0 / n0) AS comprehension_congruency_effect,
  R6(ln((c1 + 0.5) / (n1 - c1 + 0.5)) - ln((c0 + 0.5) / (n0 - c0 + 0.5))) AS comprehension_congruency_logodds FROM g""",
)
def _(t):
    rows = review.score_answers(t.role_answers(), "answer_raw", "correct_head", "foil_head")
    return effects.congruency_effect(
        rows, ["item_index", "target_voice"], "prime_condition", "target_voice", "is_correct"
    )


@query(
    "st24_rate_shift",
    """WITH m AS (SELECT model_condition, """
    + ", ".join(
        f"avg(CASE WHEN prime_condition = '{c}' THEN CASE WHEN passive_choice_logprob > active_choice_logprob THEN 1.0 ELSE 0.0 END END) AS {c}"
        for c in ("active", "passive", "filler", "no_prime")
    )
    + """ FROM item_scores GROUP BY 1)
SELECT model_condition, 'active_shift' AS shift_type, R6(active - no_prime) AS probability_shift FROM m
UNION ALL SELECT model_condition, 'passive_shift', R6(passive - no_prime) FROM m UNION ALL SELECT model_condition, 'filler_shift', R6(filler - no_prime) FROM m""",
)
def _(t):
    chosen = clean.choose_structure("active_choice_logprob", "passive_choice_logprob")
    return effects.rate_shift(t.item_scores(), ["model_condition"], chosen == "passive")


__all__ = ["PE", "UNIT", "WIDE", "item_effects", "long_scores"]
