"""Resampling, tests and regressions."""

from pyspark.sql import functions as F

from ..functions import clean, fixed
from ..operators import effects, fits, ranking, resample, reshape, review, stats, summaries
from ..operators.resample import _POISSON_CDF
from .aggregates import _SCORES, _VOICE, ANSWERS, _scores, _voices
from .effects import PE, WIDE, effect_columns, item_effects, long_scores
from .registry import query
from .tokens import ITEM_PE, item_table

GROUP = ["model_condition", "lexicality_condition"]
DRAWS, FLIPS = 5_000, 10_000
_IMBALANCE = "pe_logprob_imbalance_passive_minus_active"

# ---- draws in SQL -----------------------------------------------------------


def _weight(u):
    return (
        "CASE " + " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(_POISSON_CDF))
        + f" ELSE {len(_POISSON_CDF)} END"
    )


def _uniform(h, b):
    return f"CAST(CAST('0x' || substr({h}, CAST(({b} % 4) * 8 + 1 AS INT), 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


def bootstrap_sql(units, by, unit, value, n=DRAWS, seed=13):
    keys = ", ".join(by)
    digest = f"md5(concat_ws('|', '{seed}', {keys}, {unit}, b // 4))"
    return f"""WITH un AS ({units}), d AS (SELECT {keys}, {value} AS x, b, {digest} AS h FROM un CROSS JOIN (SELECT unnest(range({n})) AS b) r),
w AS (SELECT {keys}, x, b, {_weight(_uniform('h', 'b'))} AS w FROM d), m AS (SELECT {keys}, b, sum(w * x) / nullif(sum(w), 0) AS v FROM w GROUP BY {keys}, b),
q AS (SELECT {keys}, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM m GROUP BY {keys}), o AS (SELECT {keys}, count(*) AS n_rows, avg({value}) AS mean FROM un GROUP BY {keys})
SELECT o.*, q.lo, q.hi FROM o JOIN q USING ({keys})"""


def sign_sql(units, by, unit, value, n=FLIPS, seed=42, correction=True, side="two"):
    keys = ", ".join(by)
    digest = f"md5(concat_ws('|', '{seed}', {keys}, {unit}, b // 128))"
    bit = "((instr('0123456789abcdef', substr(h, CAST((b % 128) // 4 + 1 AS INT), 1)) - 1) // CAST(pow(2, 3 - (b % 128) % 4) AS BIGINT)) % 2"
    reach = "m.v >= o.mean - 1e-12" if side == "greater" else "abs(m.v) >= abs(o.mean) - 1e-12"
    p = f"(count_if({reach}) + 1) / {n + 1}" if correction else f"count_if({reach}) / {n}"
    return f"""WITH un AS ({units}), d AS (SELECT {keys}, {value} AS x, b, {digest} AS h FROM un CROSS JOIN (SELECT unnest(range({n})) AS b) r),
m AS (SELECT {keys}, b, avg(CASE WHEN {bit} = 1 THEN x ELSE -x END) AS v FROM d GROUP BY {keys}, b), o AS (SELECT {keys}, count(*) AS n_items, avg({value}) AS mean FROM un GROUP BY {keys})
SELECT {', '.join('o.' + k for k in by)}, o.n_items, R6(o.mean) AS mean, R6({p}) AS p_value FROM o JOIN m USING ({keys}) GROUP BY ALL"""


_UNITS = f"SELECT *, ep - ea AS d FROM {PE}"


@query(
    "st06_one_sample",
    f"""SELECT model_condition, lexicality_condition, count(*) AS n_items, R6(avg(d)) AS mean, R6(stddev_samp(d)) AS sd,
  R6(avg(d) / (stddev_samp(d) / sqrt(count(*)))) AS t_stat FROM ({_UNITS}) u GROUP BY 1, 2""",
)
def _(t):
    return stats.one_sample(item_effects(t), GROUP, _IMBALANCE).drop("p_value")


@query("st06_one_sample_p")
def _(t):
    return stats.one_sample(item_effects(t), GROUP, _IMBALANCE)


def _paired_sql(measure, pair):
    a, b = pair
    return f"""SELECT model_condition, lexicality_condition, '{measure}' AS measure, '{a}' AS condition_a, '{b}' AS condition_b, count(d) AS n_pairs, R6(avg(d)) AS mean_diff_a_minus_b,
  R6(CASE WHEN count(d) > 1 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(d))) END) AS t_stat
FROM (SELECT model_condition, lexicality_condition, item_id, avg(CASE WHEN prime_condition = '{a}' THEN {measure} END) - avg(CASE WHEN prime_condition = '{b}' THEN {measure} END) AS d
  FROM {_SCORES} GROUP BY 1, 2, 3) u GROUP BY 1, 2"""


_TESTED = ["preference_total", "active_choice_logprob"]


@query(
    "st07_paired_tests",
    "\nUNION ALL ".join(_paired_sql(m, p) for m in _TESTED for p in fixed.CONDITION_PAIRS),
)
def _(t):
    out = stats.paired_tests(_scores(t), GROUP, "item_id", _TESTED, fixed.CONDITION_PAIRS)
    return out.drop("p_value")


@query("st07_paired_tests_p")
def _(t):
    return stats.paired_tests(
        _scores(t), GROUP, "item_id", ["preference_total"], fixed.CONDITION_PAIRS
    )


@query(
    "st08_bootstrap_poisson",
    "SELECT model_condition, lexicality_condition, n_rows, R6(mean) AS mean, R6(lo) AS ci_low, R6(hi) AS ci_high FROM ("
    + bootstrap_sql(_UNITS, GROUP, "item_id", "d")
    + ") z",
)
def _(t):
    return resample.bootstrap_ci(
        item_effects(t), GROUP, "item_id", _IMBALANCE, n_resamples=DRAWS, seed=13
    )


@query(
    "st08_bootstrap_summary",
    "SELECT model_condition, lexicality_condition, n_rows, R6(mean) AS diff_mean, R6(lo) AS diff_ci_low, R6(hi) AS diff_ci_high FROM ("
    + bootstrap_sql(_UNITS, GROUP, "item_id", "d", DRAWS, 7)
    + ") z",
)
def _(t):
    units = item_effects(t).withColumnRenamed(_IMBALANCE, "diff")
    return resample.bootstrap_summary(units, GROUP, "item_id", "diff", n_resamples=DRAWS, seed=7)


@query("st08_bootstrap_multinomial")
def _(t):
    return resample.bootstrap_ci(item_effects(t), GROUP, "item_id", _IMBALANCE, n_resamples=DRAWS, method="multinomial")


@query(
    "st08_bootstrap_exact",
    f"""WITH un AS ({_UNITS}), s AS (SELECT *, count(*) OVER (PARTITION BY model_condition, lexicality_condition) AS n,
  row_number() OVER (PARTITION BY model_condition, lexicality_condition ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) - 1 AS at FROM un),
r AS (SELECT s.model_condition, s.lexicality_condition, b, n, md5(concat_ws('|', '13', model_condition, lexicality_condition, n, item_id, b // 4)) AS h FROM s CROSS JOIN (SELECT unnest(range(50)) AS b) g),
p AS (SELECT model_condition, lexicality_condition, b, CAST(floor({_uniform('h', 'b')} * n) AS BIGINT) AS at FROM r),
m AS (SELECT p.model_condition, p.lexicality_condition, p.b, avg(s.d) AS v FROM p JOIN s ON p.model_condition = s.model_condition AND p.lexicality_condition = s.lexicality_condition AND p.at = s.at GROUP BY 1, 2, 3),
o AS (SELECT model_condition, lexicality_condition, count(*) AS n_rows, avg(d) AS mean FROM un GROUP BY 1, 2)
SELECT o.model_condition, o.lexicality_condition, o.n_rows, R6(o.mean) AS mean, R6(quantile_cont(m.v, 0.025)) AS ci_low, R6(quantile_cont(m.v, 0.975)) AS ci_high
FROM o JOIN m USING (model_condition, lexicality_condition) GROUP BY 1, 2, 3, o.mean""",
)
def _(t):
    return resample.bootstrap_ci(
        item_effects(t), GROUP, "item_id", _IMBALANCE, n_resamples=50, seed=13, method="exact"
    )


@query("st09_sign_flip", sign_sql(_UNITS, GROUP, "item_id", "d"))
def _(t):
    return resample.sign_flip_p(item_effects(t), GROUP, "item_id", _IMBALANCE, FLIPS, 42)


@query("st09_sign_flip_one_sided", sign_sql(_UNITS, GROUP, "item_id", "d", FLIPS, 5, False, "greater"))
def _(t):
    return resample.sign_flip_p(
        item_effects(t), GROUP, "item_id", _IMBALANCE, FLIPS, 5, correction=False, side="greater"
    )


_ORDER = ["active", "passive", "no_prime", "filler"]


def _pairwise_sql(measure, label):
    cells = ", ".join(
        f"avg(CASE WHEN prime_condition = '{c}' THEN {measure} END) AS v{i}" for i, c in enumerate(_ORDER)
    )
    parts = []
    for i, a in enumerate(_ORDER):
        for j in range(i + 1, len(_ORDER)):
            parts.append(
                f"SELECT lexicality_condition, item_id, '{a}' AS condition_a, '{_ORDER[j]}' AS condition_b, v{j} - v{i} AS d FROM w WHERE v{j} - v{i} IS NOT NULL"
            )
    return f"""SELECT lexicality_condition, '{label}' AS metric, condition_a, condition_b, count(*) AS n_items, R6(avg(d)) AS mean, R6(coalesce(stddev_samp(d), 0)) AS sd,
  R6(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) ELSE 0 END) AS effect_size_dz,
  R6(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END) AS t_stat
FROM (WITH w AS (SELECT lexicality_condition, item_id, {cells} FROM {_SCORES} GROUP BY 1, 2) {' UNION ALL '.join(parts)}) q GROUP BY 1, 2, 3, 4"""


# The metrics of the pairwise tests that item_scores has; it has no summed scores.
PAIRWISE = {"passive_choice_indicator": "passive_choice_delta", "passive_minus_active_logprob": "logprob_delta"}


def _pairwise(t):
    rows = _scores(t).withColumn("passive_choice_indicator", (F.col("chosen_structure") == "passive").cast("double"))
    return stats.pairwise_stats(
        rows, ["lexicality_condition"], "item_id", PAIRWISE, _ORDER, n_resamples=FLIPS
    )


_PASSIVE = "CASE WHEN chosen_structure = 'passive' THEN 1.0 ELSE 0.0 END"


@query(
    "st10_pairwise_stats",
    _pairwise_sql("passive_minus_active_logprob", "logprob_delta") + "\nUNION ALL " + _pairwise_sql(_PASSIVE, "passive_choice_delta"),
)
def _(t):
    return _pairwise(t).select(
        "lexicality_condition", "metric", "condition_a", "condition_b", "n_items", "mean", "sd",
        "effect_size_dz", "t_stat",
    )


@query("st10_pairwise_stats_p")
def _(t):
    return _pairwise(t)


def _choices(t):
    # equal means must stay ties whatever the order of summation
    a, p = (F.round(F.avg(f"{v}_choice_logprob"), 9) for v in ("active", "passive"))
    return t.item_scores().groupBy("lexicality_condition", "item_id", "prime_condition").agg(
        clean.choose_structure(a, p).alias("chosen_structure")
    )


_MC = """WITH c AS (SELECT lexicality_condition, item_id, prime_condition, CASE WHEN round(avg(passive_choice_logprob), 9) > round(avg(active_choice_logprob), 9) THEN 'passive' ELSE 'active' END AS ch FROM item_scores GROUP BY 1, 2, 3),
w AS (SELECT a.lexicality_condition, CAST(count_if(a.ch = 'active' AND b.ch = 'passive') AS BIGINT) AS b, CAST(count_if(a.ch = 'passive' AND b.ch = 'active') AS BIGINT) AS c
  FROM c a JOIN c b ON a.lexicality_condition = b.lexicality_condition AND a.item_id = b.item_id AND a.prime_condition = 'active' AND b.prime_condition = 'passive' GROUP BY 1)"""


@query(
    "st11_mcnemar",
    _MC
    + """ SELECT lexicality_condition, b AS mcnemar_b, c AS mcnemar_c, R6(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0)))
  FROM (SELECT unnest(range(least(b, c) + 1)) AS k) r))) AS mcnemar_p_exact FROM w""",
)
def _(t):
    return stats.mcnemar(_choices(t), ["lexicality_condition"], "item_id", "active", "passive")


_CW = f"""(SELECT prime_condition, CAST(count_if(voice = 'active') AS BIGINT) AS active, CAST(count_if(voice = 'passive') AS BIGINT) AS passive FROM {_VOICE} GROUP BY 1) c"""


@query(
    "st12_binom_test",
    f"""SELECT prime_condition, passive, active + passive AS total, R6((SELECT sum(exp(lgamma(active + passive + 1) - lgamma(k + 1) - lgamma(active + passive - k + 1) - (active + passive) * ln(2.0)))
  FROM (SELECT unnest(range(passive + 1)) AS k) r)) AS p_less FROM {_CW}""",
)
def _(t):
    wide = summaries.class_rate_wide(_voices(t), ["prime_condition"], "voice")
    return stats.binom_test(wide, "passive", "total").select(
        "prime_condition", "passive", "total", "p_less"
    )


@query(
    "st13_exact_rate",
    f"SELECT prime_condition, passive, active + passive AS total, R6(passive / (active + passive)) AS rate FROM {_CW}",
)
def _(t):
    wide = summaries.class_rate_wide(_voices(t), ["prime_condition"], "voice")
    return stats.exact_rate_ci(wide, "passive", "total").select(
        "prime_condition", "passive", "total", "rate"
    )


@query("st13_exact_rate_ci")
def _(t):
    wide = summaries.class_rate_wide(_voices(t), ["prime_condition"], "voice")
    return stats.exact_rate_ci(wide, "passive", "total")


_SIDES = "(SELECT condition, item_index, target_structure, sum(token_pe) AS sentence_pe, avg(token_pe) AS sentence_pe_mean FROM token_rows GROUP BY 1, 2, 3) s"


def _sides(t):
    from ..functions import arrays

    pe = arrays.token_pe("congruent", "incongruent")
    return t.token_lists().select(
        "condition", "item_index", "target_structure",
        arrays.array_sum(pe).alias("sentence_pe"), arrays.array_mean(pe).alias("sentence_pe_mean"),
        F.size(pe).alias("target_length"),
    )


PAIRED = ["sentence_pe_mean", "sentence_pe", "post_divergence_pe_mean", "critical_word_pe_mean"]


@query(
    "st14_paired_metric_tests",
    "\nUNION ALL ".join(
        f"""SELECT condition, '{m}' AS metric, count(*) AS n_items, R6(avg(d)) AS mean, R6(stddev_samp(d)) AS sd, R6(avg(d) / stddev_samp(d)) AS effect_size_dz,
  R6(avg(d) / (stddev_samp(d) / sqrt(count(*)))) AS t_stat
FROM (SELECT condition, item_index, max(CASE WHEN target_structure = 'passive' THEN {m} END) - max(CASE WHEN target_structure = 'active' THEN {m} END) AS d FROM ({ITEM_PE}) i GROUP BY 1, 2) q WHERE d IS NOT NULL GROUP BY 1"""
        for m in PAIRED
    ),
)
def _(t):
    out = stats.paired_metric_tests(item_table(t), ["condition"], "item_index", PAIRED, n_resamples=FLIPS)
    return out.select(
        "condition", "metric", "n_items", "mean", "sd", "effect_size_dz", "t_stat"
    )


@query("st14_paired_metric_tests_p")
def _(t):
    return stats.paired_metric_tests(
        item_table(t), ["condition"], "item_index", PAIRED, n_resamples=FLIPS
    )


def _deltas(t):
    wide = reshape.to_wide(
        _sides(t), ["condition", "item_index"], "target_structure",
        ["sentence_pe_mean", "target_length", "sentence_pe"], ["active", "passive"],
    )
    rows = wide.withColumns(
        {
            name: F.col(f"{m}_passive") - F.col(f"{m}_active")
            for name, m in (("delta", "sentence_pe_mean"), ("length", "target_length"), ("other", "sentence_pe"))
        }
    )
    rows = ranking.zscore(rows, "length", ddof=0, zero=True, name="z_length")
    return ranking.zscore(rows, "other", ddof=0, zero=True, name="z_other")


@query("st15_ols_hc3")
def _(t):
    terms = {
        "Intercept": F.lit(1.0),
        "condition[jabberwocky]": (F.col("condition") == "jabberwocky").cast("int"),
        "condition[mixed]": (F.col("condition") == "mixed").cast("int"),
        "z_length": F.col("z_length"),
        "z_other": F.col("z_other"),
    }
    return stats.ols_hc3(_deltas(t), "delta", terms).select("term", "coef", "std_err")


@query(
    "st15_ols_hc3_simple",
    """WITH d AS (SELECT l_discount AS y, l_tax * 10 AS x FROM lineitem), m AS (SELECT count(*) AS n, avg(x) AS xm, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
  sum(x) AS sx, sum(x * x) AS sq FROM d),
e AS (SELECT x, pow((y - a - b * x) / (1 - (1.0 / n + (x - xm) * (x - xm) / sxx)), 2) AS w FROM d, m), k AS (SELECT sum(w) AS w0, sum(w * x) AS w1, sum(w * x * x) AS w2 FROM e),
i AS (SELECT sq / (n * sq - sx * sx) AS i00, -sx / (n * sq - sx * sx) AS i01, n / (n * sq - sx * sx) AS i11, a, b FROM m)
SELECT 'Intercept' AS term, R6(a) AS coef, R6(sqrt(i00 * i00 * w0 + 2 * i00 * i01 * w1 + i01 * i01 * w2)) AS std_err FROM i, k
UNION ALL SELECT 'tax', R6(b), R6(sqrt(i01 * i01 * w0 + 2 * i01 * i11 * w1 + i11 * i11 * w2)) FROM i, k""",
)
def _(t):
    terms = {"Intercept": F.lit(1.0), "tax": F.col("l_tax") * 10}
    return stats.ols_hc3(t.lineitem, "l_discount", terms).select("term", "coef", "std_err")


def _mixed_sql(ddof):
    """Each item has one row of either structure, so the fit splits into means and differences of items."""
    free = f"(g - {ddof})"
    return f"""WITH w AS (SELECT condition, item_index, max(CASE WHEN target_structure = 'passive' THEN sentence_pe_mean END) AS p, max(CASE WHEN target_structure = 'active' THEN sentence_pe_mean END) AS a FROM ({ITEM_PE}) i GROUP BY 1, 2),
m AS (SELECT condition, CAST(count(*) AS DOUBLE) AS g, avg(p - a) AS d, avg(a) AS i, var_pop(p - a) / 2 AS s, 2 * var_pop((p + a) / 2) AS b FROM w WHERE p - a IS NOT NULL GROUP BY 1),
v AS (SELECT *, g / {free} * CASE WHEN b > s THEN s ELSE (s + b) / 2 END AS sigma, g / {free} * CASE WHEN b > s THEN (b - s) / 2 ELSE 0 END AS tau FROM m),
r AS (SELECT condition, 'Intercept' AS term, i AS coef, sqrt((sigma + tau) / g) AS std_err, v.* EXCLUDE (condition) FROM v UNION ALL SELECT condition, 'passive', d, sqrt(2 * sigma / g), v.* EXCLUDE (condition) FROM v)
SELECT condition, term, R6(coef) AS coef, R6(std_err) AS std_err, R6(coef / std_err) AS z_stat, R6(tau) AS group_variance, R6(sigma) AS residual_variance, R6(tau / sigma) AS variance_ratio,
  CAST(2 * g AS BIGINT) AS n_obs, CAST(g AS BIGINT) AS n_groups FROM r"""


def _mixed(t, method):
    terms = {"Intercept": F.lit(1.0), "passive": (F.col("target_structure") == "passive").cast("int")}
    out = fits.random_intercept(item_table(t), ["condition"], "item_index", "sentence_pe_mean", terms, method)
    return out.select(
        "condition", "term", "coef", "std_err", "z_stat", "group_variance", "residual_variance", "variance_ratio", "n_obs", "n_groups"
    )


@query("st15_random_intercept", _mixed_sql(0))
def _(t):
    return _mixed(t, "ml")


@query("st15_random_intercept_reml", _mixed_sql(1))
def _(t):
    return _mixed(t, "reml")


@query("st15_random_intercept_terms")
def _(t):
    terms = {
        "Intercept": F.lit(1.0),
        "passive": (F.col("target_structure") == "passive").cast("int"),
        "target_length": F.col("target_length"),
    }
    return fits.random_intercept(_sides(t), ["condition"], "item_index", "sentence_pe_mean", terms)


@query(
    "st16_ols",
    """WITH c AS (SELECT avg(CASE WHEN a = 0 AND b = 0 THEN y END) AS m00, avg(CASE WHEN a = 1 AND b = 0 THEN y END) AS m10, avg(CASE WHEN a = 0 AND b = 1 THEN y END) AS m01,
  avg(CASE WHEN a = 1 AND b = 1 THEN y END) AS m11 FROM (SELECT active_choice_logprob AS y, CAST(role_order = 'agent_first' AS INT) AS a, CAST(lexicality_condition = 'core' AS INT) AS b FROM item_scores) d)
SELECT 'Intercept' AS term, R6(m00) AS coef FROM c UNION ALL SELECT 'agent_first', R6(m10 - m00) FROM c UNION ALL SELECT 'core', R6(m01 - m00) FROM c
UNION ALL SELECT 'agent_first:core', R6(m11 - m10 - m01 + m00) FROM c""",
)
def _(t):
    a = (F.col("role_order") == "agent_first").cast("int")
    b = (F.col("lexicality_condition") == "core").cast("int")
    terms = {"Intercept": F.lit(1.0), "agent_first": a, "core": b, "agent_first:core": a * b}
    return stats.ols(t.item_scores(), "active_choice_logprob", terms).select("term", "coef")


@query(
    "st17_binomial_glm",
    """WITH c AS (SELECT o_orderpriority = '1-URGENT' AS u, ln(count_if(o_orderstatus = 'O') / count_if(o_orderstatus <> 'O')) AS g FROM orders GROUP BY 1)
SELECT '(Intercept)' AS term, round(max(CASE WHEN NOT u THEN g END), 4) AS coef FROM c
UNION ALL SELECT 'urgent', round(max(CASE WHEN u THEN g END) - max(CASE WHEN NOT u THEN g END), 4) FROM c""",
)
def _(t):
    rows = t.orders.withColumn("is_correct", F.col("o_orderstatus") == "O")
    cells = summaries.binomial_cells(rows, ["o_orderpriority", "o_custkey"], "is_correct")
    out = stats.binomial_glm(
        cells, "correct", "total", {"urgent": (F.col("o_orderpriority") == "1-URGENT").cast("int")}
    )
    return out.select("term", F.round("coef", 4).alias("coef"))


_FITTED = ["fitted", "fitted_se", "log_odds", "probability_shift", "probability_shift_se", "log_odds_shift", "log_odds_shift_se"]


def _passive_rows(t):
    chosen = clean.choose_structure("active_choice_logprob", "passive_choice_logprob")
    return t.item_scores().withColumn("hit", (chosen == "passive").cast("int"))


@query(
    "st24_fitted_shift",
    """WITH c AS (SELECT model_condition, lexicality_condition, prime_condition, count(*) AS n, avg(CASE WHEN passive_choice_logprob > active_choice_logprob THEN 1.0 ELSE 0.0 END) AS p FROM item_scores GROUP BY 1, 2, 3),
b AS (SELECT c.*, ln(p / (1 - p)) AS l, p * (1 - p) / n AS v, 1 / (n * p * (1 - p)) AS lv FROM c)
SELECT x.model_condition, x.lexicality_condition, x.prime_condition, x.n, R6(x.p) AS observed, R6(x.p) AS fitted, R6(sqrt(x.v)) AS fitted_se, R6(x.l) AS log_odds, R6(x.p - y.p) AS probability_shift,
  R6(CASE WHEN x.prime_condition = 'no_prime' THEN 0 ELSE sqrt(x.v + y.v) END) AS probability_shift_se, R6(x.l - y.l) AS log_odds_shift, R6(CASE WHEN x.prime_condition = 'no_prime' THEN 0 ELSE sqrt(x.lv + y.lv) END) AS log_odds_shift_se
FROM b x LEFT JOIN b y ON x.model_condition = y.model_condition AND x.lexicality_condition = y.lexicality_condition AND y.prime_condition = 'no_prime'""",
)
def _(t):
    out = fits.fitted_shifts(
        _passive_rows(t), [], ["model_condition", "lexicality_condition"], "prime_condition", "hit", "no_prime", crossed=None
    )
    return out.select("model_condition", "lexicality_condition", "prime_condition", "n", "observed", *_FITTED)


@query("st24_fitted_shift_averaged")
def _(t):
    return fits.fitted_shifts(
        _passive_rows(t), [], ["lexicality_condition"], "prime_condition", "hit", "no_prime",
        crossed=[("prime_condition", "lexicality_condition")], averaged=["model_condition"],
    )


_CONTRASTS = {
    "incongruent - no_prime": {"no_prime": -1, "incongruent": 1},
    "congruent - no_prime": {"no_prime": -1, "congruent": 1},
    "congruent - incongruent": {"incongruent": -1, "congruent": 1},
}


def _contrast_rows(t):
    rows = review.score_answers(t.role_answers(), "answer_raw", "correct_head", "foil_head")
    return rows.withColumn("relation", clean.prime_relation("prime_condition", "target_voice"))


_REL = f"""(SELECT *, CASE WHEN prime_condition = 'no_prime' THEN 'no_prime' WHEN prime_condition = target_voice THEN 'congruent' ELSE 'incongruent' END AS rel,
  CASE WHEN matched_label = 'correct' THEN 1.0 ELSE 0.0 END AS y FROM {ANSWERS}) r"""


@query(
    "st25_contrast",
    f"""WITH c AS (SELECT lexicality_condition, question_type, rel, avg(y) AS m, var_samp(y) / count(*) AS v FROM {_REL} GROUP BY 1, 2, 3),
k AS (SELECT * FROM (VALUES ('incongruent - no_prime', 'no_prime', -1.0), ('incongruent - no_prime', 'incongruent', 1.0), ('congruent - no_prime', 'no_prime', -1.0), ('congruent - no_prime', 'congruent', 1.0),
  ('congruent - incongruent', 'incongruent', -1.0), ('congruent - incongruent', 'congruent', 1.0)) v(contrast, rel, w))
SELECT lexicality_condition, question_type, contrast, R6(sum(w * m)) AS estimate, R6(sqrt(sum(w * w * v))) AS std_err FROM c JOIN k USING (rel) GROUP BY 1, 2, 3""",
)
def _(t):
    out = stats.contrast_holm(
        _contrast_rows(t), ["lexicality_condition", "question_type"], "relation",
        F.col("is_correct").cast("int"), _CONTRASTS,
    )
    return out.select("lexicality_condition", "question_type", "contrast", "estimate", "std_err")


@query("st25_contrast_holm")
def _(t):
    return stats.contrast_holm(
        _contrast_rows(t), ["lexicality_condition", "question_type"], "relation",
        F.col("is_correct").cast("int"), _CONTRASTS,
    )


_METRIC_SQL = {**effect_columns("sum"), **effect_columns("mean")}
_LONG = "".join(f", {_METRIC_SQL[m]} AS \"{m}\"" for m in fixed.EFFECT_METRICS)
_MOMENTS = """count(d) AS n_items, R6(avg(d)) AS mean, R6(CASE WHEN count(d) = 1 THEN 0 ELSE stddev_samp(d) END) AS sd,
  R6(CASE WHEN count(d) > 1 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(d))) END) AS t_stat"""


@query(
    "st03_summarize_effects",
    f"""WITH u AS (SELECT lexicality_condition{_LONG} FROM {WIDE}),
l AS (SELECT lexicality_condition, unnest([{", ".join(f"'{m}'" for m in fixed.EFFECT_METRICS)}]) AS metric, unnest([{", ".join(f'"{m}"' for m in fixed.EFFECT_METRICS)}]) AS d FROM u)
SELECT 'overall' AS summary_group, CAST(NULL AS VARCHAR) AS lexicality_condition, metric, {_MOMENTS} FROM l GROUP BY metric
UNION ALL SELECT 'by_lexicality', lexicality_condition, metric, {_MOMENTS} FROM l GROUP BY lexicality_condition, metric""",
)
def _(t):
    items = effects.paired_effect_long(long_scores(t), ["item_id", "lexicality_condition"])
    out = stats.summarize_effects(
        items, {"overall": [], "by_lexicality": ["lexicality_condition"]}, "item_id", fixed.EFFECT_METRICS,
        n_resamples=FLIPS,
    )
    return out.select(
        "summary_group", "lexicality_condition", "metric", "n_items", "mean", "sd", "t_stat"
    )


@query("st03_summarize_effects_p")
def _(t):
    items = effects.paired_effect_long(long_scores(t), ["item_id", "lexicality_condition"])
    return stats.summarize_effects(
        items, {"overall": [], "by_lexicality": ["lexicality_condition"]}, "item_id", fixed.EFFECT_METRICS,
        n_resamples=FLIPS,
    )


@query(
    "ar17_elogit",
    f"""SELECT lexicality_condition, question_type, R6(ln((c + 0.5) / (n - c + 0.5))) AS elogit, R6(ln((c + 0.5) / (f + 0.5))) AS logodds, R6(CASE WHEN c > 0 THEN ln(c) END) AS log_c,
  CAST(NULL AS DOUBLE) AS log_zero FROM (SELECT lexicality_condition, question_type, count_if(matched_label = 'correct') AS c, count_if(matched_label = 'foil') AS f, count(*) AS n FROM {ANSWERS} GROUP BY 1, 2) q""",
)
def _(t):
    rows = review.score_answers(t.role_answers(), "answer_raw", "correct_head", "foil_head")
    cells = summaries.accuracy_summary(rows, ["lexicality_condition", "question_type"])
    return cells.select(
        "lexicality_condition", "question_type",
        clean.empirical_logit("correct_n", "n_items").alias("elogit"),
        clean.smoothed_logodds("correct_n", "foil_n").alias("logodds"),
        clean.safe_log("correct_n").alias("log_c"),
        clean.safe_log(F.col("correct_n") * 0).alias("log_zero"),
    )

