"""The p-value queries test every metric at the full draws, with the moments that SQL gives."""

import math

import check
from pairlens.catalog import QUERIES, registry, statistics, tokens
from pairlens.catalog.aggregates import _SCORES
from pairlens.catalog.effects import WIDE
from pairlens.functions import fixed
from pairlens.operators import resample

SF = "/root/testdata/sf0.001"


def result(spark, monkeypatch, name):
    draws, drawn = [], resample._drawn_sums

    def noted(df, by, unit, value, n, *rest):
        draws.append(n)
        return drawn(df, by, unit, value, n, *rest)

    monkeypatch.setattr(resample, "_drawn_sums", noted)
    rows = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert draws == [10_000, 10_000]
    for r in rows:
        assert 0 <= r["perm_p_two_sided"] <= 1 and r["bootstrap_ci95_low"] <= r["mean"] <= r["bootstrap_ci95_high"]
    return rows


def same_moments(rows, keys, sql):
    want = check.duck(SF).execute(registry.with_views(sql)).fetchall()
    got = {tuple(r[k] for k in keys): (r["n_items"], r["mean"], r["sd"]) for r in rows}
    assert len(want) == len(got) == len(rows)
    for *key, n, mean, sd in want:
        found = got[tuple(key)]
        assert found[0] == n and math.isclose(found[1], mean, abs_tol=2e-6) and math.isclose(found[2], sd, abs_tol=2e-6)


def test_effects_of_all_metrics(spark, monkeypatch):
    rows = result(spark, monkeypatch, "st03_summarize_effects_p")
    assert {r["metric"] for r in rows} == set(fixed.EFFECT_METRICS) and len(fixed.EFFECT_METRICS) == 18
    sql = " UNION ALL ".join(
        f"SELECT '{g}', {lex}, '{m}', count(d), avg(d), coalesce(stddev_samp(d), 0) FROM (SELECT lexicality_condition, {statistics._METRIC_SQL[m]} AS d FROM {WIDE}) q {by}"
        for g, lex, by in (("overall", "NULL", ""), ("by_lexicality", "lexicality_condition", "GROUP BY lexicality_condition"))
        for m in fixed.EFFECT_METRICS
    )
    same_moments(rows, ["summary_group", "lexicality_condition", "metric"], sql)


def test_pairwise_metrics(spark, monkeypatch):
    rows = result(spark, monkeypatch, "st10_pairwise_stats_p")
    order = statistics._ORDER
    values = {"passive_choice_delta": "CASE WHEN chosen_structure = 'passive' THEN 1.0 ELSE 0.0 END", "logprob_delta": "passive_minus_active_logprob"}
    sql = " UNION ALL ".join(
        f"SELECT lexicality_condition, '{m}', '{a}', '{b}', count(d), avg(d), coalesce(stddev_samp(d), 0) FROM (SELECT lexicality_condition, item_id, avg({v}) FILTER (prime_condition = '{b}') - avg({v}) FILTER (prime_condition = '{a}') AS d FROM {_SCORES} GROUP BY 1, 2) q WHERE d IS NOT NULL GROUP BY 1"
        for m, v in values.items() for i, a in enumerate(order) for b in order[i + 1 :]
    )
    same_moments(rows, ["lexicality_condition", "metric", "condition_a", "condition_b"], sql)


def test_paired_metrics(spark, monkeypatch):
    rows = result(spark, monkeypatch, "st14_paired_metric_tests_p")
    sql = " UNION ALL ".join(
        f"SELECT condition, '{m}', count(d), avg(d), stddev_samp(d) FROM (SELECT condition, item_index, max({m}) FILTER (target_structure = 'passive') - max({m}) FILTER (target_structure = 'active') AS d FROM ({tokens.ITEM_PE}) i GROUP BY 1, 2) q WHERE d IS NOT NULL GROUP BY 1"
        for m in ("sentence_pe_mean", "sentence_pe", "post_divergence_pe_mean", "critical_word_pe_mean")
    )
    same_moments(rows, ["condition", "metric"], sql)


def test_review_values_match_sql(spark):
    assert check.compare(spark, check.duck(SF), SF, "tx31_review_values")[0].startswith("ok")


def test_metrics_of_a_unit_share_their_draws(spark):
    """With common columns each group gets what it gets alone under the same key."""
    rows = spark.range(300).selectExpr("id", "'a' AS g", "explode(array('m', 'n')) AS metric", "sin(id) + IF(metric = 'm', 0, 0.1) AS x")
    both = resample.bootstrap_ci(rows, ["g", "metric"], "id", "x", 500, common=["metric"]).collect()
    for r in both:
        alone = resample.bootstrap_ci(rows.where(f"metric = '{r.metric}'"), ["g"], "id", "x", 500).collect()[0]
        assert math.isclose(r.ci_low, alone.ci_low, abs_tol=1e-9) and math.isclose(r.ci_high, alone.ci_high, abs_tol=1e-9)


def test_small_p_values_are_not_rounded_away(spark):
    p = [r.p_value for r in QUERIES["st06_one_sample_p"](spark, SF).collect()]
    assert any(0 < x < 1e-6 for x in p if x is not None) or all(x is None or x >= 5e-7 for x in p)
