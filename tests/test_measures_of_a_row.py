"""Measures of a unit travel as one row: the same draws, sums and statistics as from a row for each measure."""

import math

import pytest
from pyspark.sql import functions as F

from pairlens.operators import resample, stats

NAMES = ["m", "n", "none"]


def units(spark):
    """A unit that comes twice, measures that some units lack, one that all lack, a null group."""
    return spark.sql(
        "SELECT IF(id = 7, 6, id) AS id, IF(id % 3 = 0, NULL, 'g') AS g, IF(id % 4 = 0, NULL, cos(id)) AS m, "
        "IF(id % 5 < 2, NULL, sin(id)) AS n, CAST(NULL AS DOUBLE) AS none FROM range(200)"
    )


@pytest.mark.parametrize("signs", [False, True])
def test_sums_of_arrays_are_those_of_rows(spark, signs):
    df, n = units(spark), resample._PART + 30
    wide = df.select("id", "g", F.array(*NAMES).alias("x"))
    long = df.select("id", "g", F.explode(F.create_map(*[c for m in NAMES for c in (F.lit(m), F.col(m))])).alias("metric", "x"))
    by = ["g", "metric"]
    got, want = (
        {(r.g, r.metric, r["__draw"]): (r["__sum"], r["__weight"]) for r in resample._drawn_sums(rows, by, "id", "x", n, 3, signs, ["metric"], *more).collect()}
        for rows, more in ((wide, [NAMES]), (long, []))
    )
    assert got.keys() == want.keys() and len(got) == 4 * n
    assert all(math.isclose(a, b, abs_tol=1e-9) for k in got for a, b in zip(got[k], want[k]))


def test_a_unit_is_one_row_of_a_test(spark, monkeypatch):
    met, drawn = [], resample._drawn_sums

    def noted(df, *rest):
        met.append(df.count())
        return drawn(df, *rest)

    monkeypatch.setattr(resample, "_drawn_sums", noted)
    rows = stats.summarize_effects(units(spark), {"overall": [], "by_g": ["g"]}, "id", NAMES, n_resamples=200).collect()
    assert met == [400, 400]  # units x groupings, not x metrics too
    assert len(rows) == 9
    for r in rows:
        x = [math.cos(i) if r.metric == "m" else math.sin(i) for i in range(200) if (i % 4 if r.metric == "m" else i % 5 > 1)
             and (r.summary_group == "overall" or (i % 3 == 0) == (r.g is None))]
        if r.metric == "none":
            assert r.n_items == 0 and r.mean is None and r.perm_p_two_sided is None and r.bootstrap_ci95_low is None
        else:
            assert r.n_items == len(x) and math.isclose(r.mean, sum(x) / len(x), abs_tol=1e-12)
            assert 0 <= r.perm_p_two_sided <= 1 and r.bootstrap_ci95_low <= r.mean <= r.bootstrap_ci95_high


def test_pairs_of_conditions_are_spread_once(spark):
    """The units' cells are gathered by one aggregation, which the three statistics share."""
    rows = spark.sql("SELECT id, c, IF(c = 'a', 0, 1) + cos(id) AS v FROM range(30) LATERAL VIEW explode(array('a', 'b')) AS c WHERE id > 0 OR c = 'a'")
    out = stats.pairwise_stats(rows, [], "id", {"v": "delta"}, ["a", "b"], "c", n_resamples=200)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "LogicalRDD" not in plan
    (r,) = out.collect()
    assert (r.metric, r.condition_a, r.condition_b, r.n_items) == ("delta", "a", "b", 29) and math.isclose(r.mean, 1.0)
