import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.functions import fixed
from pairlens.operators import (
    corpus, effects, joins, neighbors, ranking, resample, review, stats, summaries, tokens, validate, vectors,
)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def random_words(n, low, high, alphabet, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)]
    out = set(base)
    for w in base:  # near copies, so that pairs exist at every length
        w = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w) + 1)
            kind = rng.random()
            if kind < 0.34 and w:
                w[min(i, len(w) - 1)] = rng.choice(alphabet)
            elif kind < 0.67:
                w.insert(i, rng.choice(alphabet))
            elif len(w) > 1:
                del w[min(i, len(w) - 1)]
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("same_initial", [True, False])
def test_edit_pairs_match_brute_force(spark, same_initial):
    left = random_words(60, 1, 24, "abc", 1)
    right = random_words(60, 1, 24, "abc", 1)[::2] + random_words(40, 9, 15, "ab", 2)
    a = spark.createDataFrame([(w,) for w in left], "word string")
    b = spark.createDataFrame([(w,) for w in sorted(set(right))], "word string")
    want = {
        (x, y, levenshtein(x, y))
        for x, y in itertools.product(left, set(right))
        if x != y and (not same_initial or x[0] == y[0]) and levenshtein(x, y) <= 2
    }
    got = set(rows(neighbors.edit_pairs(a, b, 2, same_initial)))
    assert got == want and len(want) > 50


def test_position_in_group_equals_row_number(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("hot"), F.md5(F.col("id").cast("string")).alias("h"))
    by_id = ranking.position_in_group(df, ["hot"], ["id"], F.floor(F.col("id") / 100))
    by_hash = ranking.position_in_group(df, ["hot"], ["h"], ranking.hash_bucket(F.col("id"), digits=2))
    for out, key in ((by_id, "id"), (by_hash, "h")):
        want = F.row_number().over(W.partitionBy("hot").orderBy(key)) - 1
        assert out.withColumn("w", want).where("w <> position").count() == 0


def test_blocks_hold_about_width_rows_whatever_the_index(spark):
    dense = spark.range(100_000).select("id", F.col("id").alias("i"))
    far = spark.createDataFrame([(100_000, 2**60), (100_001, -(2**60))], dense.schema)
    same = spark.range(100_002, 130_002).select("id", F.lit(777).alias("i"))
    hashes = spark.range(2000).select("id", F.xxhash64("id").alias("i"))
    for df, width in ((dense.union(far), 1000), (dense.union(same), 1000), (hashes, 100)):
        blocks = ranking.ranked_blocks(df.withColumn("g", F.lit("one")), ["g"], ["i"], width)
        sizes = [r["count"] for r in blocks.groupBy("__block").count().collect()]
        assert max(sizes) < 2 * width and sum(sizes) == df.count()
    out = ranking.position_by_rank(dense.union(far).withColumn("g", F.col("i") % 2), ["g"], ["i"], 1000)
    want = F.row_number().over(W.partitionBy("g").orderBy("i")) - 1
    assert out.withColumn("w", want).where("w <> position").count() == 0 and "__tie" not in out.columns
    ties = ranking.position_by_rank(same.withColumn("g", F.lit(None).cast("int")), ["g"], ["i"], 1000)
    assert sorted(r.position for r in ties.collect()) == list(range(30_000))
    assert ranking.position_by_rank(hashes.limit(0), [], ["i"]).collect() == []


def test_counterbalance_differs_by_at_most_one(spark):
    df = spark.range(997).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("cell"))
    out = ranking.counterbalance(df, ["cell"], "id", width=50)
    counts = out.groupBy("cell").agg(
        F.count_if(F.col("role_order") == "agent_first").alias("a"), F.count_if(F.col("role_order") != "agent_first").alias("p")
    )
    assert all(0 <= r.a - r.p <= 1 for r in counts.collect()) and out.count() == 997


def test_rotating_pick_skips_used_words_and_runs_out(spark):
    words = "abcdefg"
    pool = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "position int, word string")
    used = F.when(F.col("id") == 1, F.array(*map(F.lit, words))).when(F.col("id") == 2, F.array(*map(F.lit, "abcdef")))
    df = spark.range(40).select("id", used.otherwise(F.array(F.lit("b"), F.lit("d"))).alias("u"))
    got = dict(rows(ranking.rotating_pick(df, ["id"], F.col("u"), F.col("id") * 3, F.lit(2), pool).select("id", "picks"), "id"))
    for i, picks in got.items():
        taken = set(words) if i == 1 else set("abcdef") if i == 2 else {"b", "d"}
        assert picks == [w for w in (words[(3 * i + k) % 7] for k in range(7)) if w not in taken][:2]
    none = ranking.rotating_pick(df, ["id"], F.col("u"), F.col("id"), F.lit(2), pool.limit(0))
    assert none.where("size(picks) <> 0 or picks is null").count() == 0 and none.count() == 40


def test_zscore_of_constant_and_single(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), (None, 3.0), (None, 5.0)], "g string, x double")
    z = {(r.g, r.x): r.x_z for r in ranking.zscore(df, "x", ["g"]).collect()}
    assert z[("a", 1.0)] is None and z[("b", 2.0)] is None and z[(None, 3.0)] == pytest.approx(-0.70710678)


SCORES = [
    ("m", "u1", "active", -1.0, -2.0), ("m", "u1", "active", -3.0, -2.0), ("m", "u1", "passive", -4.0, -1.0),
    ("m", "u2", "active", -1.0, -1.0),  # lacks passive
    ("m", "u3", "active", float("inf"), -1.0), ("m", "u3", "passive", -1.0, -1.0),  # not finite
    (None, "u4", "active", -1.0, -1.0), (None, "u4", "passive", -1.0, -1.0),  # null key
    ("m", "u5", "active", float("nan"), -2.0), ("m", "u5", "active", -1.0, -2.0), ("m", "u5", "passive", -2.0, -1.0),
]


def test_paired_effect_edge_rules(spark):
    df = spark.createDataFrame(SCORES, "g string, u string, prime_condition string, active_choice_logprob double, passive_choice_logprob double")
    got = {r.u: r for r in effects.paired_effect(df, ["g"], "u").collect()}
    assert set(got) == {"u1", "u5"}
    r = got["u1"]
    assert r.pe_active_target_logprob_same_minus_other == 2.0 and r.pe_passive_target_logprob_same_minus_other == 1.0
    assert r.pe_logprob_imbalance_passive_minus_active == -1.0
    assert got["u5"].pe_active_target_logprob_same_minus_other == 1.0


def test_one_sample_small_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0), ("c", 3.0), ("d", 1.0), ("d", 1.0)], "g string, x double")
    out = {r.g: r for r in stats.one_sample(df, ["g"], "x", single_sd=0.0).collect()}
    assert (out["a"].n_items, out["a"].mean) == (0, None)
    assert (out["b"].n_items, out["b"].sd, out["b"].t_stat) == (1, 0.0, None)
    assert out["c"].t_stat == pytest.approx(2.0) and out["c"].p_value == pytest.approx(0.2951672, abs=1e-6)
    assert out["d"].t_stat is None


def test_baseline_shift_drops_units_without_baseline(spark):
    df = spark.createDataFrame(
        [(1, "no_prime", 1.0), (1, "active", 3.0), (2, "active", 1.0), (3, "no_prime", 2.0)], "u int, prime_condition string, logodds_passive double"
    )
    assert rows(effects.baseline_shift(df, ["u"]).select("u", "prime_type", "shift_from_no_prime")) == [(1, "active", 2.0)]


def units(spark):
    return spark.range(60).select((F.col("id") % 2).alias("g"), "id", ((F.col("id") * 37 % 11) / 10.0).alias("x"))


def test_resampling_does_not_depend_on_partitions(spark):
    df = units(spark)
    for method in ("poisson", "exact"):
        a = rows(resample.bootstrap_ci(df, ["g"], "id", "x", 80, method=method), "g")
        b = rows(resample.bootstrap_ci(df.repartition(5, "x"), ["g"], "id", "x", 80, method=method), "g")
        assert [r[:2] for r in a] == [r[:2] for r in b]
        assert np.allclose([r[2:] for r in a], [r[2:] for r in b])
        assert all(low <= mean <= high for _, _, mean, low, high in a)
    p = rows(resample.sign_flip_p(df, ["g"], "id", "x", 130), "g")
    assert p == rows(resample.sign_flip_p(df.repartition(3), ["g"], "id", "x", 130), "g")


def test_sign_flip_is_near_the_exact_p(spark):
    x = [0.5, -0.2, 0.9, 0.4, 0.1, 0.7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x double").withColumn("g", F.lit("a"))
    exact = np.mean([abs(np.dot(s, x)) >= abs(sum(x)) - 1e-9 for s in itertools.product([1, -1], repeat=6)])
    p = resample.sign_flip_p(df, ["g"], "id", "x", 4000).first().p_value
    assert abs(p - exact) < 0.03


def test_regressions_match_numpy(spark):
    rng = np.random.default_rng(5)
    x1, x2 = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x1 - x2 + rng.normal(size=200) * (1 + abs(x1))
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(y, x1, x2)], "y double, a double, b double")
    X = np.column_stack([np.ones(200), x1, x2])
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    e, h = y - X @ beta, np.einsum("ij,jk,ik->i", X, inv, X)
    hc3 = np.sqrt(np.diag(inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv))
    terms = {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}
    robust = stats.ols_hc3(df, "y", terms).toPandas()
    assert np.allclose(robust.coef, beta) and np.allclose(robust.std_err, hc3)
    plain = stats.ols(df, "y", terms).toPandas()
    assert np.allclose(plain.std_err, np.sqrt(np.diag(inv) * (e @ e) / 197))


def test_regression_with_redundant_and_single_row_levels(spark):
    rng = np.random.default_rng(9)
    rows_ = [(float(x), "abc"[i % 3] if i else "d", float(2 * x + (i % 3) + rng.normal())) for i, x in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows_, "x double, g string, y double")
    terms = stats.design(df, ["g"], ["x"], [("g", "x")])
    assert list(terms)[:5] == ["Intercept", "g[b]", "g[c]", "g[d]", "x"] and "g[b]:x" in terms
    twice = {**stats.design(df, ["g"], ["x"]), "again": F.col("x") * 3}
    got = {r.term: r for r in stats.ols_hc3(df, "y", twice).collect()}
    one = {r.term: r for r in stats.ols_hc3(df, "y", stats.design(df, ["g"], ["x"])).collect()}
    assert got["x"].coef + 3 * got["again"].coef == pytest.approx(one["x"].coef)
    assert got["g[b]"].std_err == pytest.approx(one["g[b]"].std_err) and one["g[d]"].std_err >= 0
    assert one["x"].ci95_low < one["x"].coef < one["x"].ci95_high
    classical = {r.term: r.df_resid for r in stats.ols(df, "y", twice).collect()}
    assert classical["x"] == 60 - 5


def test_holm(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double").withColumn("f", F.lit(1))
    got = {r.p: round(r.p_holm, 4) for r in stats.holm(df, ["f"], "p").collect()}
    assert got == {0.01: 0.04, 0.03: 0.09, 0.04: 0.09, 0.5: 0.5}


def test_blocked_cosine_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "id int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    got = vectors.cosine_neighbors(df, df, "id", "v", 3, exclude_self=True, block=7).toPandas()
    for q, part in got.groupby("query"):
        best = np.argsort(-sims[int(q)])[:3]
        assert part.sort_values("rank").reference.astype(int).tolist() == best.tolist()


@pytest.mark.parametrize("block", [4096, 97, 11])
def test_cosine_ties_go_to_the_smaller_name_for_any_block(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 5))
    v[::7] = v[0]
    refs = spark.createDataFrame([(f"{i + 1000}", list(map(float, r))) for i, r in enumerate(v)], "id string, v array<double>")
    query = spark.createDataFrame([("q", list(map(float, v[0])))], "id string, v array<double>")
    got = vectors.cosine_neighbors(query, refs, "id", "v", 5, block=block).orderBy("rank").collect()
    assert [r.reference for r in got] == ["1000", "1007", "1014", "1021", "1028"]


def test_a_null_vector_is_an_error(spark):
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "id string, v array<double>")
    with pytest.raises(Exception, match="a vector is null"):
        vectors.cosine_neighbors(one, one, "id", "v", 1).collect()


def test_review_queue_keeps_all_values(spark):
    df = spark.range(60).select(F.lit("k").alias("key"), F.lit("s").alias("sentence"), "id", (F.col("id") % 25).alias("x"))
    out = review.review_queue(df, "key", "sentence", ["x"], ["id"], ["id"]).first()
    assert len(out.x_list.split(";")) == 25 and out.occurrence_count == 60
    long = review.review_values(df, "key", ["x"]).collect()
    assert sum(r.n for r in long) == 60 and len(long) == 25


def test_lists_of_unequal_length_are_an_error(spark):
    columns = "id int, x_text string, x_label string, x_tokens array<string>, x_token_logprobs array<double>"
    even = spark.createDataFrame([(1, "a b", "active", ["a", " b"], [-1.0, -2.0]), (2, "", "active", [], [])], columns)
    assert tokens.explode_tokens(even, ["id"], {"x": "active"}).count() == 2
    odd = spark.createDataFrame([(1, "a", "active", ["a"], [-1.0, -2.0])], columns)
    with pytest.raises(Exception, match="differ in number"):
        tokens.explode_tokens(odd, ["id"], {"x": "active"}).collect()


def test_frequent_first_lookup_equals_a_join(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = big.groupBy("k").agg(F.count("*").alias("n")).where("k <> '4'").withColumn("v", F.length("k"))
    out = tokens.frequent_first_lookup(big, table, ["k"], ["v"], "n", F.col("id"), share=0.1)
    want = big.join(table.select("k", "v"), "k", "left")
    assert rows(out.select("id", "v"), "id") == rows(want.select("id", "v"), "id")


def test_uniqueness_claims(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    for mode in ("raise", "inline"):
        with pytest.raises(Exception, match="duplicate"):
            joins.join_checked(left, right, ["k"], check=mode).collect()
    with pytest.raises(ValueError, match="duplicate"):
        validate.assert_unique(left, ["k"])
    reviews = right.withColumnRenamed("y", "reviewed_x")
    with pytest.raises(Exception, match="duplicate review key"):
        review.overlay_reviews(left, reviews, ["k"], ["x"]).collect()


def test_validation_errors(spark):
    df = spark.createDataFrame([("i", "odd")], "item_id string, prime_condition string")
    with pytest.raises(ValueError, match="missing"):
        validate.require_columns(df, ["nope"])
    with pytest.raises(ValueError, match="odd"):
        validate.validate_values(df)
    with pytest.raises(ValueError, match="empty"):
        validate.validate_values(df.select(F.lit(" ").alias("item_id"), F.lit("active").alias("prime_condition")))
    with pytest.raises(ValueError, match="do not occur"):
        validate.select_subset(df, {"prime_condition": ["active"]})
    with pytest.raises(Exception, match="unknown prime_condition"):
        validate.checked_values(df).collect()
    with pytest.raises(ValueError):
        validate.condition_order(["sideways"])
    assert validate.condition_order(["none", "Active_Prime", "no_prime"]) == ["no_prime", "active"]
    with pytest.raises(ValueError, match="levels"):
        validate.assert_levels(df, ["item_id"], "prime_condition", 2)


def test_exhausted_bucket_is_an_error(spark):
    q = spark.createDataFrame(
        [(0, "the a asks the b .", "the b is asked by the a .", "the c asks the d .", "the d is asked by the c .")],
        "item_index int, ta string, tp string, pa string, pp string",
    )
    with pytest.raises(Exception, match="no prime left"):
        corpus.build_mixed(q, q).collect()
    assert corpus.build_mixed(q, q, require_all=False).first().pa is None


def test_contrasts_and_shares(spark):
    df = spark.createDataFrame([("g", "active", 0.2), ("g", "passive", 0.5), ("g", "odd", 0.9)], "g string, c string, v double")
    out = summaries.condition_contrasts(df, ["g"], "c", ["active", "passive"], {"v": "v"}).collect()
    assert len(out) == 1 and out[0].v_diff_b_minus_a == pytest.approx(0.3)
    shares = summaries.label_shares(df, "c", ["g"]).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)
    assert summaries.class_rates(df, "c", ["g", "absent"]) is None


def test_open_pool_falls_back_to_the_whole_pool(spark):
    df = spark.range(1)
    blocked = F.array(*[F.lit(w) for w in "the lantern traveler".split()])
    pool = fixed.CORE_FILLERS[:2]
    assert df.select(ranking.open_pool(pool, blocked)).first()[0] == list(pool)


def joins_run(df):
    """The join operators of the plan that ran, after Spark's own changes to it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [w for w in ("BroadcastHashJoin", "SortMergeJoin") for line in plan.splitlines() if w in line]


def test_edit_pairs_broadcast_no_keys(spark):
    words = spark.range(40).select(F.concat(F.lit("walking"), F.col("id").cast("string")).alias("word"))
    ran = joins_run(neighbors.edit_pairs(words, words, 2))
    assert set(ran) == {"SortMergeJoin"}


def test_lexicon_audit_broadcasts_no_words(spark):
    words = spark.range(40).select(F.concat(F.lit("walk"), F.col("id").cast("string")).alias("word"))
    ran = joins_run(neighbors.lexicon_audit(words, words, words))
    # Left over: the (initial, length) blocks, which don't grow with the words.
    assert ran.count("BroadcastHashJoin") <= 1 and "SortMergeJoin" in ran


def test_rotating_pick_broadcasts_the_pool_only(spark):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("c"))
    pool = spark.range(5).select(F.col("id").alias("position"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    used = F.array(F.concat(F.lit("w"), (F.col("id") % 5).cast("string")))
    out = ranking.rotating_pick(df, ["id", "c"], used, F.col("id"), F.lit(2), pool)
    assert joins_run(out).count("BroadcastHashJoin") <= 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    got = {r["id"]: r["picks"] for r in out.collect()}
    assert got == {i: [f"w{(i + 1) % 5}", f"w{(i + 2) % 5}"] for i in range(30)}
