"""The bootstrap by multinomial splitting."""

import hashlib
import math

import numpy as np
import pytest

from pairlens.operators import resample


def test_halves_share_what_a_node_has():
    draws = np.full(500, 64)
    sizes = [3, 0, 10, 51]  # four blocks of one group
    node = {0: sum(sizes), 1: sum(sizes[:2]), 2: sum(sizes[2:])}
    got = []
    for block in range(4):
        high, low = block >> 1, block & 1
        path = [(node[0], node[1], bool(high)), (node[1 + high], sizes[2 * high], bool(low))]
        got.append(resample.split_draws(draws, path, "g"))
    assert (np.sum(got, axis=0) == 64).all() and (got[1] == 0).all()
    assert abs(np.mean(got[3]) - 51) < 0.6 and abs(np.var(got[3]) - 51 * 13 / 64) < 2.5


@pytest.mark.parametrize("rows", [1, 40, 3000])
def test_counts_add_up_and_do_not_depend_on_partitions(spark, rows):
    df = spark.range(2 * rows).selectExpr("id", "IF(id % 2 = 0, 'a', NULL) AS g", "sin(id) AS x")
    more = df.union(spark.createDataFrame([(10**6, "a", None)], df.schema))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            sums = resample.multinomial_sums(more.repartition(parts), ["g"], "id", "x", 1500, 7).collect()
            found.append({(r.g, r["__draw"]): (r["__sum"], r["__weight"]) for r in sums})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    one, many = found
    assert len(one) == len(many) == 3000
    for key, (total, weight) in one.items():
        assert weight == many[key][1] == rows and math.isclose(total, many[key][0], abs_tol=1e-9)
    if rows == 3000:
        for g, start in (("a", 0), (None, 1)):
            x = np.sin(np.arange(start, 2 * rows, 2))
            means = np.array([v[0] / rows for k, v in one.items() if k[0] == g])
            assert abs(means.mean() - x.mean()) < 5 * x.std() / math.sqrt(rows * 1500)
            assert abs(means.std() / (x.std() / math.sqrt(rows)) - 1) < 0.1


def test_intervals_agree_with_the_other_forms(spark):
    df = spark.range(400).selectExpr("id", "sin(id * 7) + 0.2 AS x")
    a, b = (resample.bootstrap_ci(df, [], "id", "x", 2000, method=m).collect()[0] for m in ("multinomial", "poisson"))
    width = a.ci_high - a.ci_low
    assert a.n_rows == 400 and a.ci_low < a.mean < a.ci_high
    assert abs(a.ci_low - b.ci_low) < 0.1 * width and abs(a.ci_high - b.ci_high) < 0.1 * width
    with pytest.raises(ValueError):
        resample.bootstrap_ci(df, [], "id", "x", method="multinomial", common=["g"])
    assert resample.bootstrap_ci(df.limit(0), [], "id", "x", 10, method="multinomial").where("n_rows > 0").collect() == []


@pytest.mark.parametrize("n", [1, 11, 100, 101, 1203])
def test_digests_side_by_side_are_those_of_the_library(n):
    keys = [f"13|core|{i}" for i in range(7)] + ["", "\u00e9" * 12, *("y" * k for k in (48, 49, 50, 51, 52, 70))]
    got = resample.digests(keys, n)
    for key, row in zip(keys, got, strict=True):
        assert row.tobytes() == b"".join(hashlib.md5(f"{key}|{b}".encode()).digest() for b in range(n))


def test_poisson_counts_step_where_the_probabilities_do():
    edges = [s + d for s in resample._POISSON_STEPS for d in (-1, 0, 1) if s + d < 2**32]
    draws = np.array([0, 2**32 - 1, *edges], np.uint32)
    want = np.searchsorted(resample._POISSON_CDF, draws / 2.0**32, side="right")
    assert resample.poisson_counts(draws).tolist() == want.tolist()


def test_few_digests_of_many_keys_are_worked_out_side_by_side(monkeypatch):
    keys = [f"42|{c}|{10**k + i}" for c in ("core", "mixed") for k in (2, 5) for i in range(900)]
    want = [b"".join(hashlib.md5(f"{key}|{b}".encode()).digest() for b in range(79)) for key in keys]

    def one_by_one(_):
        raise AssertionError("a digest of the library, of which each costs a call")

    monkeypatch.setattr(resample, "md5", one_by_one)
    monkeypatch.setattr(resample, "_FEW", 1000)
    assert [row.tobytes() for row in resample.digests(keys, 79)] == want


@pytest.mark.parametrize("n", [1, 11, 1203])
def test_any_number_of_digests_side_by_side_are_those_of_the_library(monkeypatch, n):
    monkeypatch.setattr(resample, "_FEW", 1)
    monkeypatch.setattr(resample, "_LANES", 500)
    keys = [f"13|core|{i}" for i in range(7)] + ["", "\u00e9" * 12, *("y" * k for k in (1, 2, 3, 48, 49, 50, 51, 52, 53, 54, 70))]
    for key, row in zip(keys, resample.digests(keys, n), strict=True):
        assert row.tobytes() == b"".join(hashlib.md5(f"{key}|{b}".encode()).digest() for b in range(n))


@pytest.mark.parametrize("signs", [False, True])
def test_sums_are_those_of_whole_rows_of_weights(spark, signs):
    """More resamples than are multiplied at a time, keys of several lengths, two groups of the same units."""
    n, x = resample._TILE + 100, {i: (i % 7) - 2.5 for i in [*range(95, 105), 99_999, 100_000]}
    rows = spark.createDataFrame([(m, i, v * s) for i, v in x.items() for m, s in (("a", 1.0), ("b", -3.0))], "m string, id long, x double")
    got = {(r.m, r["__draw"]): (r["__sum"], r["__weight"]) for r in resample._drawn_sums(rows, ["m"], "id", "x", n, 5, signs, ["m"]).collect()}
    per = 128 if signs else 4
    sums = np.zeros((2, n))
    for i, v in x.items():
        drawn = b"".join(hashlib.md5(f"5|{i}|{b}".encode()).digest() for b in range(-(-n // per)))
        if signs:
            w = np.unpackbits(np.frombuffer(drawn, np.uint8))[:n] * 2.0 - 1.0
        else:
            w = np.searchsorted(resample._POISSON_CDF, np.frombuffer(drawn, ">u4")[:n] / 2.0**32, side="right")
        sums += [w * v, w]
    assert len(got) == 2 * n
    for (m, draw), (total, weight) in got.items():
        assert abs(total - sums[0, draw] * (1 if m == "a" else -3)) < 1e-9 and abs(weight - sums[1, draw]) < 1e-9


def test_sums_of_tasks_are_added_before_they_become_rows(spark):
    rows = spark.sql("SELECT id, IF(id % 3 = 0, NULL, id % 3) AS g, IF(id % 2 = 0, 'even', NULL) AS h, IF(id % 5 = 0, NULL, cos(id)) AS x FROM range(400)")
    sums = resample._drawn_sums(rows, ["g", "h"], "id", "x", resample._PART + 50, 3, False)
    steps = [line.split("(")[0].strip(" +-:*") for line in sums._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    explode = next(i for i, s in enumerate(steps) if s.startswith("Generate posexplode"))
    below = [s.split(" ")[0] for s in steps[explode:]]
    assert below.count("MapInArrow") == 2  # tasks' arrays, and their sum
    got = {(r.g, r.h, r["__draw"]): (r["__sum"], r["__weight"]) for r in sums.collect()}
    assert len(got) == 6 * (resample._PART + 50)
    for g, h in ((None, None), (2, "even")):
        named = f"3|{'' if g is None else g}|{'' if h is None else h}|"
        ids = [i for i in range(400) if i % 5 and (i % 3 or None) == g and ("even" if i % 2 == 0 else None) == h]
        drawn = resample.digests([f"{named}{i}" for i in ids], (resample._PART + 53) // 4)
        w = resample.poisson_counts(drawn.view(">u4")[:, : resample._PART + 50].astype(np.uint32))
        for draw in (0, resample._PART - 1, resample._PART, resample._PART + 49):
            assert got[g, h, draw][1] == w[:, draw].sum()
            assert abs(got[g, h, draw][0] - sum(math.cos(i) * c for i, c in zip(ids, w[:, draw]))) < 1e-9
