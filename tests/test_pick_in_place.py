"""Rotating picks: rows with a key of their own meet no shuffle, rows that share one are picked as before."""

import pytest
from pyspark.sql import functions as F

from pairlens.operators import ranking

WORDS = "abcdefg"


def pool(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "position int, word string")


def picked(df, words):
    used = F.array(F.col("w"), F.lit("d"))
    return ranking.rotating_pick(df, ["id", "c"], used, F.col("id") * 3, F.when(F.col("id") % 5 != 3, 2), words)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, twice=""):
    """Null ids, a null word among the used ones, rows without a count."""
    ids = f"SELECT explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, NULL {twice})) AS id"
    return spark.sql(f"SELECT id, c, IF(id = 4, NULL, IF(c = 0, 'b', 'f')) AS w FROM ({ids}) LATERAL VIEW explode(array(0, 1)) AS c")


def test_rows_with_their_own_key_meet_no_shuffle(spark):
    out = picked(frame(spark), pool(spark))
    # the pool alone is gathered, to one row
    assert "hashpartitioning" not in plan(out) and "Join" not in plan(out)
    for id_, _, used, picks in rows(out):
        # an unknown used word may be any word, so nothing is free beside it
        free = [] if id_ in (None, 4) or id_ % 5 == 3 else [w for w in (WORDS[(3 * id_ + k) % 7] for k in range(4)) if w not in (used, "d")][:2]
        assert picks == free


@pytest.mark.parametrize("twice", ["", ", 6, 6, NULL"])
def test_picks_are_those_of_the_join(spark, twice):
    df = frame(spark, twice)
    used = F.array(F.col("w"), F.lit("d"))
    count = F.when(F.col("id") % 5 != 3, 2)
    want = ranking._picks_by_join(df, ["id", "c"], used, F.col("id") * 3, count, pool(spark), 7)
    got = picked(df, pool(spark))
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(got)) == (28 if twice else 22)


def test_other_pools_meet_by_the_join(spark, monkeypatch):
    df = frame(spark)
    gaps = spark.createDataFrame([(0, "a"), (2, "c"), (2, "e")], "position int, word string")
    assert "Join" in plan(picked(df, gaps))
    want = rows(picked(df, pool(spark)))
    monkeypatch.setattr(ranking, "_POOL_IN_A_ROW", 6)
    large = picked(df, pool(spark))
    assert "Join" in plan(large) and rows(large) == want
