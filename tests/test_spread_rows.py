"""Tasks get a bounded number of rows; pools are split once; tokens need no alignment unless asked."""

from pyspark.sql import functions as F

from pairlens.functions import fixed, text
from pairlens.operators import ranking
from pairlens.plans import views


def test_rows_a_task_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(5000).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    rows = views.Tables(spark, str(tmp_path))._parallel("events")
    assert rows.rdd.getNumPartitions() >= 50 and rows.count() == 5000
    assert max(len(p) for p in rows.rdd.glom().collect()) <= 130


def test_words_of_a_pool_are_literals(spark):
    pool = [*fixed.CORE_FILLERS, " The  Dog,cat\tsat . ", "É é.", "", "..", "a.b,c"]
    rows = spark.createDataFrame([(s,) for s in pool], "s string").select("s", text.plain_tokens("s", "all_punctuation").alias("t"))
    assert all(r.t == text.pool_words(r.s) for r in rows.collect())


def test_open_pool(spark):
    pool = ["The dog sat.", "A cat, a hat.", ""]
    rows = spark.createDataFrame([(1, ["dog", "x"]), (2, ["dog", "cat"]), (3, ["y", None]), (4, []), (5, None), (6, ["", "z"])], "i int, b array<string>")
    got = {r.i: r.k for r in rows.select("i", ranking.open_pool(pool, F.col("b")).alias("k")).collect()}
    old = F.filter(F.array(*[F.lit(s) for s in pool]), lambda s: ~F.arrays_overlap(text.plain_tokens(s, "all_punctuation"), F.col("b")))
    want = {r.i: r.k for r in rows.select("i", F.when(F.size(old) > 0, old).otherwise(F.array(*[F.lit(s) for s in pool])).alias("k")).collect()}
    assert got == want and got[1] == ["A cat, a hat.", ""]
    plan = rows.select(ranking.open_pool(pool, F.col("b")))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan.lower()


def test_tokens_without_words(spark, tmp_path):
    spark.range(40).selectExpr("id AS event_id", "id % 7 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    t = views.Tables(spark, str(tmp_path))
    whole, bare = t.token_rows(), t.token_rows(words=False)
    assert bare.columns == [c for c in whole.columns if c != "word_index"]
    assert bare.exceptAll(whole.drop("word_index")).count() == 0 and bare.count() == whole.count()
    assert "reduce" not in bare._jdf.queryExecution().optimizedPlan().toString().lower()
