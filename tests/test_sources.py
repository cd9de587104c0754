import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.plans import bundle
from pairlens.sources import shared, tables


def test_csv_header_with_mark_and_multiline(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Nouns ;F_Rank\n"x\ny";3\n"say ""hi""";4\n', encoding="utf-8")
    got = tables.read_table(spark, str(path), sep=";", tidy_header=True, multi_line=True)
    assert got.columns == ["nouns", "f_rank"]
    assert [tuple(r) for r in got.collect()] == [("x\ny", "3"), ('say "hi"', "4")]


def test_csv_columns_by_name(spark, tmp_path):
    for name, text in (("a", "score,item_id\n0.7,x\n"), ("b", "item_id,extra,score\ny,9,0.5\n"), ("c", "item_id\nz\n")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "items.csv").write_text(text)
    schema = "item_id string, score double"
    want = [("x", 0.7), ("y", 0.5), ("z", None)]
    found = tables.scan_runs(spark, str(tmp_path), "items.csv", schema)
    assert sorted((r.item_id, r.score) for r in found.collect()) == want
    paths = [str(tmp_path / n / "items.csv") for n in "abc"]
    assert sorted(tuple(r) for r in tables.read_table(spark, paths, schema).collect()) == want
    with pytest.raises(ValueError, match="score"):
        tables.read_table(spark, paths, schema, required=["score"])
    assert tables.scan_runs(spark, str(tmp_path), "items.csv", schema, contains=["none"]).collect() == []
    (tmp_path / "a" / "more.csv").write_text("item_id,score\nq,0.1\n")
    with pytest.raises(Exception, match="header"):
        tables.read_table(spark, str(tmp_path / "a"), schema).collect()


def test_jsonl_rejects_bad_lines(spark, tmp_path):
    schema = T.StructType.fromDDL("a int")
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    bad.write_text('{"a": 1}\n\n[1, 2]\n{"a": \n')
    assert sorted(r.a for r in tables.read_jsonl(spark, str(good), schema).collect()) == [1, 2]
    with pytest.raises(Exception, match="invalid JSON object line"):
        tables.read_jsonl(spark, str(bad), schema).collect()
    lines = tables.malformed_lines(spark, str(bad), schema).orderBy("line_number").collect()
    assert [r.line_number for r in lines] == [3, 4]


def test_lexicon_rules(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text('{"metadata": {}, "nouns": ["Bri", " dil "]}')
    assert [r.word for r in tables.read_lexicon(spark, str(path), minimum=2).orderBy("position").collect()] == ["bri", "dil"]
    for text in ('{"nouns": ["a", "A"]}', '{"nouns": ["a", " "]}', '{"other": []}'):
        path.write_text(text)
        with pytest.raises(Exception, match="lexicon must hold"):
            tables.read_lexicon(spark, str(path)).collect()


def test_optional_input(spark, tmp_path):
    schema = T.StructType.fromDDL("a int, b string")
    missing = tables.read_optional(spark, str(tmp_path / "none"), schema)
    assert missing.columns == ["a", "b"] and missing.isEmpty()


def test_partitions_resume(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "c string, v int")
    assert tables.run_partitioned(df, "c", ["x"], root) == ["x"]
    with pytest.raises(FileNotFoundError, match="y"):
        tables.read_partitioned(spark, "c", ["x", "y"], root)
    assert tables.run_partitioned(df, "c", ["x", "y"], root) == ["y"]
    assert tables.run_partitioned(df, "c", ["x", "y"], root) == []
    got = tables.read_partitioned(spark, "c", ["x", "y"], root).agg(F.sum("v")).first()[0]
    assert got == 6
    assert tables.run_partitioned(df, "c", ["z"], root) == ["z"]
    assert tables.read_partitioned(spark, "c", ["x", "z"], root).count() == 1


def test_scan_runs_and_path_columns(spark, tmp_path):
    for run, data in (("colab_a", "core"), ("colab_b", "jabberwocky"), ("other", "core_targets_jabberwocky_primes")):
        folder = tmp_path / run / "deep" / data
        folder.mkdir(parents=True)
        (folder / "items.csv").write_text("v\n1\n")
        (folder / "rest.csv").write_text("v\n9\n")
    df = tables.add_source_columns(tables.scan_runs(spark, str(tmp_path), "items.csv", "v int"))
    got = sorted((r.source_model_run, r.dataset, r.v) for r in df.collect())
    assert got == [
        ("colab_a", "core", 1), ("colab_b", "jabberwocky", 1), ("unknown_model", "core_targets_jabberwocky_primes", 1)
    ]
    only = tables.scan_runs(spark, str(tmp_path), "items.csv", "v int", contains=["colab_a/"])
    assert only.count() == 1


class FakeConf:
    def __init__(self, value):
        self.value = value

    def get(self, name, default=None):
        return self.value or default


class FakeSession:
    def __init__(self, value, master):
        self.conf = FakeConf(value)
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})()


def test_shared_dir_follows_the_session(spark):
    assert shared.shared_dir(FakeSession("/shared/x/", "yarn")) == "/shared/x"
    with pytest.raises(ValueError, match="shared by all executors"):
        shared.shared_dir(FakeSession(None, "yarn"))
    local = FakeSession(None, "local[2]")
    assert shared.shared_dir(local) == shared.shared_dir(local)
    assert shared.materialize(spark.range(3), "t").count() == 3


def test_bundle_outputs_write(spark, tmp_path):
    rows = [(f"u{i}", i, "m", "core", c, -1.0 - i % 3, -1.5) for i in range(6) for c in ("active_prime", "passive", "none")]
    df = spark.createDataFrame(
        rows, "item_id string, row_id int, model_name string, lexicality_condition string, prime_condition string, active_choice_logprob double, passive_choice_logprob double"
    ).withColumn("preference_total", F.col("active_choice_logprob") - F.col("passive_choice_logprob"))
    out = bundle.run_analysis(df, n_bootstrap=8)
    tables.write_outputs(out, str(tmp_path / "o"))
    tables.write_manifest(out, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o" / "pe_item_level")).count() == 6
    assert spark.read.json(str(tmp_path / "o" / "manifest")).count() == len(out)


def test_bundle_queries_return_values_at_full_draws(spark, monkeypatch):
    from pairlens.catalog import QUERIES
    from pairlens.operators import resample

    asked, drawn = [], resample._drawn_sums

    def noted(df, by, unit, value, n, seed, signs, *common):
        asked.append((signs, n))
        return drawn(df, by, unit, value, 64, seed, signs, *common)  # the counts asked for are what is tested

    monkeypatch.setattr(resample, "_drawn_sums", noted)
    run = QUERIES["st26_run_analysis_values"](spark, "/root/testdata/sf0.001").collect()
    assert set(asked) == {(False, 5_000), (True, 10_000)}
    asked.clear()
    choice = QUERIES["st26_choice_analysis"](spark, "/root/testdata/sf0.001").collect()
    assert set(asked) == {(False, 10_000), (True, 10_000)}
    assert {r.output for r in choice} == {"summary", "contrasts", "pairwise", "mcnemar"}
    assert any(r.metric == "perm_p_two_sided" for r in run) and any(r.metric == "perm_p_two_sided" for r in choice)
    low = {(r.output, r.key): r.value for r in run if r.metric == "bootstrap_ci95_low"}
    mean = {(r.output, r.key): r.value for r in run if r.metric == "mean" and r.output == "pe_summary"}
    assert low.keys() == mean.keys() and all(low[k] <= mean[k] for k in low)
    for row in (run[0], choice[0]):
        assert row.asDict().keys() == {"output", "key", "metric", "value"}


def test_line_numbers_of_files_in_several_splits(spark, tmp_path):
    wanted = {}
    for name, bad in (("a", {0, 700, 1999}), ("b", {3, 1500})):
        lines = ["" if i % 50 == 7 else "{broken" if i in bad else '{"x": %d}' % i for i in range(2000)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        wanted[name] = {i + 1 for i in bad}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = tables.malformed_lines(spark, str(tmp_path / "*.jsonl"), T.StructType([T.StructField("x", T.LongType())]))
        got = {}
        for r in rows.collect():
            got.setdefault(r.path.rsplit("/", 1)[1][0], set()).add(r.line_number)
        assert spark.read.text(str(tmp_path / "*.jsonl")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == wanted


def test_costly_bindings_are_spread_over_the_shuffle_partitions(spark, tmp_path):
    """Not over the cores only, of which a task's share would grow with the table."""
    from pairlens.plans.views import Tables

    spark.range(100).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        rows = Tables(spark, str(tmp_path))._parallel("events")
        assert rows.rdd.getNumPartitions() == 150 and rows.count() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        held = disk.getAllFiles()
        return {held.apply(i).getName() for i in range(held.size())}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key)
    table = shared.materialize(spark.range(1000).groupBy("id").count(), "t")
    for _ in range(50):
        left = [f for f in files() - before if f.startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.2)
    assert left == [] and spark.conf.get(key) == was and table.where("count = 1").count() == 1000
