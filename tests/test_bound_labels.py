"""Labels work out each step of a sentence once, and a rewritten stem rule keeps its results."""

import itertools

import pytest
from pyspark.sql import functions as F

from pairlens.functions import labels, text
from pairlens.functions.core import first_rule, let

_RULES = (
    (r"^(.{2,})(?:ies|ied)$", "$1y"),
    (r"^(.+)([^aeiou])\2ing$", "$1$2"),
    (r"^(.{3,})ing$", "$1"),
    (r"^(.+)([^aeiou])\2ed$", "$1$2"),
    (r"^(.{3,})ed$", "$1"),
    (r"^(?=.{5,}$)(.*(?:ch|sh|ss|x|z|o|g))es$", "$1"),
    (r"^(.{3,})es$", "$1e"),
    (r"^(.{3,})s$", "$1"),
)


def test_verb_key_is_the_list_of_rules(spark):
    heads = ["", "a", "go", "goo", "stop", "stopp", "kiss", "wat", "watch", "carr", "sing", "ed", "é", "😀b", "x\n", "bb", "eee", "ag", "ies"]
    tails = ["", "ing", "ed", "es", "s", "ies", "ied", "ing\n", "s ", "ss", "ges"]
    words = [a + b for a, b in itertools.product(heads, tails)] + [None]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    old = let(F.lower("w"), lambda t: first_rule(t, _RULES, t))
    differing = rows.select("w", text.verb_key("w").alias("new"), old.alias("old")).where("NOT (new <=> old)")
    assert differing.collect() == []


SENTENCES = [
    ("the guard visits a guest .", "a guest is visited by the guard ."),
    ("a by guard sees the guest .", "the guest was is seen by a by guard ."),
    ("x", "was by"), ("the cat hit .", "by"), ("", ""), (None, "a is b by c ."), ("a b c .", None),
]


@pytest.mark.parametrize("active, passive", SENTENCES)
def test_prepared_targets_stand_for_the_targets(spark, active, passive):
    shown = ["the guard quickly visited a guest", "a guest has been visited by that guard .", active, passive, None, ""]
    rows = spark.createDataFrame([(s, active, passive) for s in shown], "s string, a string, p string")
    rows = rows.withColumn("t", labels.prepared_targets("a", "p"))
    got = rows.select(labels.classify_structure("s", "a", "p").alias("x"), labels.classify_structure("s", prepared="t").alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got]
    if active and passive and active.startswith("the guard"):
        assert [r.x for r in got] == ["active_structural", "passive_structural", "active_exact", "passive_exact", "other", "other"]


def test_steps_are_not_repeated(spark):
    """Each regular expression of a classification is named a bounded number of times."""
    rows = spark.createDataFrame([("a", "b", "c")], "s string, a string, p string")
    plan = rows.select(labels.classify_structure("s", "a", "p"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 20_000
    labelled = labels.label_structure(rows, "s", "a", "p")._jdf.queryExecution().analyzed().toString()
    assert "__passive" not in labelled and "__copular" not in labelled
