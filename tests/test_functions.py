import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import arrays, clean, labels, pvalues, text


def column(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(expr).collect()]


DETAILED = [
    # sentence, active target, passive target, label
    ("", "", "", "other_empty"),
    ("... !", "", "", "other_empty"),
    ("the cook was not really chased by us", "a b c d e .", "x", "passive_by"),
    ("the cook is being chased", "a b c d e .", "x", "passive_progressive_short"),
    ("the cook was being happy", "a b c d e .", "x", "copular_adjectival"),
    ("the cook got hit", "a b c d e .", "x", "passive_short"),
    ("she is married to him", "a b c d e .", "x", "copular_participial"),
    ("she is married by him", "a b c d e .", "x", "passive_by"),
    ("it was the cook", "a b c d e .", "x", "copular_nominal"),
    ("it was near here", "a b c d e .", "x", "copular_prepositional"),
    ("it was never", "a b c d e .", "x", "copular_incomplete"),
    ("it was never beautiful", "a b c d e .", "x", "copular_adjectival"),
    ("the cook is chasing the cat", "a b c d e .", "x", "active_progressive_transitive"),
    ("the cook is giving the cat to him", "a b c d e .", "x", "active_progressive_ditransitive"),
    ("the cook is running near us", "a b c d e .", "x", "active_progressive_intransitive_pp"),
    ("the cook is running", "a b c d e .", "x", "active_progressive_intransitive"),
    ("the cook chases", "a b c d e .", "x", "active_intransitive"),
    ("the cook looks at it", "a b c d e .", "x", "active_intransitive_prepositional"),
    ("the cook wants to sleep", "a b c d e .", "x", "active_intransitive_prepositional"),
    ("the cook gives the book to her", "a b c d e .", "x", "active_ditransitive_prepositional"),
    ("the cook sees the cat near me", "a b c d e .", "x", "active_transitive_with_pp"),
    ("he sees her", "a b c d e .", "x", "active_transitive"),
    ("he sees cats", "a b c d e .", "x", "active_other"),
    ("the man in the hat who is tall laughs", "a b c d e .", "x", "other_relative_identity_clause"),
    ("the one who did it was a cook", "a b c d e .", "x", "other_relative_identity_clause"),
    ("the cook came, and he left", "a b c d e .", "x", "other_coordinate_multiclause"),
    ("nobody who knows", "a b c d e .", "x", "other_relative_clause_misc"),
    ("nothing of note", "a b c d e .", "x", "other_prepositional_misc"),
    ("nothing", "a b c d e .", "x", "other_unclassified"),
    ("the cook quickly chased the cat", "the cook chases the cat .",
     "the cat is chased by the cook .", "active_target_transitive_like"),
    ("the cat was often chased by the cook", "the cook chases the cat .",
     "the cat is chased by the cook .", "passive_target_by"),
    ("the cook chases the cat for fun", "the cook chases the cat .",
     "the cat is chased by the cook .", "active_target_ditransitive_like"),
]


def test_detailed_labels(spark):
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(DETAILED)],
        "i int, s string, target_active string, target_passive string, want string",
    )
    out = labels.label_structure(df, "s").orderBy("i").collect()
    wrong = [(r.s, r.want, r.generation_class_detailed) for r in out if r.want != r.generation_class_detailed]
    assert not wrong, wrong


ARGUMENTS = [
    ("the cook picked up the book", "active_monotransitive_theme", "phrasal_verb_with_theme_object", False),
    ("the cook chased the cat", "active_monotransitive_patient", "object_inferred_as_patient_human", True),
    ("the cook chased the dog", "active_monotransitive_patient", "object_inferred_as_patient_default", True),
    ("the cook chased something", "active_monotransitive_theme", "object_inferred_as_theme", False),
    ("the cook gave the cat to the dog", "active_ditransitive_prepositional", "direct_object_plus_to_for_recipient", False),
    ("the cook slept", "active_nonobject", "no_direct_object_detected", False),
    ("cooks slept", "unknown", "noncanonical_subject_start", False),
    ("", "unknown", "empty_sentence", False),
]


def test_argument_labels(spark):
    df = spark.createDataFrame(
        [(i, s, "the cook chases the cat .") for i, (s, *_) in enumerate(ARGUMENTS)],
        "i int, s string, target_active string",
    )
    out = labels.label_arguments(df, "s").orderBy("i").collect()
    got = [(r.argument_structure_inferred, r.argument_inference_note, r.inferred_strict_active) for r in out]
    assert got == [tuple(a[1:]) for a in ARGUMENTS]
    compat = labels.label_arguments(df, "s", compat=True).orderBy("i").collect()
    assert compat[3].argument_structure_inferred == "active_monotransitive_patient"


def align_brute(pieces, words):
    """The alignment rule, piece by piece."""
    out, cur, part, at = [], 0, "", -1
    for p in pieces:
        if p == "":
            out.append(-1)
            continue
        if p in ".?!":
            start = at if at >= 0 else cur
            hit = next((i for i in range(start, len(words)) if words[i] == p), -1)
            out.append(hit)
            cur, part, at = (hit + 1 if hit >= 0 else cur), "", -1
            continue
        if at >= 0 and words[at].startswith(part + p):
            out.append(at)
            part += p
            if part == words[at]:
                cur, part, at = at + 1, "", -1
            continue
        hit = next((i for i in range(cur, len(words)) if words[i].startswith(p) or p.startswith(words[i])), -1)
        out.append(hit)
        if hit >= 0 and p.startswith(words[hit]):
            cur, part, at = hit + 1, "", -1
        elif hit >= 0:
            part, at = p, hit
    return out


def test_align_tokens(spark):
    rng = np.random.default_rng(3)
    words = "the baker asks a singer .".split()
    rows = []
    for _ in range(60):
        pieces = []
        for w in words:
            if rng.random() < 0.15:
                continue
            cut = int(rng.integers(1, len(w) + 1))
            pieces += [w[:cut], w[cut:]] if rng.random() < 0.6 else [w]
            if rng.random() < 0.1:
                pieces.append("zz")
        rows.append((pieces, words))
    rows.append((["ba", "kers", ".", "x", ""], words))
    df = spark.createDataFrame(rows, "p array<string>, w array<string>").coalesce(1)
    got = [r[0] for r in df.select(arrays.align_tokens("p", "w")).collect()]
    assert got == [align_brute(p, w) for p, w in rows]


def test_verb_forms(spark):
    got = column(spark, ["carried", "stopping", "watches", "goes", "seeing", "kisses", "a"], text.verb_key("x"))
    assert got == ["carry", "stop", "watch", "goe", "see", "kiss", "a"]
    assert column(spark, ["", "tie", "see", "stop", "fix"], text.to_ing("x", "nominal")) == [
        "doing", "tying", "seeing", "stopping", "fixing"]
    assert column(spark, ["s", "drag", "make"], text.to_ing("x", "label")) == ["", "dragging", "making"]
    assert column(spark, ["Yes", None, " 1 ", "no"], clean.as_bool("x")) == [True, False, True, False]


def test_clause_takes_first_separator_of_the_list(spark):
    assert column(spark, ["why? because. ok", "a; b! c", "", "plain"], text.first_clause("x")) == [
        "why? because", "a; b", "", "plain"]
    assert column(spark, ['He said "hi. bye', "no stop"], text.first_sentence("x")) == ["He said hi .", "no stop"]


def test_choice_tie_is_active(spark):
    df = spark.createDataFrame([(-1.0, -1.0), (-2.0, -1.0), (-1.0, -2.0)], "a double, p double")
    assert [r[0] for r in df.select(clean.choose_structure("a", "p")).collect()] == ["active", "passive", "active"]


def test_tail_probabilities_match_printed_tables(spark):
    df = spark.createDataFrame([(2.228, 10), (12.706, 1), (1.96, 100000), (0.0, 5), (None, 5)], "t double, n int")
    p = [r[0] for r in df.coalesce(1).select(pvalues.t_two_sided("t", "n")).collect()]
    assert p[:3] == pytest.approx([0.05, 0.05, 0.05], abs=2e-4)
    assert p[3] == pytest.approx(1.0) and p[4] is None
    assert pvalues.beta_cdf(0.5, 2, 2) == pytest.approx(0.5)
    low, high = pvalues.beta_quantile(0.025, 5, 6), pvalues.beta_quantile(0.975, 6, 5)
    assert (low, high) == (pytest.approx(0.1871, abs=1e-4), pytest.approx(0.8129, abs=1e-4))
    k = spark.createDataFrame([(2, 10), (10, 10), (0, 0)], "k int, n int").coalesce(1)
    got = [r[0] for r in k.select(pvalues.binomial_at_most("k", "n")).collect()]
    assert got == pytest.approx([56 / 1024, 1.0, 1.0])
    z = spark.createDataFrame([(1.959964,)], "z double").select(pvalues.normal_two_sided("z")).first()[0]
    assert z == pytest.approx(0.05, abs=1e-6)
    assert math.isclose(float(pvalues.beta_cdf(0.3, 1, 1)), 0.3)


def test_missing_marker_is_an_error(spark):
    df = spark.createDataFrame([("nothing here",)], "x string").select(text.between_markers("x")["answer"])
    with pytest.raises(Exception, match="no marked answer"):
        df.collect()


def test_different_token_ids_are_an_error(spark):
    df = spark.createDataFrame([([1.0], [2.0], [1], [2])], "a array<double>, b array<double>, i array<int>, j array<int>")
    with pytest.raises(Exception, match="different tokens"):
        df.select(arrays.token_pe("a", "b", "i", "j")).collect()
    assert df.select(F.size(arrays.token_pe("a", "b", "i", "i"))).first()[0] == 1


def test_alignment_of_long_texts(spark):
    """Long texts take time in proportion, and blocks and look-ahead change nothing."""
    words = ["".join(chr(97 + (i * 7 + j * i) % 26) for j in range(6)) for i in range(3000)]
    pieces = [p for w in words for p in (w[:2], w[2:])]
    short = ["the", "cat", "sat", ".", "the", "dog", "."]
    texts = [(words, pieces), (short, ["the", "c", "at", "zzz", ".", "dog", "", "."]), (short, []), (["a"] * 40 + ["far"], ["far", "a"])]
    df = spark.createDataFrame([(i, w, p, " ".join(w)) for i, (w, p) in enumerate(texts)], "i int, w array<string>, p array<string>, t string")
    got = {r.i: r for r in df.select("i", arrays.align_tokens("p", "w").alias("a"), arrays.word_spans("t").alias("s")).collect()}
    assert got[0].a == [i for i in range(3000) for _ in (0, 1)]
    assert got[1].a == [0, 1, 1, -1, 3, 5, -1, 6] and got[2].a == [] and got[3].a == [40, -1]
    for i, (w, _) in enumerate(texts):
        starts = [sum(map(len, w[:k])) + k for k in range(min(len(w), 50))]
        assert [s.start for s in got[i].s][:50] == starts and all(s.end - s.start == len(x) for s, x in zip(got[i].s, w))
    offsets = df.select(arrays.align_by_offset(arrays.word_spans("t"), arrays.word_spans("t")).alias("a"))
    assert [len(r.a) for r in offsets.collect()] == [3000, 7, 7, 41] and offsets.first().a == list(range(3000))
    outside = df.limit(1).select(arrays.align_by_offset(F.expr("array(struct(10000000 AS start, 10000001 AS end))"), arrays.word_spans("t")))
    with pytest.raises(Exception, match="outside every word"):
        outside.collect()
