import hashlib
import random

import pytest

from pairlens.llm import middles


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def corpus():
    rng = random.Random(1)
    letters = "aé€😀 <>PSM\n"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return out + [None, "", "x", "<P>", "a<S>b", "<", ">", "P>", "<P", "é" * 70_000, "<<PP>>" * 500]


@pytest.mark.parametrize("batch,block", [(1 << 23, 1 << 20), (64, 7)])
def test_forms_match_brute_force_and_come_back(docs_of, monkeypatch, batch, block):
    monkeypatch.setattr(middles, "BATCH", batch)
    monkeypatch.setattr(middles, "BLOCK", block)
    texts = corpus()
    texts = texts if block > 7 else texts[:-2]
    ids = [None if i == 5 else i % 250 for i in range(len(texts))]
    made = middles.fill_middle(docs_of(texts, ids))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    want = sorted((-1 if i is None else i, *brute(i, t)) for i, t in zip(ids, texts))
    assert got == want
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = middles.restored(made).collect()
    assert sorted((r.doc_id or 0, r.restored) for r in back) == sorted((i or 0, t or "") for i, t in zip(ids, texts))


def test_marks_that_cannot_be_told_apart(docs_of):
    for marks in (("<P>", "<P>x", "<S>"), ("aba", "c", "d"), ("ab", "bc", "d"), ("", "a", "b")):
        with pytest.raises(ValueError):
            middles.fill_middle(docs_of(["a"]), marks=marks)
    rows = middles.restored(middles.fill_middle(docs_of(["hello world"] * 50, list(range(50))), marks=("[pre]", "[mid]", "[suf]")), ("[pre]", "[mid]", "[suf]"))
    assert {r.restored for r in rows.collect()} == {"hello world"}


def test_no_rows_and_broken_outputs(docs_of, spark):
    made = middles.fill_middle(docs_of(["a"]).limit(0))
    assert made.collect() == [] and middles.restored(made).collect() == []
    rows = spark.createDataFrame([(None, None), ("a", "plain"), ("a<M>", None)], "output string, form string")
    assert [r.restored for r in middles.restored(rows).collect()] == ["", "a", "a<M>"]
    with pytest.raises(Exception, match="each mark once"):
        middles.restored(spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")).collect()
