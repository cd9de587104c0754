import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import repeats


def brute(texts):
    data = [(t or "").encode() for t in texts]
    windows = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = {}
    for k, d in enumerate(data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if windows[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((np.diff(gone[: len(d)].astype(int), prepend=0) == 1).sum()) if len(d) else 0
        out[k] = (len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    passage, base, line = text(330), text(1500), text(120)
    out = [None, "", "short", "x" * 199, "x" * 200, "x" * 2000, "y" * 201, "z" * 200 + "z", "ab" * 400, "ab" * 150 + "c", "é" * 150]
    for _ in range(25):
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(len(own))] = rng.choice("XYZ ")
        out.append("".join(own))
    for _ in range(15):
        out.append(text(rng.randint(0, 300), "ab ") + passage[rng.randint(0, 90) : 330 - rng.randint(0, 90)] + text(rng.randint(0, 300), "ab "))
    out += [text(80) + line + text(80) + line for _ in range(10)]
    out += ["tail " + "pq rs " * rng.randint(30, 60) + text(40, "ab") for _ in range(12)]
    out += [base, base, text(3000) * 2]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,ranges", [(1, "8"), (2, "1"), (3, "60")])
def test_removed_bytes_match_brute_force(docs_of, spark, seed, ranges):
    """Also with so many ranges that most keys lie at an edge."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        check_removed(docs_of, seed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check_removed(docs_of, seed):
    texts = corpus(seed)
    got = repeats.without_repeats(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(texts)


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc") for _ in range(5321))
    found = repeats.anchors([b"", text, text[:700]])
    covered = np.zeros(len(text), int)
    for k, at in zip(found["text"], found["at"]):
        _, first, end = repeats._span(np.array([at]))
        if k == 1:
            covered[first[0] : end[0] - 199] += 1
    assert (covered[: len(text) - 199] == 1).all()  # each window has one anchor


def test_intervals_of_a_suffix_array():
    word = "mississippi"
    order = sorted(range(len(word)), key=lambda i: word[i:])
    lcp = [0] + [next((k for k in range(12) if word[a : a + k + 1] != word[b : b + k + 1] or len(word) - max(a, b) == k), 12) for a, b in zip(order, order[1:])]
    found = {(word[order[a] : order[a] + n], b - a + 1) for a, b, n in repeats.intervals(lcp, 1)}
    assert found == {("i", 4), ("issi", 2), ("p", 2), ("s", 4), ("si", 2), ("ssi", 2)}


def test_maximal_groups_list_all_occurrences(docs_of):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh") for _ in range(210))
    texts = [f"{i}{passage}{i + 4}" for i in range(3)] + ["9" + passage[:205] + "!"]
    got = {}
    for r in repeats.maximal_repeats(docs_of(texts)).collect():
        got.setdefault(r.repeat, set()).add((r.doc_id, r.first, r.end))
    strings = {frozenset(texts[d][a:b] for d, a, b in v): {d for d, _, _ in v} for v in got.values()}
    assert all(len(s) == 1 for s in strings)
    assert {0, 1, 2} in strings.values() and {0, 1, 2, 3} in strings.values()


def brute_groups(texts):
    """Strings of 200 bytes or more with two places or more that can be extended on neither side with all their places."""
    out = {}
    data = [t.encode() for t in texts]
    for n in range(200, max(map(len, data)) + 1):
        places = {}
        for d, t in enumerate(data):
            for i in range(len(t) - n + 1):
                places.setdefault(t[i : i + n], []).append((d, i))
        for string, at in places.items():
            around = [[data[d][i - 1 : i] if i else None for d, i in at], [data[d][i + n : i + n + 1] or None for d, i in at]]
            if len(at) > 1 and all(None in side or len(set(side)) > 1 for side in around):
                out[string] = {(d, i, i + n) for d, i in at}
    return out


def test_maximal_groups_match_brute_force(docs_of):
    """Groups of strings that lie within one context are those of the definition; longer ones come in pieces."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, extra = text(230), text(60)
    # copies of one context, others that share a part of it, on either side or both
    texts = [f"1{passage}2"] * 4 + [passage[:215] + "!" + extra, "?" + passage[12:] + extra, extra + passage[:215] + "?"]
    texts += [f"{i}{passage[5:]}{extra}" for i in range(3)] + [f"{i}{passage[:222]}{i}" for i in range(3)]
    got = {}
    for r in repeats.maximal_repeats(docs_of(texts)).collect():
        got.setdefault(texts[r.doc_id].encode()[r.first : r.end], set()).add((r.doc_id, r.first, r.end))
    want = brute_groups(texts)
    for string, places in got.items():
        assert len(string) >= 200 and len(places) > 1
        if string in want:
            assert places == want[string]
    whole = [s for s in want if s in got]
    assert len(whole) >= 4
    for string, places in want.items():  # whatever repeats is covered by reported pieces
        for d, a, b in places:
            covered = np.zeros(b - a, bool)
            for own in got.values():
                for e, x, y in own:
                    if e == d and x < b and y > a:
                        covered[max(x - a, 0) : y - a] = True
            assert covered.all(), string


@pytest.mark.parametrize("seed", range(4))
def test_maximal_groups_of_one_key(seed):
    rng = random.Random(seed)
    for _ in range(200):
        rows = sorted({tuple("".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 7, 7, 7]))).encode() for _ in "lr") for _ in range(rng.randint(2, 12))}, key=lambda r: r[1])
        left, right = [r[0] for r in rows], [r[1] for r in rows]
        if len(rows) < 2:
            continue
        linked = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and repeats._agree(left[i], left[j]) + repeats._agree(right[i], right[j]) >= 7}
        got = set()
        for members, before, after in repeats.maximal_groups(left, right):
            own = [(left[m], right[m]) for m in members]
            assert len({(a[:before], b[:after]) for a, b in own}) == 1 and before + after >= 7
            assert len({a[before : before + 1] for a, _ in own}) > 1 or before in {len(a) for a, _ in own}
            assert len({b[after : after + 1] for _, b in own}) > 1 or after in {len(b) for _, b in own}
            same = [m for m in range(len(rows)) if left[m][:before] == left[members[0]][:before] and right[m][:after] == right[members[0]][:after]]
            assert len(left[members[0]][:before]) == before and same == members  # all occurrences
            got |= {(i, j) for i in members for j in members if i != j}
        assert got == linked


def test_a_passage_of_many_contexts(docs_of):
    """One key of thousands of leaves: 195 bytes with other neighbours, and some that share 200."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(195))
    texts = [f"{rng.random()}"[2:14] + passage + f"{rng.random()}"[2:14] for _ in range(3000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs_of(texts)).collect()}
    assert got == brute(texts) and 0 < sum(g[1] > 0 for g in got.values()) < 3000


def test_structured_words_and_repeated_ids(docs_of):
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    texts = [a, "x" + b[:300], a[7:500] + "?", "unique", a[:250]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs_of(texts)).collect()}
    assert got == brute(texts)
    rng = random.Random(9)
    one, two, three = ("".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(3))
    rows = repeats.without_repeats(docs_of([one, two, one[:250] + three], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(1, 400, 0), (1, 400, 250), (2, 650, 250)]
    rows = repeats.remove_repeats(docs_of([one, two, one[:250] + three], [1, 1, 2])).collect()
    assert sorted((r.doc_id, len(r.text)) for r in rows) == [(1, 150), (1, 400), (2, 400)]


def test_null_ids_and_no_rows(docs_of):
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(docs_of(["q" * 150 + "r" * 150] * 3, [None, 1, 2])).collect()}
    assert got == {None: 0, 1: 300, 2: 300}
    assert repeats.without_repeats(docs_of(["a"]).limit(0)).collect() == []


def test_members_that_meet_in_a_range_are_not_joined(spark):
    """A key that fills a range's edge leaves one open row for each string, not one for each member."""
    rest, left = b"abcdefg", b"tuvwxyz"
    rows = [(7, 7, bytearray(rest), bytearray(left), 0, i, i) for i in range(50)] + [(7, 7, bytearray(b"abcdefX"), bytearray(left), 0, 99, 99)]
    found = repeats._scan(spark.createDataFrame(rows, repeats._KEYED).coalesce(1)).collect()
    alone = [r for r in found if r.level is not None and r.c1 is not None]
    closed = {(r.c1, r.first, r.end) for r in found if r.level is None}
    assert len(alone) <= 8 * 8 and len(closed) > 8 * 20


def test_a_task_holds_a_bounded_part_of_a_batch(monkeypatch):
    n = 400
    texts = ["word %d " % i * 5000 for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["doc_id", "mark", "text"])

    class Rows:
        def where(self, _):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    met = []
    monkeypatch.setattr(repeats, "_rows", lambda docs: Rows())
    found = repeats.anchors
    monkeypatch.setattr(repeats, "anchors", lambda some: met.append(sum(map(len, some))) or found(some[:1]))
    assert sum(b.num_rows > 0 for b in repeats._anchor_table(None)(iter([batch]))) == len(met)
    assert sum(met) == sum(map(len, texts)) and max(met) <= repeats.HELD
