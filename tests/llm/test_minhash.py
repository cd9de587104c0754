import random
import re

import numpy as np
import pytest

from pairlens.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def corpus(seed, groups=12, copies=30):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(4000)]
    out = [None, "", " \n\t", "one two", "One  TWO", "a b c d e", "A B C D E", "a b c d e f", "É è", "é è", "x" * 50_000]
    out += ["common line " * 30] * 5
    passage = rng.choices(words, k=50)
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(20, 300))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own[5:5] = passage
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,small,block", [(1, 16, 2048), (2, 3, 8)])
def test_components_match_brute_force(docs_of, monkeypatch, seed, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(seed)
    want = brute(texts)
    got = minhash.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keys_meet_all_pairs_within_the_radius():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)] += 1
    assert (minhash.key_table(a) == minhash.key_table(b)).any(axis=1).all()
    assert len(minhash.SUBSETS) == 64


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = ["a b c d e f g", "", "A b C d e f g", "x", "  y z ", "a b c d e f g a b c d e"]
    together = list(minhash.shingle_sets([t.encode() for t in texts]))
    for text, own in zip(texts, together):
        assert own.tolist() == next(minhash.shingle_sets([text.encode()])).tolist()
        assert len(own) == len(shingles(text))
    assert together[0].tolist() == together[2].tolist()


def test_null_and_repeated_ids_and_no_rows(docs_of):
    got = minhash.near_duplicates(docs_of(["a b c d e", "a b c d e", "a b c d e"], [None, 4, 4])).collect()
    assert sorted((r.component_id or -1, r.kept) for r in got) == [(-1, True), (4, True), (4, True)]
    assert minhash.near_duplicates(docs_of(["a"]).limit(0)).collect() == []


def test_pairs_that_met_on_a_key_are_compared_beyond_the_radius():
    def side(node, coarse):
        return {"node": np.array([node]), "component": np.array([node]), "coarse": coarse, "fine": np.zeros((1, minhash.FINE), np.uint8)}

    near, far = np.zeros((1, minhash.SYMBOLS), "<u2"), np.zeros((1, minhash.SYMBOLS), "<u2")
    far[0, -minhash.RADIUS - 1 :] = 1
    for nearest in (False, True):
        assert [c.tolist() for c in minhash._compare(side(1, near), side(2, far), nearest)] == [[0], [0], [minhash.FINE]]


def test_words_that_collide_in_a_polynomial_are_not_linked(docs_of):
    a, b = "a", "b"
    while len(a) < 65_536:
        a, b = a + b, b + a
        if len(a) in (1024, 65_536):
            x, y = minhash.shingle_sets([f"one two three four {w}".encode() for w in (a, b)])
            assert len(x) == len(y) == 1 and x[0] != y[0]
    got = minhash.near_duplicates(docs_of([f"one two three four {w[:1024]}" for w in (a, b, a)])).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {0: (0, True), 1: (1, True), 2: (0, False)}
