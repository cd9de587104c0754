import random
import re
import zlib

import numpy as np
import pytest

from pairlens.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """All maximal stretches of every period that no smaller period has."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least, 2 * q):
                if not any(all(words[k] == words[k - d] for k in range(start + d, start + length)) for d in range(1, q)):
                    out.append((start, length, q))
            i = max(j, i) + 1
    return sorted(out)


def sequences():
    rng = random.Random(1)
    for _ in range(600):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
        words = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6 and n:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        yield words
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(least):
    for words in sequences():
        assert runs.runs_of(words, least) == brute(words, least)


def test_stretches_lose_no_run():
    some = [[str(w).encode() for w in words] for words in sequences()]
    assert runs._found(some, 12) == [brute(words) for words in some]
    assert runs._found(some, 7) == [brute(words, 7) for words in some]
    assert any(runs._found(some, 12))


def test_last_ends_are_those_of_the_text():
    """Each recoloured segment names the nearest earlier end of its longest string."""
    rng = random.Random(3)
    words = [rng.randrange(3) for _ in range(200)]
    tree = runs.LastEnds()
    for i, w in enumerate(words):
        own = words[: i + 1]
        for longest, before in tree.append(w):
            string = own[i + 1 - longest :]
            assert own[before + 1 - longest : before + 1] == string
            assert not any(own[e + 1 - longest : e + 1] == string for e in range(before + 1, i))


def test_long_texts_take_time_in_proportion():
    n = 30_000
    assert runs.runs_of([0] * n) == [(0, n, 1)]
    assert runs.runs_of([i % 1000 for i in range(n)]) == [(0, n, 1000)]


def looped(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_tables_match_brute_force(docs_of):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bé", "c d", "", "\t", "line\n"]) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += [None, "", "x" * 50_000, "la " * 3000, " \n\t", "one two three four " * 4, "W" * 1024 + " x"]
    ids = [None if i == 3 else i % 390 for i in range(len(texts))]
    got = runs.word_runs(runs.with_loops(docs_of(texts, ids))).collect()
    want = []
    for i, t in zip(ids, texts):
        words = looped(i, t)
        found = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = np.zeros(len(words), bool)
        for s, n, q in found:
            gone[s + q : s + n] = True
        want.append((-1 if i is None else i, found, " ".join(w for w, g in zip(words, gone) if not g)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert sum(len(w[1]) for w in want) > 20
    assert runs.word_runs(runs.with_loops(docs_of(["a"]).limit(0))).collect() == []
