import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pairlens.llm import packing
from pairlens.llm.common import crc
from pairlens.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def one_by_one(lengths, window):
    """Plain best-fit decreasing: how many windows are filled to each level.

    Equally tight windows may be taken in any order, which changes their contents only.
    """
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda j: rooms[j])
        else:
            i = len(rooms)
            rooms.append(window)
        rooms[i] -= n
    return Counter(window - r for r in rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 20, 64])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 300))] + [rng.randint(1, 4)] * rng.randint(0, 90)
    got, placed = Counter(), Counter()
    for n, rows in packing.best_fit_decreasing(Counter(lengths), window):
        got[sum(length * k for length, k in rows)] += n
        placed += Counter({length: n * k for length, k in rows})
    assert got == one_by_one(lengths, window)
    assert placed == Counter(lengths)


def test_pieces_fill_windows(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma it's 42 !!".split()) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "same text"] + ["same text"] * 40 + ["long " * 3000, "z" * 5000]
    got = packing.pack(docs_of(texts), PATH, 1, window=128).collect()
    library = Tokenizer.from_file(PATH)
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(by_doc[i], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == want.tolist()
        at = 0
        for r in mine:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), crc(want[at : at + r.length].tobytes()))
            at += r.length
    for rows in by_window.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            assert r.length <= 128
        assert at <= 128 and all(r.sequence_tokens == at and r.padded_tokens in (at, 128) for r in rows)
    want = one_by_one([r.length for r in got], 128)
    assert Counter(sum(r.length for r in rows) for rows in by_window.values()) == want


def test_null_and_repeated_ids_and_no_rows(docs_of):
    got = packing.pack(docs_of(["a", "a", "b"], [None, 2, 2]), PATH, 1).collect()
    assert sorted(r.offset for r in got) == [0, 2, 4] and len({r.sequence_id for r in got}) == 1
    assert packing.pack(docs_of(["a"]).limit(0), PATH, 1).collect() == []
