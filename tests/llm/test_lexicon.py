import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from pairlens.llm import lexicon
from pairlens.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = [
    "it's we'll 'tis ''s !'s  's I'M they'RE don't", "a  b\n\n c \n d\t\te  ", "x y\u0085z w\x1c\x1dq", "<|endoftext|>hi<|endoftext|>",
    "<|endoftext|>", "ΑΣ İ ǅ ﬁ é é", "123 45a6 ²³ Ⅻ", "", " ", "\n", "'", "日本語 テキスト😀 👩‍👩‍👧", "x" * 3000, "!!" * 5000,
    "a'll'll've're", None, "same", "same", "ab" * 40_000,
]


def test_automaton_accepts_its_words_only_and_shares_suffixes(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"é".encode()}
    path = str(tmp_path / "lexicon")
    merges = lexicon.Merges(PATH)
    lexicon.write_lexicon(path, list(words), merges)
    built = lexicon.Lexicon(path)
    ask = sorted(words) + [b"", b"abcabcabc", b"d", b"ab" * 60]
    want = [sorted(words).index(w) if w in words else -1 for w in ask]
    assert built.places(ask).tolist() == want
    shared = lexicon.compile_words([a + b"ing" for a in (b"go", b"walk", b"x")])
    assert len(shared["accepts"]) == 4 + 2 + 3  # one chain for the common ending, the stems, the start


def test_merges_match_the_library():
    library, merges = Tokenizer.from_file(PATH), lexicon.Merges(PATH)
    rng = random.Random(2)
    for n in [1, 2, 5, 9, 30, 64, 65, 200, 2000]:
        word = "".join(rng.choice("etaoinshr") for _ in range(n))
        want = library.encode(word, add_special_tokens=False).ids
        assert merges.merge(word.encode()) == want
        assert merges._merge_long(word.encode()) == want


@pytest.mark.parametrize("size", [0, 5, 1000])
def test_round_trip_matches_the_library(docs_of, size):
    docs = docs_of(TEXTS)
    got = {r.doc_id: r for r in lexicon.encode(docs, PATH, lexicon.build_lexicon(docs, PATH, size)).collect()}
    library = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want
        assert got[i].n_tokens == len(want)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)


def test_null_ids_and_no_rows(docs_of):
    docs = docs_of(["a", "a"], [None, 1])
    assert lexicon.encode(docs, PATH, lexicon.build_lexicon(docs, PATH)).count() == 2
    none = docs.limit(0)
    assert lexicon.encode(none, PATH, lexicon.build_lexicon(none, PATH)).collect() == []
