import numpy as np
import pytest
from tokenizers import Tokenizer

from pairlens.llm import lexicon, tokens
from pairlens.llm.common import distinct, slice_hashes

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def doubled(n, letters="ab"):
    """Two words of n letters that any polynomial hash with an odd base modulo 2**64 takes for one, if n >= 1024."""
    s = letters[0]
    swap = str.maketrans(letters, letters[::-1])
    while len(s) < n:
        s += s.translate(swap)
    return s, s.translate(swap)


TEXTS = [f"x {a} {b}" for n in (1024, 2048, 4096, 65_536) for a, b in (doubled(n), doubled(n, "eé")[::-1])]
TEXTS += [f"{a} {a}" for a in doubled(1024)]


@pytest.mark.parametrize("name", NAMES)
def test_words_that_collide_in_a_polynomial(name):
    path = tokens.tokenizer_path(name)
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    for _ in range(2):  # the second time from the table
        ids, bounds = own.encode(list(TEXTS))
        for i, text in enumerate(TEXTS):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_lexicon_on_words_that_collide_in_a_polynomial(docs_of):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    texts = TEXTS + ["a\U0001f6d8b ͸x <|endoftext|>Ა᲋"]  # code points that are unassigned here
    docs, library = docs_of(texts), Tokenizer.from_file(path)
    got = {r.doc_id: r for r in lexicon.encode(docs, path, lexicon.build_lexicon(docs, path)).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", NAMES)
def test_every_code_point(name):
    """All code points of the planes that have characters, and a share of the empty ones."""
    path = tokens.tokenizer_path(name)
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    points = [c for c in [*range(0x34000), *range(0x34000, 0xE0000, 997), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}, x" for c in points[k : k + 20]) for k in range(0, len(points), 20)]
    ids, bounds = own.encode(list(texts))
    for i, want in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want.ids, texts[i]


def test_equal_first_hashes_are_told_apart():
    first, second = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    one, back, n = distinct(first, second)
    assert sorted(n.tolist()) == [1, 1, 2] and back[0] == back[3] != back[1]
    assert (second[one][back] == second).all()


def test_slices_hash_by_content():
    data = np.frombuffer(b"abc abd abc ab", np.uint8)
    h, second = slice_hashes(data, np.array([0, 4, 8, 12]), np.array([3, 7, 11, 14]))
    assert h[0] == h[2] and second[0] == second[2] and len(set(h.tolist())) == len(set(second.tolist())) == 3
    assert [len(x) for x in slice_hashes(data[:0], np.zeros(0, int), np.zeros(0, int))] == [0, 0]
