import numpy as np
import pytest
from tokenizers import Tokenizer

from pairlens.llm import rans
from pairlens.llm.common import crc
from pairlens.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 31, 33, rans.BLOCK, 3 * rans.BLOCK + 5])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
    table = rans.Frequencies(np.bincount(ids, minlength=50_001))
    blocks = rans.encode_blocks(ids, table)
    assert (rans.decode_blocks(blocks, table) == ids).all()
    if n > 2 * rans.BLOCK:  # any block alone, in any order
        assert (rans.decode_blocks([blocks[-1], blocks[1]], table) == np.concatenate([ids[3 * rans.BLOCK :], ids[rans.BLOCK : 2 * rans.BLOCK]])).all()


def test_damage_is_seen():
    table = rans.Frequencies(np.bincount([1, 2, 2, 3]))
    body = rans.write_body([(7, np.array([1, 2], np.uint32)), (None, np.array([3], np.uint32))], table)
    assert rans.read_ids(body, table).tolist() == [1, 2, 3]
    for at in (6, len(body) - 1):
        bad = bytearray(body)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.read_ids(bytes(bad), table)


def test_documents_match_the_library(docs_of):
    texts = ["hello world", None, "", "x" * 40_000, "it's  a\n\ntest", "<|endoftext|> é", "hello world", "a b " * 9000]
    ids = [5, 3, 9, 1, 2, 8, 7, 0]
    files, table = rans.token_files(docs_of(texts, ids), PATH, 2, ids_in_file=1000)
    got = {r.doc_id: r for r in rans.read_files(files, table).collect()}
    library, start = Tokenizer.from_file(PATH), 0
    for doc_id, text in sorted(zip(ids, texts)):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), crc(want.tobytes()))
        start += len(want)


def test_null_and_repeated_ids_and_no_rows(docs_of):
    files, table = rans.token_files(docs_of(["a", "b b", "b b", "c"], [None, 4, 4, 1]), PATH, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in rans.read_files(files, table).collect())
    assert got == [(0, 1, 2), (2, 4, 3), (5, 4, 3), (8, None, 2)]
    files, table = rans.token_files(docs_of(["a"]).limit(0), PATH, 2)
    assert rans.read_files(files, table).collect() == []
