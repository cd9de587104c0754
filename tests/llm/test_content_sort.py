import hashlib

import pytest

from pairlens.llm.content_sort import exact_dedup, exact_groups


def brute(rows):
    groups = {}
    for i, t in rows:
        norm = (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i))
    best = {n: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for n, v in groups.items()}
    out = []
    for i, t in rows:
        norm = (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        out.append((i, best[norm][2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = ["a b", "ab", "a  b", None, "", " \n", "ab ", "x" * 50_000, "x " * 50_000, "é è", "éè"] + ["hot text"] * 40 + ["hottext "] * 7


@pytest.mark.parametrize("least_hot", [256, 4])
def test_groups_match_brute_force(docs_of, least_hot):
    docs = docs_of(TEXTS)
    got = exact_groups(docs, least_hot).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(list(enumerate(TEXTS)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup(docs, least_hot)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_null_ids_repeated_rows_and_no_rows(docs_of):
    docs = docs_of(["a", "a", "a", "b", "b"], [None, 3, 3, None, None])
    assert sorted((r.doc_id, r.text) for r in exact_dedup(docs).where("doc_id is not null").collect()) == [(3, "a")]
    assert exact_dedup(docs).count() == 2
    assert exact_groups(docs.limit(0)).collect() == []
