import re

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from pairlens.llm import quality
from pairlens.llm.tokens import tokenizer_path

from . import test_content_sort, test_minhash, test_repeats

SF = "/root/testdata/sf0.001"


def test_each_stage_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        after.append(docs.collect())

    given = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdicts = quality.scored(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in after[0]} == {r.doc_id for r in verdicts if r.predicted}
    assert all(tuple(r) == tuple(given[r.doc_id]) for rows in after[:3] for r in rows)

    rows = sorted((r.doc_id, r.text) for r in after[0])
    assert {r.doc_id for r in after[1]} == {keep for _, keep, _, _ in test_content_sort.brute(rows)}

    rows = sorted((r.doc_id, r.text) for r in after[1])
    component = test_minhash.brute([t for _, t in rows])
    assert {r.doc_id for r in after[2]} == {rows[top][0] for _, top in component.values()}

    rows = sorted((r.doc_id, r.text) for r in after[2])
    want = test_repeats.brute([t for _, t in rows])
    cut = {r.doc_id: r for r in after[3]}
    assert set(cut) == {i for i, _ in rows}
    for k, (i, text) in enumerate(rows):
        n, removed, _, _ = want[k]
        assert n - removed - 6 * (removed > 0) * want[k][2] <= len(cut[i].text.encode()) <= n - removed
        assert cut[i].n_chars == len(cut[i].text)
        if not removed:
            assert cut[i].text == text

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = {}
    for r in after[4]:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, r in cut.items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(pieces[i], key=lambda p: p.start)])
        assert ids.tolist() == [*library.encode(r.text, add_special_tokens=False).ids, 1]
    assert len(pieces) == len(cut)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_the_guard_stands_in_one_place_only():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", source)
