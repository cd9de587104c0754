"""The corpus pipeline: five stages over the documents table.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
rows to the folder that all executors share and reads them back for the next one. All
stages but the last return the columns of ``documents``.

1. quality: documents that the discriminant rejects go.
2. exact: of equal texts the row that the content sort keeps stays.
3. near: of each component of near duplicates the smallest doc_id stays.
4. repeats: bytes that a repeated string of 200 bytes covers are cut from the texts, at all its
   places; a document whose text is cut to nothing stays, empty.
5. packing: the texts' ids in windows of 2,048, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import content_sort, minhash, packing, quality, repeats
from pairlens.llm.common import Scratch, documents, noted
from pairlens.llm.tokens import tokenizer_path

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None

#: Intermediate tables of the stages called so far, by application.
_PAST: dict[str, list[Scratch]] = {}


def _stage(spark: SparkSession, make) -> DataFrame:
    """Build a stage's result. Its input has been written by now, so the intermediate tables of
    the stages before it can go; its own are needed until its result has been written."""
    past = _PAST.setdefault(spark.sparkContext.applicationId, [])
    while past:
        past.pop().drop()
    with noted() as made:
        result = make()
    past.extend(made)
    return result


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _stage(spark, lambda: quality.accepted(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: content_sort.exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: minhash.one_of_each(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: repeats.remove_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return _stage(spark, lambda: packing.pack(docs, path, end_id=1, window=2048))


STAGES = [
    ("quality classifier", by_quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        written = Scratch(spark, f"stage-{k + 1}")
        docs = written.keep(result, "rows")
        if before:
            before.drop()
        before = written
    return docs
