"""The operators applied to the ``documents`` table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_sort, lexicon, licenses, matroska, middles, minhash, packing, personal, quality, rans, repeats, runs, toxicity
from .common import documents
from .tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql.strip()
        return fn

    return wrap


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


@_query("op10_exact_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted content groups of all documents."""
    return content_sort.exact_groups(documents(spark, sf_dir))


@_query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded token files of all documents, read back."""
    files, table = rans.token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return rans.read_files(files, table).drop("ids")


@_query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their places in windows of 2048 ids."""
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack(documents(spark, sf_dir), path, end_id=1, window=2048, with_ids=False).drop("ids")


@_query("op6_bpe_lexicon")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the corpus's own lexicon, and decoded."""
    docs, path = documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")
    coded = lexicon.encode(docs, path, lexicon.build_lexicon(docs, path))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


@_query("op9_matroska")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Matroska values, read back packet by packet."""
    return matroska.describe(matroska.to_media(documents(spark, sf_dir)))


@_query("op1_minhash_components")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(documents(spark, sf_dir))


@_query("op4_suffix_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document is left without its repeated bytes."""
    return repeats.without_repeats(documents(spark, sf_dir)).drop("kept")


@_query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of all documents."""
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


@_query("op5_quality_qda")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query("op2_toxicity_ordinal")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance and expected severity of toxic language in all documents."""
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), k AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT doc_id, t, n, form, least(a, b) AS x, greatest(a, b) - least(a, b) AS y FROM k
), p AS (
  SELECT *, substring(t, 1, x) AS pre, substring(t, x + 1, y) AS mid, substring(t, x + y + 1, n) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@_query("op11_fill_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their fill-in-the-middle form, and restored from it."""
    back = middles.restored(middles.fill_middle(documents(spark, sf_dir)))
    digest = [F.sha2(F.encode(c, "utf-8"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


@_query("op12_word_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, one in ten of them made periodic towards its end."""
    found = runs.word_runs(runs.with_loops(documents(spark, sf_dir)))
    negative = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    longest = found.withColumn("one", F.array_max(negative))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("one.s")).alias("start"),
        F.col("one.n").alias("length"),
        (-F.col("one.q")).alias("period"),
        F.expr("(1000 * one.n) div (-one.q)").alias("exponent_milli"),
        F.sha2(F.encode(listed, "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


def _op13_sql() -> str:
    """The kinds as tables of matches: running sums of lengths give the places. The base patterns are the plain ones."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
    }
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    digit = f"substring(reverse({digits}), i::INT, 1)::INT"
    twice = f"(2 * {digit}) // 10 + (2 * {digit}) % 10"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN {digit} ELSE {twice} END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0"
    turned = "substring(replace(hit, ' ', ''), 5) || substring(hit, 1, 4)"
    value = f"instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring({turned}, i::INT, 1)) - 1"
    rest = (
        f"list_reduce(list_concat([0::BIGINT], [{value} FOR i IN range(1, length({turned}) + 1)]), "
        "lambda a, v: (a * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97) = 1"
    )

    def apart(inside: str) -> str:
        return f"NOT regexp_matches(before, '[{inside}]$') AND NOT regexp_matches(after, '^[{inside}]')"

    checks = {
        "email": "true",
        "ip": "list_bool_and([ltrim(x, '0') = '' OR (length(ltrim(x, '0')) <= 3 AND ltrim(x, '0')::INT <= 255) FOR x IN string_split(hit, '.')])",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{apart('A-Za-z0-9')} AND {rest}",
        "ssn": f"{apart('A-Za-z0-9-')} AND NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$')",
        "local_phone": apart("A-Za-z0-9.-"),
    }
    parts = []
    for rank, kind in enumerate(personal.KINDS):
        regex = plain.get(kind.name, kind.regex)
        near = "lower(right(before, 40) || ' ' || left(after, 40))"
        score = f"{kind.score} + CASE WHEN regexp_matches({near}, '(^|[^a-z])({kind.words})') THEN {personal.RAISE} ELSE 0 END"
        parts.append(
            f"""
  SELECT rid, stop - length(hit) AS start, {rank} AS rank, stop, '{kind.name}' AS kind FROM (
    SELECT rid, hit, before, after, sum(length(before) + length(hit)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS stop FROM (
      SELECT rid, i, h[i] AS hit, p[i] AS before, p[i + 1] AS after FROM (
        SELECT rid, h, string_split_regex(t, '{regex}') AS p, unnest(range(1, length(h) + 1)) AS i
        FROM (SELECT rid, t, regexp_extract_all(t, '{regex}') AS h FROM d))))
  WHERE {checks[kind.name]} AND ({kind.base} OR {score} >= {personal.ENOUGH})"""
        )
    counts = ",\n  ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in personal.BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in personal.BASE)
    one = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}
), g AS (
  SELECT rid, {sums}, string_agg({one}, ',' ORDER BY start, rank) AS spans,
    string_agg({one}, ',' ORDER BY start, rank) FILTER (rank < {len(personal.BASE)}) AS base
  FROM s GROUP BY rid
)
SELECT doc_id, {counts},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


@_query("op13_personal_data", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = personal.spans(documents(spark, sf_dir))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = personal.listed(F.filter("spans", lambda s: s["rank"] < len(personal.BASE)))
    return found.select(
        "doc_id", *map(n, personal.BASE), F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans")
    )
