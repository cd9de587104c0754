"""Scans and sinks. The files read here are written from the given tables first, in the
shared folder, so their size follows the tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..plans import bundle
from ..sources import scores, tables
from ..sources.shared import scratch_path
from .registry import query


def _write_csv(df, label, sep=","):
    path = scratch_path(df.sparkSession, label)
    (
        df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return path


@query("io01_read_csv", "SELECT doc_id, lang, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(t):
    path = _write_csv(t.documents.select("doc_id", "lang", "text"), "csv")
    schema = "doc_id bigint, lang string, text string"
    rows = tables.read_table(t.spark, path, schema, multi_line=True)
    return rows.select("doc_id", "lang", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("io02_read_semicolon", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS f_rank FROM part")
def _(t):
    odd = t.part.select(
        F.col("p_partkey").alias("P_PartKey "), F.col("p_name").alias(" P_Name"), F.col("p_size").alias("F_rank")
    )
    return tables.read_table(t.spark, _write_csv(odd, "semicolon", ";"), sep=";", tidy_header=True)


@query("io03_read_jsonl", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def _(t):
    path = scratch_path(t.spark, "jsonl")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    blank = F.when(F.col("turn") == 0, F.concat(line, F.lit("\n   "))).otherwise(line)
    t.conversations.select(blank.alias("value")).write.text(path)
    schema = T.StructType.fromDDL("conv_id bigint, turn bigint, role string, text string")
    rows = tables.read_jsonl(t.spark, path, schema)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("io04_read_lexicon", "SELECT row_number() OVER (ORDER BY word) - 1 AS position, word FROM (SELECT DISTINCT lower(trim(p_type)) AS word FROM part) w")
def _(t):
    path = scratch_path(t.spark, "lexicon")
    words = t.part.select(F.concat(F.upper(F.trim("p_type")), F.lit(" ")).alias("w")).distinct()
    words.agg(F.array_sort(F.collect_list("w")).alias("nouns")).coalesce(1).write.json(path)
    return tables.read_lexicon(t.spark, path, minimum=2)


@query(
    "io05_scan_runs",
    """SELECT concat('lang=', lang) AS run, source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1, 2""",
)
def _(t):
    root = scratch_path(t.spark, "runs")
    rows = t.documents.select("doc_id", F.col("source").alias("src"), "lang", "source")
    # Runs whose files have their columns in different orders, one with a column more.
    rows.where("lang <> 'fr'").write.option("header", True).partitionBy("lang", "source").csv(root)
    other = rows.where("lang = 'fr'").select("src", F.lit("x").alias("more"), "doc_id", "lang", "source")
    other.write.mode("append").option("header", True).partitionBy("lang", "source").csv(root)
    found = tables.scan_runs(
        t.spark, root, "part-*.csv", "doc_id bigint, src string", contains=["/lang=en/", "/lang=fr/"]
    )
    run = tables.model_run(F.col("source_path"), "lang=")
    return found.groupBy(run.alias("run"), F.col("src").alias("source")).agg(
        F.count("*").alias("n"), F.sum("doc_id").alias("ids")
    )


_PATHS = """(SELECT doc_id, lang, concat('/data/colab_', lang, '/', CASE doc_id % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'lexically_controlled' WHEN 2 THEN 'experiment-2/core' ELSE 'misc' END, '/', CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'x_jabberwocky_y' ELSE 'core_targets_jabberwocky_primes' END, '/', doc_id, '.csv') AS path FROM documents) d"""


def _paths(t):
    a = F.expr("CASE doc_id % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'lexically_controlled' WHEN 2 THEN 'experiment-2/core' ELSE 'misc' END")
    b = F.expr("CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'x_jabberwocky_y' ELSE 'core_targets_jabberwocky_primes' END")
    path = F.concat(
        F.lit("/data/colab_"), F.col("lang"), F.lit("/"), a, F.lit("/"), b, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".csv")
    )
    return t.documents.select("doc_id", "lang", path.alias("path"))


@query(
    "io06_pick_by_priority",
    f"""SELECT lang, path, priority FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY priority, path) AS k FROM (SELECT lang, path, CAST(CASE WHEN contains(path, 'lexically_controlled') THEN 0 WHEN contains(path, '/experiment-2/core') THEN 1 ELSE 2 END AS BIGINT) AS priority FROM {_PATHS}) p) r WHERE k = 1""",
)
def _(t):
    return tables.pick_by_priority(
        _paths(t), ["lang"], "path", ["lexically_controlled", "/experiment-2/core"]
    )


@query(
    "io07_union_all",
    """SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages UNION ALL SELECT item_id, NULL, NULL FROM benchmark""",
)
def _(t):
    return tables.union_all(
        [
            t.documents.select(F.col("doc_id").alias("id"), "lang"),
            t.pages.select(F.col("page_id").alias("id"), "url"),
            t.benchmark.select(F.col("item_id").alias("id")),
        ]
    )


@query(
    "io08_source_columns",
    f"""SELECT doc_id, concat('colab_', lang) AS source_model_run, CASE doc_id % 3 WHEN 2 THEN 'core_targets_jabberwocky_primes' WHEN 0 THEN 'core' ELSE CASE WHEN doc_id % 4 = 2 THEN 'core' ELSE 'jabberwocky' END END AS dataset FROM {_PATHS}""",
)
def _(t):
    return tables.add_source_columns(_paths(t), "path").select("doc_id", "source_model_run", "dataset")


@query("io09_read_optional", "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels")
def _(t):
    here = tables.read_optional(t.spark, f"{t.root}/labels.parquet", t.labels.schema)
    gone = tables.read_optional(t.spark, f"{t.root}/no_such_table.parquet", t.labels.schema)
    return here.unionByName(gone)


@query(
    "io10_write_outputs",
    """SELECT 'parquet' AS fmt, o_orderpriority, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'csv', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def _(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    back = []
    for fmt in ("parquet", "csv"):
        root = scratch_path(t.spark, fmt)
        tables.write_outputs({"counts": counts}, root, fmt)
        reader = t.spark.read.schema("o_orderpriority string, n bigint").option("header", True)
        back.append(reader.format(fmt).load(f"{root}/counts").withColumn("fmt", F.lit(fmt)))
    return tables.union_all(back)


@query(
    "io11_manifest",
    """SELECT 'orders' AS output, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders UNION ALL SELECT 'labels', count(*), 3 FROM labels UNION ALL SELECT 'nation', count(*), 3 FROM nation""",
)
def _(t):
    outputs = {"orders": t.orders, "labels": t.labels, "nation": t.nation}
    root = scratch_path(t.spark, "manifest")
    tables.write_manifest(outputs, root)
    schema = "output string, n_rows bigint, n_columns bigint, columns string"
    return t.spark.read.schema(schema).json(f"{root}/manifest").drop("columns")


@query("io12_run_partitioned", "SELECT event_type, event_id, value FROM events WHERE event_type IN ('click', 'error', 'view')")
def _(t):
    root, values = scratch_path(t.spark, "parts"), ["click", "error", "view"]
    rows = t.events.select("event_id", "value", "event_type")
    tables.run_partitioned(rows, "event_type", values[:2], root)
    tables.run_partitioned(rows, "event_type", values, root)
    return tables.read_partitioned(t.spark, "event_type", values, root)


@query("io13_export_review", "SELECT doc_id, source, lang FROM documents")
def _(t):
    return tables.export_review(t.documents, ["doc_id", "missing", "source", "lang"])


@query("io14_read_wordlist", "SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM benchmark) x WHERE regexp_full_match(lower(w), '[a-z]+')")
def _(t):
    path = scratch_path(t.spark, "words")
    words = F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))
    t.benchmark.select(words.alias("value")).write.text(path)
    return tables.read_wordlist(t.spark, path)


@query(
    "s04_read_scores",
    """SELECT item_index, CAST(len(candidate_a_token_logprobs) AS BIGINT) AS n_a, R6(list_sum(candidate_a_token_logprobs)) AS sum_a, array_to_string(candidate_b_tokens, ' ') AS tokens_b,
  R6(list_sum(candidate_b_token_logprobs) - list_sum(candidate_a_token_logprobs)) AS logodds_passive FROM scored_pairs""",
)
def _(t):
    from ..functions import arrays

    p = t.scored_pairs()
    lists = ["candidate_a_token_logprobs", "candidate_b_token_logprobs", "candidate_b_tokens"]
    total = {
        f"{v}_choice_logprob": arrays.array_sum(F.col(f"candidate_{s}_token_logprobs"))
        for v, s in (("active", "a"), ("passive", "b"))
    }
    flat = p.select(
        "item_index", *[c.alias(n) for n, c in total.items()], *[F.to_json(c).alias(c) for c in lists]
    )
    schema = ", ".join(["item_index bigint", *[f"{n} double" for n in total], *[f"{c} string" for c in lists]])
    rows = scores.read_scores(t.spark, _write_csv(flat, "scores"), schema)
    return rows.select(
        "item_index", F.size(lists[0]).alias("n_a"), arrays.array_sum(F.col(lists[0])).alias("sum_a"),
        F.array_join(lists[2], " ").alias("tokens_b"), "logodds_passive",
    )


@query(
    "st26_run_analysis",
    """WITH g AS (SELECT count(*) AS n FROM (SELECT DISTINCT model_condition, lexicality_condition FROM item_scores) x), gp AS (SELECT count(*) AS n FROM (SELECT DISTINCT model_condition, lexicality_condition, prime_condition FROM item_scores) x),
mp AS (SELECT count(*) AS n FROM (SELECT DISTINCT model_condition, prime_condition FROM item_scores) x), m AS (SELECT count(DISTINCT model_condition) AS n FROM item_scores), mr AS (SELECT count(*) AS n FROM (SELECT DISTINCT model_condition, prime_condition, role_order FROM item_scores) x),
u AS (SELECT count(*) AS n FROM (SELECT 1 FROM item_scores GROUP BY model_condition, lexicality_condition, item_id HAVING count_if(prime_condition = 'active') > 0 AND count_if(prime_condition = 'passive') > 0) x)
SELECT 'summaries' AS output, m.n + mp.n + g.n + 1 + mr.n AS n_rows FROM m, mp, g, mr UNION ALL SELECT 'bootstrap_by_prime_condition', n FROM mp UNION ALL SELECT 'summary_by_measure_prime_condition', 2 * n FROM gp UNION ALL SELECT 'priming_effects_all_measures', 2 * n FROM g
UNION ALL SELECT 'paired_condition_tests_all_measures', 10 * n FROM g UNION ALL SELECT 'pe_item_level', n FROM u UNION ALL SELECT 'pe_summary', 3 * n FROM g""",
)
def _(t):
    return tables.manifest(_run_analysis(t)).select("output", "n_rows")


def _run_analysis(t):
    """The bundle's outputs, written in full and read back."""
    a, p = F.col("active_choice_logprob"), F.col("passive_choice_logprob")
    rows = t.item_scores().withColumns({"preference_total": a - p, "passive_minus_active_logprob": p - a}).withColumn(
        "prime_condition", F.col("prime_condition_raw")
    )
    out = bundle.run_analysis(rows)
    root = scratch_path(t.spark, "run_analysis")
    tables.write_outputs(out, root)
    return tables.read_outputs(t.spark, list(out), root)


@query("st26_run_analysis_values")
def _(t):
    return tables.long_values(_run_analysis(t), ["item_id"])


@query(
    "st26_answer_analysis",
    """SELECT 'summary_by_prime_condition' AS output, count(DISTINCT prime_condition) AS n_rows FROM role_answers UNION ALL SELECT 'summary_by_target_voice', 2 FROM (SELECT 1) x UNION ALL SELECT 'summary_by_lexicality', count(DISTINCT lexicality_condition) FROM role_answers
UNION ALL SELECT 'summary_baseline_vs_primed', count(DISTINCT lexicality_condition) FROM role_answers UNION ALL SELECT 'ceiling_diagnostics', count(*) FROM (SELECT DISTINCT prime_condition, target_voice, lexicality_condition FROM role_answers) y""",
)
def _(t):
    from ..operators import review

    rows = review.score_answers(t.role_answers(), "answer_raw", "correct_head", "foil_head")
    return tables.manifest(bundle.answer_analysis(rows)).select("output", "n_rows")


@query("st26_analysis_ready")
def _(t):
    from .aggregates import labelled

    pairs = t.scored_pairs().withColumns(
        {"row_id": F.col("item_index"), "active_choice_logprob": F.lit(-1.0), "passive_choice_logprob": F.lit(-2.0)}
    )
    made = labelled(t).withColumn("lexicality_condition", clean.infer_domain(F.col("role_order")))
    out = bundle.analysis_ready(
        pairs, ["item_index"], ["item_index", "lexicality_condition", "prime_condition"], made
    )
    return tables.manifest(out).select("output", "n_rows")


@query("st26_choice_analysis")
def _(t):
    a, p = F.col("active_choice_logprob"), F.col("passive_choice_logprob")
    rows = t.item_scores().withColumns(
        {
            "passive_minus_active_logprob": p - a,
            "chosen_structure": clean.choose_structure(a, p),
            "passive_choice_indicator": (p > a).cast("double"),
        }
    )
    return tables.long_values(bundle.choice_analysis(rows, ["lexicality_condition"], "item_id"))
