"""Token lists and tables, n-gram scores, word categories."""

from pyspark.sql import functions as F

from ..functions import arrays, clean, fixed, text
from ..operators import ngrams, summaries, tokens
from ..sources.shared import discard, materialize
from .registry import query

SIDE = ["condition", "target_structure"]


@query(
    "ar01_decode_list",
    """SELECT item_index, target_structure, CAST(len(congruent) AS BIGINT) AS n, R6(list_sum(congruent)) AS total, CAST(0 AS BIGINT) AS n_bad, CAST(2 AS BIGINT) AS n_mixed FROM token_lists""",
)
def _(t):
    def size(x):
        return F.size(arrays.decode_list(x))

    rows = t.token_lists().withColumn("j", F.to_json("congruent"))
    decoded = arrays.decode_list("j")
    bad = F.concat(F.lit('{"a": '), "j", F.lit("}"))
    return rows.select(
        "item_index", "target_structure", F.size(decoded).alias("n"), arrays.array_sum(decoded).alias("total"),
        size(bad).alias("n_bad"), size(F.lit('[1, "x", 2.5, null]')).alias("n_mixed"),
    )


@query(
    "ar02_safe_get",
    """SELECT item_index, target_structure, R6(congruent[1]) AS first, R6(congruent[2]) AS second, R6(congruent[-1]) AS last, CAST(NULL AS DOUBLE) AS beyond FROM token_lists""",
)
def _(t):
    cells = {"first": 0, "second": 1, "last": -1, "beyond": 500}
    return t.token_lists().select(
        "item_index", "target_structure", *[arrays.safe_get("congruent", i).alias(n) for n, i in cells.items()]
    )


_PREFIX = """(SELECT *, CAST(coalesce(list_position(list_transform(list_zip(candidate_a_tokens, candidate_b_tokens), lambda p: p[1] IS DISTINCT FROM p[2]), true) - 1, len(candidate_a_tokens)) AS BIGINT) AS pre,
  CAST(least(len(candidate_a_tokens), len(candidate_b_tokens)) AS BIGINT) AS n FROM scored_pairs) s"""


@query(
    "ar03_shared_prefix",
    f"SELECT item_index, pre AS shared, CASE WHEN pre < n THEN pre ELSE -1 END AS divergence, CAST(-1 AS BIGINT) AS same FROM {_PREFIX}",
)
def _(t):
    a, b = "candidate_a_tokens", "candidate_b_tokens"
    return t.scored_pairs().select(
        "item_index", arrays.shared_prefix(a, b).alias("shared"),
        arrays.divergence_index(a, b).alias("divergence"), arrays.divergence_index(a, a).alias("same"),
    )


@query(
    "ar04_location_metrics",
    f"""SELECT item_index, pre AS shared_prefix_token_count, CASE WHEN pre < n THEN pre ELSE -1 END AS divergence_token_index, R6(a[1] - b[1]) AS preference_first_token, R6(a[2] - b[2]) AS preference_second_token, R6(a[-1] - b[-1]) AS preference_last_token,
  R6(CASE WHEN pre < n THEN a[pre + 1] - b[pre + 1] END) AS preference_divergence_token, R6(list_avg(d)) AS preference_aligned_mean, R6(d[1]) AS preference_aligned_first, R6(d[-1]) AS preference_aligned_last, n AS aligned_length
FROM (SELECT *, candidate_a_token_logprobs AS a, candidate_b_token_logprobs AS b, list_transform(list_zip(candidate_a_token_logprobs[:n], candidate_b_token_logprobs[:n]), lambda p: p[1] - p[2]) AS d FROM {_PREFIX}) q""",
)
def _(t):
    out = arrays.location_metrics(
        "candidate_a_tokens", "candidate_b_tokens", "candidate_a_token_logprobs", "candidate_b_token_logprobs"
    )
    kept = [n for n in out if n.startswith("preference") and not n.endswith("diffs")]
    kept += ["shared_prefix_token_count", "divergence_token_index", "aligned_length"]
    return t.scored_pairs().select("item_index", *[out[n].alias(n) for n in kept])


_REGION = {
    "active": "CASE word_index " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(fixed.ACTIVE_REGIONS)) + " ELSE 'other_active' END",
    "passive": "CASE word_index " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(fixed.PASSIVE_REGIONS)) + " ELSE 'other_passive' END",
}
_ROI = f"CASE target_structure WHEN 'active' THEN {_REGION['active']} ELSE {_REGION['passive']} END"


@query(
    "ar05_explode_tokens",
    f"""SELECT item_index, target_structure AS candidate_voice, token_index, token_index + 1 AS token_position, token, word_index, split_part(target_text, ' ', CAST(word_index + 1 AS INT)) AS word, R6(congruent_log_prob) AS token_logprob,
  R6(exp(congruent_log_prob)) AS token_probability, R6(-congruent_log_prob) AS token_surprisal, {_ROI} AS roi FROM token_rows""",
)
def _(t):
    rows = tokens.explode_tokens(
        t.scored_pairs(), ["item_index"], {"candidate_a": "passive", "candidate_b": "active"}
    )
    return rows.drop("candidate_slot", "candidate_label", "token_count")


@query(
    "ar06_clean_piece",
    """SELECT item_index, target_structure, token_index, lower(token) AS a, lower(token) AS b, '!' AS c, CASE WHEN token = '.' THEN '.' ELSE lower(token) END AS d FROM token_rows""",
)
def _(t):
    def clean_of(x):
        return arrays.clean_piece(x)

    return t.token_rows(words=False).select(
        "item_index", "target_structure", "token_index",
        clean_of(F.concat(F.lit("▁"), F.upper("token"))).alias("a"),
        clean_of(F.concat(F.lit("Ġ\"'"), "token", F.lit("'--"))).alias("b"),
        clean_of(F.lit(" ?!! ")).alias("c"),
        clean_of(F.when(F.col("token") == ".", "...").otherwise(F.concat(F.lit("--"), "token", F.lit(")")))).alias("d"),
    )


@query(
    "ar07_align_tokens",
    """SELECT item_index, target_structure, string_agg(word_index, ',' ORDER BY token_index) AS word_indexes FROM token_rows GROUP BY 1, 2""",
)
def _(t):
    at = arrays.align_tokens("tokens", text.words("target_text"))
    return t.token_lists().select(
        "item_index", "target_structure", F.array_join(F.transform(at, lambda i: i.cast("string")), ",").alias("word_indexes")
    )


@query(
    "ar08_align_by_offset",
    """SELECT item_index, target_structure, string_agg(word_index, ',' ORDER BY token_index) AS word_indexes FROM token_rows GROUP BY 1, 2""",
)
def _(t):
    glued = lambda i: F.array_join(F.slice(F.col("tokens"), F.lit(1), i), "")
    rows = t.token_lists().withColumn(
        "__word", arrays.align_tokens("tokens", F.split("target_text", " "))
    )
    offsets = F.transform(
        "tokens",
        lambda tok, i: F.struct(
            (F.length(glued(i)) + F.get(F.col("__word"), i)).alias("start"),
            (F.length(glued(i)) + F.get(F.col("__word"), i) + F.length(tok)).alias("end"),
        ),
    )
    at = arrays.align_by_offset(offsets, arrays.word_spans("target_text"))
    return rows.select(
        "item_index", "target_structure", F.array_join(F.transform(at, lambda i: i.cast("string")), ",").alias("word_indexes")
    )


@query(
    "ar09_region_label",
    f"SELECT item_index, target_structure, token_index, {_ROI} AS roi, 'unaligned' AS lost, 'other' AS nowhere FROM token_rows",
)
def _(t):
    return t.token_rows().select(
        "item_index", "target_structure", "token_index",
        arrays.region_label("target_structure", "word_index").alias("roi"),
        arrays.region_label("target_structure", F.lit(-1)).alias("lost"),
        arrays.region_label(F.lit("question"), "word_index").alias("nowhere"),
    )


@query(
    "ar10_token_pe",
    "SELECT item_index, target_structure, token_index, R6(token_pe) AS token_pe FROM token_rows",
)
def _(t):
    pe = arrays.token_pe("congruent", "incongruent", "tokens", "tokens")
    return t.token_lists().select(
        "item_index", "target_structure", F.posexplode(pe).alias("token_index", "token_pe")
    )


# Divergence from the paired target, start of the third word, tokens of the third word.
_MARKS = """(SELECT r.*, d.cut, d.region, d.stop FROM token_rows r JOIN (SELECT item_index, target_structure, min(CASE WHEN diff THEN token_index END) AS cut, min(CASE WHEN word_index = 2 THEN token_index END) AS region,
  max(CASE WHEN word_index = 2 THEN token_index END) + 1 AS stop FROM (SELECT a.*, a.token IS DISTINCT FROM b.token AS diff FROM token_rows a LEFT JOIN token_rows b ON a.item_index = b.item_index AND a.target_structure <> b.target_structure AND a.token_index = b.token_index) x GROUP BY 1, 2) d USING (item_index, target_structure)) m"""
ITEM_PE = f"""SELECT condition, target_structure, item_index, sum(token_pe) AS sentence_pe, avg(token_pe) AS sentence_pe_mean, sum(CASE WHEN word_index = 2 THEN token_pe END) AS critical_word_pe, avg(CASE WHEN word_index = 2 THEN token_pe END) AS critical_word_pe_mean,
  sum(CASE WHEN token_index >= cut THEN token_pe END) AS post_divergence_pe, avg(CASE WHEN token_index >= cut THEN token_pe END) AS post_divergence_pe_mean, coalesce(sum(CASE WHEN token_index < cut THEN token_pe END), 0) AS pre_divergence_pe,
  sum(CASE WHEN token_index >= region THEN token_pe END) AS structure_region_pe, avg(CASE WHEN token_index >= region THEN token_pe END) AS structure_region_pe_mean FROM {_MARKS} GROUP BY 1, 2, 3"""


def _marked(t):
    words = F.split("target_text", " ")
    pieces_of = lambda c: F.flatten(
        F.transform(
            F.split(c, " "),
            lambda w: F.when(F.length(w) > 4, F.array(F.substring(w, 1, 4), F.substring(w, 5, 100))).otherwise(F.array(w)),
        )
    )
    rows = t.token_lists().withColumns(
        {"pe": arrays.token_pe("congruent", "incongruent"), "at": arrays.align_tokens("tokens", words)}
    )
    return rows.withColumns(
        {
            "cut": arrays.divergence_index("tokens", pieces_of("paired_text"), None),
            "region": F.array_position("at", 2).cast("int") - 1,
            "stop": (F.array_position("at", 3) - 1).cast("int"),
        }
    )


def item_table(t):
    out = arrays.item_pe("pe", "cut", "region", "region", "stop")
    return _marked(t).select("condition", "target_structure", "item_index", *[c.alias(n) for n, c in out.items()])


def token_table(t):
    """Token rows with the divergence, region and critical-word flags."""
    rows = _marked(t)
    zipped = F.arrays_zip(
        F.col("pe").alias("token_pe"), F.col("at").alias("word_index"),
        F.col("congruent").alias("congruent_log_prob"), F.col("incongruent").alias("incongruent_log_prob"),
    )
    out = rows.select(
        "condition", "target_structure", "item_index", "target_text", "cut", "region", "stop",
        F.posexplode(zipped).alias("token_index", "z"),
    )
    return out.select(
        "condition", "target_structure", "item_index", "target_text", "token_index",
        *[F.col("z").getField(n).alias(n) for n in ("token_pe", "word_index", "congruent_log_prob", "incongruent_log_prob")],
        (F.col("token_index") >= F.col("cut")).alias("is_post_divergence"),
        (F.col("token_index") >= F.col("region")).alias("is_structure_region"),
        ((F.col("token_index") >= F.col("region")) & (F.col("token_index") < F.col("stop"))).alias("is_critical_word"),
    )


_ITEM_COLUMNS = list(summaries.ITEM_MEASURES)


@query(
    "ar11_item_pe",
    f"SELECT condition, target_structure, item_index, {', '.join(f'R6({c}) AS {c}' for c in _ITEM_COLUMNS)} FROM ({ITEM_PE}) i",
)
def _(t):
    return item_table(t).select("condition", "target_structure", "item_index", *_ITEM_COLUMNS)


@query(
    "ar12_word_scores",
    """SELECT condition, target_structure, item_index, word_index, min(token_index) AS token_start, max(token_index) + 1 AS token_end, count(*) AS token_count, R6(sum(token_pe)) AS word_pe, R6(avg(token_pe)) AS word_pe_mean FROM token_rows GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return tokens.word_scores(t.token_rows(), ["condition", "target_structure", "item_index"])


@query(
    "ag15_summarize_items",
    f"SELECT condition, target_structure, count(*) AS n_items, {', '.join(f'R6(avg({c})) AS mean_{c}, R6(stddev_samp({c})) AS sd_{c}' for c in _ITEM_COLUMNS)} FROM ({ITEM_PE}) i GROUP BY 1, 2",
)
def _(t):
    return summaries.summarize_items(item_table(t))


@query(
    "ag16_summarize_tokens",
    f"""SELECT condition, target_structure, token_index, count(*) AS n_items, R6(avg(token_pe)) AS mean_token_pe, R6(stddev_samp(token_pe)) AS sd_token_pe, R6(avg(congruent_log_prob)) AS mean_congruent_log_prob, R6(avg(incongruent_log_prob)) AS mean_incongruent_log_prob,
  R6(avg(CAST(token_index >= cut AS INT))) AS post_divergence_rate, R6(avg(CAST(token_index >= region AS INT))) AS structure_region_rate FROM {_MARKS} GROUP BY 1, 2, 3""",
)
def _(t):
    return summaries.summarize_tokens(token_table(t))


_WORDS = """SELECT condition, target_structure, item_index, word_index, count(*) AS token_count, sum(token_pe) AS word_pe, avg(token_pe) AS word_pe_mean, word_index = 2 AS is_critical_word, split_part(max(target_text), ' ', CAST(word_index + 1 AS INT)) AS word FROM token_rows GROUP BY 1, 2, 3, 4"""


@query(
    "ag17_tokens_to_words",
    f"SELECT condition, target_structure, item_index, word_index, token_count, R6(word_pe) AS word_pe, R6(word_pe_mean) AS word_pe_mean, is_critical_word, word FROM ({_WORDS}) w",
)
def _(t):
    return summaries.tokens_to_words(token_table(t)).drop("target_text")


@query(
    "ag18_summarize_words",
    f"""SELECT condition, target_structure, word_index, count(*) AS n_items, arg_min(word, item_index) AS word, R6(avg(word_pe)) AS mean_word_pe, R6(stddev_samp(word_pe)) AS sd_word_pe, R6(avg(word_pe_mean)) AS mean_word_pe_mean,
  R6(stddev_samp(word_pe_mean)) AS sd_word_pe_mean, R6(avg(CAST(is_critical_word AS INT))) AS critical_word_rate FROM ({_WORDS}) w GROUP BY 1, 2, 3""",
)
def _(t):
    return summaries.summarize_words(summaries.tokens_to_words(token_table(t)))


_REPORT = [c for c in _ITEM_COLUMNS if c != "pre_divergence_pe"]


@query(
    "ag19_region_report",
    f"SELECT condition, target_structure, count(*) AS n_items, {', '.join(f'R6(avg({c})) AS {c}_avg, R6(coalesce(stddev_samp({c}) / sqrt(count({c})), 0)) AS {c}_se' for c in _REPORT)} FROM ({ITEM_PE}) i GROUP BY 1, 2",
)
def _(t):
    return summaries.region_report(item_table(t))


@query(
    "ag20_roi_summary",
    f"""SELECT item_index, target_structure AS candidate_voice, {_ROI} AS roi, R6(sum(congruent_log_prob)) AS roi_logprob_sum, R6(avg(congruent_log_prob)) AS roi_logprob_mean, R6(sum(-congruent_log_prob)) AS roi_surprisal_sum,
  R6(avg(-congruent_log_prob)) AS roi_surprisal_mean, count(*) AS roi_token_count FROM token_rows GROUP BY 1, 2, 3""",
)
def _(t):
    rows = tokens.explode_tokens(t.scored_pairs(), ["item_index"], {"candidate_a": "active", "candidate_b": "passive"})
    return summaries.roi_summary(rows, ["item_index", "no_such_column", "candidate_voice", "roi"])


@query(
    "ag21_roi_profile",
    f"""WITH i AS (SELECT item_index, condition, target_structure AS voice, {_ROI} AS roi, avg(congruent_log_prob) AS m FROM token_rows GROUP BY 1, 2, 3, 4)
SELECT condition, voice, roi, count(*) AS n_items, R6(avg(m)) AS mean_logprob, R6(stddev_samp(m) / sqrt(count(*))) AS se FROM i GROUP BY 1, 2, 3""",
)
def _(t):
    rows = t.token_rows().select(
        "item_index", "condition", F.col("target_structure").alias("voice"),
        arrays.region_label("target_structure", "word_index").alias("roi"), F.col("congruent_log_prob").alias("token_logprob"),
    )
    return summaries.roi_profile(rows, ["item_index"], ["condition", "voice", "roi"])


@query(
    "ag22_token_positions",
    """SELECT condition AS lexicality_condition, concat(target_structure, '_completion') AS candidate_label, token_index AS token_position, R6(avg(congruent_log_prob)) AS token_logprob_mean, R6(stddev_samp(congruent_log_prob)) AS token_logprob_std, count(*) AS n_tokens FROM token_rows GROUP BY 1, 2, 3""",
)
def _(t):
    return tokens.token_position_summary(t.scored_pairs(), ["lexicality_condition"])


@query(
    "ag22_token_preferences",
    """SELECT a.condition AS lexicality_condition, a.token_index AS token_position, R6(avg(a.congruent_log_prob - b.congruent_log_prob)) AS preference_token_logprob_mean, R6(stddev_samp(a.congruent_log_prob - b.congruent_log_prob)) AS preference_token_logprob_std, count(*) AS n_tokens
FROM token_rows a JOIN token_rows b ON a.item_index = b.item_index AND a.token_index = b.token_index AND a.target_structure = 'active' AND b.target_structure = 'passive' GROUP BY 1, 2""",
)
def _(t):
    return tokens.token_preference_summary(t.scored_pairs(), ["lexicality_condition"])


@query(
    "ag22_unaligned_tokens",
    """WITH n AS (SELECT item_index, condition, count(*) FILTER (target_structure = 'active') AS a, count(*) FILTER (target_structure = 'passive') AS b FROM token_rows GROUP BY 1, 2)
SELECT condition AS lexicality_condition, count(*) AS n_pairs, CAST(count_if(a <> b) AS BIGINT) AS n_unequal, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS left_out_a, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS left_out_b FROM n GROUP BY 1""",
)
def _(t):
    return tokens.unaligned_summary(t.scored_pairs(), ["lexicality_condition"])


# ---- n-gram scores ----------------------------------------------------------

_BI = """bi AS (SELECT doc_id, dataset, pos, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), '<s>') AS prev, word FROM (SELECT doc_id, dataset, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos FROM doc_tokens) x),
cn AS (SELECT prev, word, count(*) AS n FROM bi GROUP BY 1, 2), cx AS (SELECT prev, sum(n) AS context_n FROM cn GROUP BY 1), vv AS (SELECT count(DISTINCT word) AS v FROM cn),
md AS (SELECT cn.prev, cn.word, n, context_n, v, ln((n + 1) / (context_n + v)) AS logprob FROM cn JOIN cx USING (prev) CROSS JOIN vv)"""


@query(
    "s01_ngram_model",
    f"WITH {_BI} SELECT prev, word, n, CAST(context_n AS BIGINT) AS context_n, v AS vocab, R6(logprob) AS logprob FROM md",
)
def _(t):
    return tokens.ngram_model(t.doc_tokens(), "tokens")


@query(
    "s01_ngram_score",
    f"WITH {_BI} SELECT doc_id, R6(sum(logprob)) AS total_logprob, R6(avg(logprob)) AS mean_logprob, count(*) AS token_count FROM bi JOIN md USING (prev, word) GROUP BY 1",
)
def _(t):
    docs = t.doc_tokens()
    model = materialize(tokens.ngram_model(docs, "tokens"), "ngrams")
    scored = tokens.ngram_score(docs, "doc_id", "tokens", model, all_seen=True)
    return tokens.sequence_scores(scored, ["doc_id"])


@query(
    "s01_ngram_score_unseen",
    f"""WITH {_BI}, b2 AS (SELECT conv_id, turn, pos, coalesce(lag(word) OVER (PARTITION BY conv_id, turn ORDER BY pos), '<s>') AS prev, word FROM (SELECT conv_id, turn, unnest(tk) AS word, generate_subscripts(tk, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(lower(text), '([a-z]+|[.?!])', 1) AS tk FROM conversations) c) x)
SELECT conv_id * 100 + turn AS turn_id, R6(sum(coalesce(md.logprob, ln(1 / (coalesce(cx.context_n, 0) + vv.v))))) AS total_logprob, count(*) AS token_count FROM b2 LEFT JOIN md USING (prev, word) LEFT JOIN cx ON cx.prev = b2.prev CROSS JOIN vv GROUP BY 1""",
)
def _(t):
    model = materialize(tokens.ngram_model(t.doc_tokens(), "tokens"), "ngrams")
    turns = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), text.words("text").alias("tokens")
    )
    scored = tokens.ngram_score(turns, "turn_id", "tokens", model)
    return tokens.sequence_scores(scored, ["turn_id"]).drop("mean_logprob")


_DISCOUNT = "CASE WHEN count_if(n = 1) > 0 AND count_if(n = 2) > 0 THEN count_if(n = 1) / (count_if(n = 1) + 2 * count_if(n = 2)) ELSE 0.5 END"
_KN = f"""tk AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos FROM doc_tokens),
tri AS (SELECT doc_id, pos, coalesce(lag(word, 2) OVER s, '<s>') AS c2, coalesce(lag(word) OVER s, '<s>') AS c1, word FROM tk WINDOW s AS (PARTITION BY doc_id ORDER BY pos)),
n3 AS (SELECT c2, c1, word, count(*) AS n FROM tri GROUP BY ALL), n2 AS (SELECT c1, word, count(*) AS n FROM n3 GROUP BY ALL), n1 AS (SELECT word, count(*) AS n FROM n2 GROUP BY ALL),
d3 AS (SELECT {_DISCOUNT} AS d FROM n3), d2 AS (SELECT {_DISCOUNT} AS d FROM n2), x1 AS (SELECT {_DISCOUNT} AS d, sum(n) AS t, count(*) AS v FROM n1),
x2 AS (SELECT c1, sum(n) AS t, any_value(d) * count(*) / sum(n) AS b FROM n2, d2 GROUP BY 1), x3 AS (SELECT c2, c1, sum(n) AS t, any_value(d) * count(*) / sum(n) AS b FROM n3, d3 GROUP BY 1, 2),
p1 AS (SELECT word, (n - d) / t + d * v / t / (v + 1) AS p FROM n1, x1), p2 AS (SELECT n2.c1, n2.word, (n2.n - d) / x2.t + x2.b * p1.p AS p FROM n2 JOIN x2 USING (c1) JOIN p1 USING (word) CROSS JOIN d2),
p3 AS (SELECT n3.c2, n3.c1, n3.word, n3.n, (n3.n - d) / x3.t + x3.b * p2.p AS p FROM n3 JOIN x3 USING (c2, c1) JOIN p2 USING (c1, word) CROSS JOIN d3)"""


@query("s01_kneser_ney_model", f"WITH {_KN} SELECT c2, c1, word, n, R6(ln(p)) AS logprob FROM p3")
def _(t):
    grams = ngrams.kneser_ney(t.doc_tokens(), "tokens").grams[2]
    return grams.select("c2", "c1", "word", "n", F.log("p").alias("logprob"))


@query(
    "s01_kneser_ney_contexts",
    f"""WITH {_KN} SELECT c1, CAST(t AS BIGINT) AS total, R6(b) AS backoff, R6(q.known) AS known FROM x2 JOIN (SELECT c1, sum(p) AS known FROM p2 GROUP BY 1) q USING (c1)""",
)
def _(t):
    model = ngrams.kneser_ney(t.doc_tokens(), "tokens")
    known = model.grams[1].groupBy("c1").agg(F.sum("p").alias("known"))
    return model.contexts[1].join(known, "c1").select("c1", "total", "backoff", "known")


@query(
    "s01_kneser_ney_score",
    f"WITH {_KN} SELECT doc_id, R6(sum(ln(p))) AS total_logprob, R6(avg(ln(p))) AS mean_logprob, count(*) AS token_count FROM tri JOIN p3 USING (c2, c1, word) GROUP BY 1",
)
def _(t):
    docs = t.doc_tokens()
    model = ngrams.kneser_ney(docs, "tokens")
    discard(*model.contexts, *model.grams[:-1])  # the highest order knows all n-grams of its own text
    scored = ngrams.kneser_ney_scores(docs, ["doc_id"], "tokens", model, all_seen=True)
    return tokens.sequence_scores(scored, ["doc_id"])


@query(
    "s01_kneser_ney_unseen",
    f"""WITH {_KN}, tn AS (SELECT conv_id * 100 + turn AS turn_id, unnest(tk) AS word, generate_subscripts(tk, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(lower(text), '([a-z]+|[.?!])', 1) AS tk FROM conversations) c),
tg AS (SELECT turn_id, pos, coalesce(lag(word, 2) OVER s, '<s>') AS c2, coalesce(lag(word) OVER s, '<s>') AS c1, word FROM tn WINDOW s AS (PARTITION BY turn_id ORDER BY pos)),
q AS (SELECT turn_id, coalesce(p3.p, coalesce(x3.b, 1) * coalesce(p2.p, coalesce(x2.b, 1) * coalesce(p1.p, x1.d * x1.v / x1.t / (x1.v + 1)))) AS p
  FROM tg LEFT JOIN p3 ON (tg.c2, tg.c1, tg.word) = (p3.c2, p3.c1, p3.word) LEFT JOIN x3 ON (tg.c2, tg.c1) = (x3.c2, x3.c1)
  LEFT JOIN p2 ON (tg.c1, tg.word) = (p2.c1, p2.word) LEFT JOIN x2 ON tg.c1 = x2.c1 LEFT JOIN p1 ON tg.word = p1.word CROSS JOIN x1)
SELECT turn_id, R6(sum(ln(p))) AS total_logprob, R6(avg(ln(p))) AS mean_logprob, count(*) AS token_count FROM q GROUP BY 1""",
)
def _(t):
    turns = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), text.words("text").alias("tokens")
    )
    scored = ngrams.kneser_ney_scores(turns, ["turn_id"], "tokens", ngrams.kneser_ney(t.doc_tokens(), "tokens"))
    return tokens.sequence_scores(scored, ["turn_id"])


_QS = """qs AS (SELECT item_index, 'a' AS slot, ta AS s FROM quartets UNION ALL SELECT item_index, 'b', tp FROM quartets), qb AS (SELECT item_index, slot, pos, coalesce(lag(word) OVER (PARTITION BY item_index, slot ORDER BY pos), '<s>') AS prev, word
  FROM (SELECT item_index, slot, unnest(string_split(s, ' ')) AS word, generate_subscripts(string_split(s, ' '), 1) - 1 AS pos FROM qs) x),
qn AS (SELECT prev, word, count(*) AS n FROM qb GROUP BY 1, 2), qx AS (SELECT prev, sum(n) AS c FROM qn GROUP BY 1), qv AS (SELECT count(DISTINCT word) AS v FROM qn), qm AS (SELECT qn.prev, qn.word, ln((n + 1) / (c + v)) AS lp, (n + 1) / (c + v) AS p FROM qn JOIN qx USING (prev) CROSS JOIN qv)"""


def _sentences(t):
    cells = F.array(
        F.struct(F.lit("a").alias("slot"), F.split("ta", " ").alias("tokens")),
        F.struct(F.lit("b").alias("slot"), F.split("tp", " ").alias("tokens")),
    )
    rows = t.quartets().select("item_index", F.explode(cells).alias("c")).select("item_index", "c.*")
    return rows.withColumn("key", F.concat_ws("|", F.col("item_index").cast("string"), "slot"))


@query(
    "s03_assemble_scores",
    f"""WITH {_QS}, t AS (SELECT item_index, slot, sum(lp) AS s, avg(lp) AS m, count(*) AS n FROM qb JOIN qm USING (prev, word) GROUP BY 1, 2)
SELECT a.item_index, R6(a.s) AS candidate_a_total_logprob, R6(b.s) AS candidate_b_total_logprob, R6(a.m) AS active_choice_logprob, R6(b.m) AS passive_choice_logprob, R6(a.s - b.s) AS preference_total, R6(a.m - b.m) AS preference_mean,
  CASE WHEN b.m > a.m THEN 'passive' ELSE 'active' END AS chosen_structure FROM t a JOIN t b ON a.item_index = b.item_index AND a.slot = 'a' AND b.slot = 'b'""",
)
def _(t):
    rows = _sentences(t)
    model = materialize(tokens.ngram_model(rows, "tokens"), "ngrams")
    scored = tokens.ngram_score(rows, "key", "tokens", model, all_seen=True)
    scored = tokens.sequence_scores(scored, ["key"])
    scored = scored.withColumns(
        {"item_index": F.split_part("key", F.lit("|"), F.lit(1)).cast("bigint"), "slot": F.split_part("key", F.lit("|"), F.lit(2))}
    )
    wide = scored.groupBy("item_index").agg(
        *[
            F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"candidate_{s}_{c}")
            for s in ("a", "b")
            for c in ("total_logprob", "token_count")
        ]
    )
    out = clean.pairwise_preference(
        "candidate_a_total_logprob", "candidate_b_total_logprob", "candidate_a_token_count", "candidate_b_token_count"
    )
    kept = ("active_choice_logprob", "passive_choice_logprob", "preference_total", "preference_mean", "chosen_structure")
    return wide.select(
        "item_index", "candidate_a_total_logprob", "candidate_b_total_logprob", *[out[n].alias(n) for n in kept]
    )


# ---- word categories --------------------------------------------------------

_VALUES = ", ".join(f"('{c}', '{w}')" for c, ws in fixed.CLOSED_CATEGORIES.items() for w in ws)
_NOT_NOUN = ", ".join(f"'{w}'" for w in fixed.CLOSED_CATEGORIES["DET"] + fixed.CLOSED_CATEGORIES["PREP"])
_VOC = f"""mt AS (SELECT DISTINCT category, word FROM (SELECT unnest([split_part(pa, ' ', 2), split_part(pa, ' ', 5), split_part(ta, ' ', 2), split_part(ta, ' ', 5), split_part(pp, ' ', 2), split_part(pp, ' ', 7), split_part(tp, ' ', 2), split_part(tp, ' ', 7)]) AS word, 'NOUN' AS category FROM quartets
  UNION ALL SELECT unnest([split_part(pa, ' ', 3), split_part(ta, ' ', 3), split_part(pp, ' ', 4), split_part(tp, ' ', 4)]), 'FINITE_VERB' FROM quartets UNION ALL SELECT unnest([split_part(pp, ' ', 4), split_part(tp, ' ', 4)]), 'PARTICIPLE' FROM quartets) x
  WHERE category <> 'NOUN' OR word NOT IN ({_NOT_NOUN})),
vc AS (SELECT category, word FROM mt UNION SELECT * FROM (VALUES {_VALUES}) v(category, word)),
ac AS (SELECT word, arg_min(category, list_position([{', '.join(f"'{c}'" for c in fixed.CATEGORY_ORDER)}], category)) AS category FROM vc GROUP BY 1)"""


def vocab(t):
    return tokens.category_vocab(tokens.material_words(t.quartets()))


@query("ar21_category_vocab", f"WITH {_VOC} SELECT category, word FROM vc")
def _(t):
    return vocab(t)


@query("ar14_assign_category", f"WITH {_VOC} SELECT word, category FROM ac")
def _(t):
    return tokens.assign_category(vocab(t))


def probabilities(t):
    """Bigram probabilities of the sentence table as (context, word, p)."""
    model = tokens.ngram_model(_sentences(t), "tokens")
    return model.select(F.col("prev").alias("context"), "word", F.exp("logprob").alias("p"))


_MASS = f"""{_QS}, {_VOC}, kn AS (SELECT prev AS context, category, sum(p) AS mass FROM qm JOIN ac USING (word) GROUP BY 1, 2),
ms AS (SELECT * FROM kn UNION ALL SELECT x.context, 'OTHER', greatest(0.0, 1 - coalesce(s, 0)) FROM (SELECT DISTINCT prev AS context FROM qm) x LEFT JOIN (SELECT context, sum(mass) AS s FROM kn GROUP BY 1) k ON x.context = k.context)"""


@query("ar13_category_mass", f"WITH {_MASS} SELECT context, category, R6(mass) AS mass FROM ms")
def _(t):
    return tokens.category_mass(probabilities(t), tokens.assign_category(vocab(t)))


@query(
    "ar13_category_map",
    f"WITH {_MASS} SELECT context, string_agg(concat(category, '=', printf('%.4f', mass + 1e-9)), ';' ORDER BY category) AS masses FROM ms GROUP BY 1",
)
def _(t):
    maps = tokens.category_map(tokens.category_mass(probabilities(t), tokens.assign_category(vocab(t))))
    entry = F.transform(
        F.array_sort(F.map_entries("category_probability")),
        lambda e: F.format_string("%s=%.4f", e["key"], e["value"] + 1e-9),
    )
    return maps.select("context", F.array_join(entry, ";").alias("masses"))


@query(
    "ar15_entropy",
    f"WITH {_MASS} SELECT context, R6(sum(CASE WHEN mass > 0 THEN -mass * ln(mass) ELSE 0 END)) AS entropy, R6(exp(sum(CASE WHEN mass > 0 THEN -mass * ln(mass) ELSE 0 END))) AS effective_n FROM ms GROUP BY 1",
)
def _(t):
    mass = tokens.category_mass(probabilities(t), tokens.assign_category(vocab(t)))
    return tokens.group_entropy(mass, ["context"], "mass")


_PRED = f"""{_MASS}, en AS (SELECT context, sum(CASE WHEN mass > 0 THEN -mass * ln(mass) ELSE 0 END) AS h FROM ms GROUP BY 1), wi AS (SELECT prev AS context, category, sum(p) AS sm, sum(p * ln(p)) AS pl FROM qm JOIN vc USING (word) GROUP BY 1, 2),
rg AS (SELECT item_index, list_position([1, 2, 3, 4, 5, 6], pos) AS ok, ['patient_np', 'aux', 'participle', 'by', 'agent_det', 'agent_np'][pos] AS roi, ['NOUN', 'AUX', 'PARTICIPLE', 'PREP', 'DET', 'NOUN'][pos] AS category, prev AS context, word FROM qb WHERE slot = 'b' AND pos BETWEEN 1 AND 6),
pr AS (SELECT rg.item_index, rg.roi, rg.context, rg.word, rg.category AS target_category, qm.p, coalesce(ms.mass, 0) AS mass, en.h, ln(wi.sm) - wi.pl / wi.sm AS wh, EXISTS (SELECT 1 FROM vc WHERE vc.word = rg.word AND vc.category = rg.category) AS inset
  FROM rg LEFT JOIN qm ON qm.prev = rg.context AND qm.word = rg.word LEFT JOIN ms ON ms.context = rg.context AND ms.category = rg.category LEFT JOIN en ON en.context = rg.context LEFT JOIN wi ON wi.context = rg.context AND wi.category = rg.category),
pd AS (SELECT *, CASE WHEN inset AND mass > 0 THEN p / mass END AS wp, CASE WHEN mass > 0 THEN -ln(mass) END AS cs FROM pr)"""


def regions(t):
    rows = tokens.bigram_rows(_sentences(t).where("slot = 'b'"), ["item_index"], "tokens")
    return rows.select(
        "item_index", arrays.region_label(F.lit("passive"), "position").alias("roi"), F.col("prev").alias("context"), "word"
    )


def predictability(t):
    return tokens.category_predictability(
        regions(t), materialize(probabilities(t), "probabilities"), materialize(vocab(t), "vocab")
    )


@query(
    "ar16_category_predictability",
    f"""WITH {_PRED} SELECT item_index, roi, context, word, target_category, R6(p) AS actual_token_probability, R6(ln(p)) AS actual_token_logprob, R6(mass) AS target_category_probability, R6(cs) AS target_category_surprisal, R6(h) AS category_entropy, R6(exp(h)) AS category_effective_n,
  R6(wp) AS within_category_probability, R6(CASE WHEN wp > 0 THEN -ln(wp) END) AS within_category_surprisal, R6(wh) AS within_category_entropy, R6(exp(wh)) AS within_category_effective_n, inset AS target_token_in_category_set FROM pd""",
)
def _(t):
    return predictability(t).drop("actual_token_surprisal", "word_surprisal_sum")


@query(
    "ag27_category_summary",
    f"""WITH {_PRED} SELECT roi, target_category, count(*) AS n_items, R6(avg(ln(p))) AS actual_token_logprob_mean, R6(avg(-ln(p))) AS actual_token_surprisal_mean, R6(avg(mass)) AS target_category_probability_mean, R6(avg(cs)) AS target_category_surprisal_mean, R6(avg(h)) AS category_entropy_mean,
  R6(avg(exp(h))) AS category_effective_n_mean, R6(avg(wp)) AS within_category_probability_mean, R6(avg(CASE WHEN wp > 0 THEN -ln(wp) END)) AS within_category_surprisal_mean, R6(avg(wh)) AS within_category_entropy_mean, R6(avg(exp(wh))) AS within_category_effective_n_mean,
  R6(avg(-ln(p))) AS word_surprisal_sum_mean, R6(avg(CAST(inset AS INT))) AS target_token_in_category_set_rate FROM pd GROUP BY 1, 2""",
)
def _(t):
    return summaries.category_summary(predictability(t), ["roi", "target_category"])

