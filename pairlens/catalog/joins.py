"""Joins, membership tests and matching."""

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import corpus, effects, joins, neighbors, ranking, review, summaries
from .aggregates import ANSWERS, edges_of
from .registry import query
from .windows import SHIFT, UNIT, shifts

_TEXTS = "CASE c.prime_condition WHEN 'active' THEN pa WHEN 'passive' THEN pp WHEN 'filler' THEN '' ELSE '' END"
_FOUR = "(SELECT 'active' AS prime_condition UNION ALL SELECT 'passive' UNION ALL SELECT 'filler' UNION ALL SELECT 'no_prime')"


@query(
    "j01_expand_conditions",
    f"SELECT item_index, c.prime_condition, {_TEXTS} AS prime_text FROM quartets CROSS JOIN {_FOUR} c",
)
def _(t):
    texts = {"active": F.col("pa"), "passive": F.col("pp"), "filler": F.lit(""), "no_prime": F.lit("")}
    return joins.expand_conditions(t.quartets(), texts).select(
        "item_index", "prime_condition", "prime_text"
    )


@query(
    "j02_expand_grid",
    f"""SELECT item_index, c.prime_condition, v.target_voice, q.question_type FROM quartets CROSS JOIN {_FOUR} c
CROSS JOIN (SELECT 'active' AS target_voice UNION ALL SELECT 'passive') v CROSS JOIN (SELECT 'doer' AS question_type UNION ALL SELECT 'acted_on') q""",
)
def _(t):
    axes = {
        "prime_condition": fixed.CONDITIONS,
        "target_voice": ("active", "passive"),
        "question_type": ("doer", "acted_on"),
    }
    return joins.expand_grid(t.quartets().select("item_index"), axes)


@query(
    "j03_join_many_to_one",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_orderpriority, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    right = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_totalprice")
    left = t.lineitem.select("l_orderkey", "l_linenumber")
    return joins.join_checked(left, right, ["l_orderkey"], check="inline")


@query(
    "j04_join_one_to_one",
    """SELECT a.item_index, a.ta AS active_sentence, p.tp AS passive_sentence FROM quartets a JOIN quartets p ON a.item_index = p.item_index""",
)
def _(t):
    q = t.quartets()
    a = q.select("item_index", F.col("ta").alias("active_sentence"))
    p = q.select("item_index", F.col("tp").alias("passive_sentence"))
    return joins.join_checked(a, p, ["item_index"], "inner", "one_to_one", check="inline")


@query(
    "j05_merge_on_common",
    """SELECT item_id, lexicality_condition, a, p FROM (SELECT item_id, lexicality_condition, R6(avg(active_choice_logprob)) AS a FROM item_scores WHERE prime_condition = 'active' GROUP BY 1, 2) x
JOIN (SELECT item_id, lexicality_condition, R6(avg(passive_choice_logprob)) AS p FROM item_scores WHERE prime_condition = 'passive' GROUP BY 1, 2) y USING (item_id, lexicality_condition)""",
)
def _(t):
    s, by = t.item_scores(), ["item_id", "lexicality_condition"]
    a = s.where("prime_condition = 'active'").groupBy(*by).agg(F.avg("active_choice_logprob").alias("a"))
    p = s.where("prime_condition = 'passive'").groupBy(*by).agg(F.avg("passive_choice_logprob").alias("p"))
    return joins.merge_on_common(a, p)


@query(
    "j06_share_of_total",
    """SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name, c, R6(c / sum(c) OVER (PARTITION BY n_regionkey)) AS share FROM (SELECT n_regionkey, n_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) x""",
)
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = summaries.label_shares(rows, "n_name", ["n_regionkey"])
    return out.select("n_regionkey", "n_name", F.col("n_items").alias("c"), "share")


@query(
    "j07_overlay_join",
    """SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, d.lang) AS label_final, l.doc_id IS NOT NULL AS manually_reviewed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    rows = t.documents.select("doc_id", F.col("lang").alias("label"))
    reviews = t.labels.select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("reviewed_label")
    )
    return review.overlay_reviews(rows, reviews, ["doc_id"], ["label"]).select(
        "doc_id", "label_final", "manually_reviewed"
    )


@query(
    "j08_lookup",
    """SELECT c_custkey, coalesce(CASE WHEN n_regionkey < 3 THEN n_name END, CAST(c_nationkey AS VARCHAR)) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    dim = t.nation.where("n_regionkey < 3").select(
        F.col("n_nationkey").cast("string").alias("k"), "n_name"
    )
    rows = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return joins.lookup(rows, dim, "key", "n_name", "nation", dim_key="k").select("c_custkey", "nation")


@query(
    "j08_model_dimension",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '774M_base' WHEN 1 THEN '8B_instruct' ELSE 'unspecified' END AS model_condition FROM documents""",
)
def _(t):
    dim = t.spark.createDataFrame(
        list(fixed.MODEL_DIMENSION),
        "source_model_run string, model_size string, model_family string, model_instruct string, model_condition string, model_label string",
    )
    k = F.col("doc_id") % 3
    run = F.when(k == 0, "colab_gpt_2_large").when(k == 1, "colab_Llama_31_8B_Instruct").otherwise("other")
    rows = t.documents.select("doc_id", run.alias("run"))
    return joins.lookup(
        rows, dim, "run", "model_condition", "model_condition", F.lit("unspecified"), "source_model_run"
    ).select("doc_id", "model_condition")


_VOCAB = """w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
blk AS (SELECT DISTINCT substr(word, 1, 1) AS i, length(word) AS n FROM r),
lonely AS (SELECT word FROM w WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.i = substr(w.word, 1, 1) AND abs(blk.n - length(w.word)) <= 2)),
p AS (SELECT w.word, r.word AS candidate, levenshtein(w.word, r.word) AS distance FROM w JOIN r ON substr(w.word, 1, 1) = substr(r.word, 1, 1) AND abs(length(w.word) - length(r.word)) <= 2 AND w.word <> r.word
  UNION ALL SELECT l.word, r.word, levenshtein(l.word, r.word) FROM lonely l JOIN r ON abs(length(l.word) - length(r.word)) <= 2 AND l.word <> r.word),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, abs(length(candidate) - length(word)), candidate) AS rank FROM p WHERE distance <= 2)"""


def vocabulary(df):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    return df.select(F.explode(F.array_distinct(found)).alias("word")).distinct()


@query("j09_edit_neighbors", f"WITH {_VOCAB} SELECT word, candidate, distance, rank FROM k WHERE rank <= 5")
def _(t):
    return neighbors.edit_neighbors(vocabulary(t.documents), vocabulary(t.benchmark)).select(
        "word", "candidate", "distance", "rank"
    )


_EDGE = "SELECT DISTINCT split_part(ta, ' ', 2) AS cue, split_part(ta, ' ', 5) AS target FROM quartets"


@query(
    "j11_has_association",
    f"""WITH e0 AS ({_EDGE}), e AS (SELECT cue AS x, target AS y FROM e0 UNION SELECT target, cue FROM e0),
a AS (SELECT item_index, unnest([split_part(ta, ' ', 2), split_part(ta, ' ', 5), split_part(ta, ' ', 3)]) AS x, pa FROM quartets), b AS (SELECT item_index, x, unnest([split_part(pa, ' ', 2), split_part(pa, ' ', 5), split_part(pa, ' ', 3)]) AS y FROM a)
SELECT DISTINCT item_index FROM b JOIN e USING (x, y)""",
)
def _(t):
    parts = {c: text.parse_active(c) for c in ("pa", "ta")}
    left = F.array(*[parts["ta"][r] for r in ("agent", "patient", "verb")])
    right = F.array(*[parts["pa"][r] for r in ("agent", "patient", "verb")])
    return joins.has_association(t.quartets(), "item_index", left, right, edges_of(t))


_POOL = "[" + ", ".join(f"'{s}'" for s in fixed.CORE_FILLERS) + "]"


@query(
    "j12_open_pool",
    f"""SELECT item_index, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE {_POOL} END, '|') AS open_pool FROM (SELECT item_index, list_filter({_POOL}, lambda s: NOT list_has_any(string_split(lower(replace(s, ' .', '')), ' '),
  [split_part(ta, ' ', 2), split_part(ta, ' ', 5)])) AS k FROM quartets) x""",
)
def _(t):
    ta = text.parse_active("ta")
    kept = ranking.open_pool(fixed.CORE_FILLERS, F.array(ta["agent"], ta["patient"]))
    return t.quartets().select("item_index", F.array_join(kept, "|").alias("open_pool"))


@query(
    "j13_zip_rows",
    """SELECT a.item_index, a.ta, b.pa FROM quartets a JOIN quartets b ON a.item_index = b.item_index""",
)
def _(t):
    q = t.quartets()
    return joins.zip_rows(q.select("item_index", "ta"), q.select("item_index", "pa"), "item_index")


MIXED = """WITH tg AS (SELECT item_index, ta, tp, CASE split_part(tp, ' ', 3) WHEN 'is' THEN 'was' ELSE 'is' END AS aux, CASE WHEN split_part(ta, ' ', 1) = 'the' THEN 'indef' ELSE 'def' END AS fam FROM quartets),
pr AS (SELECT item_index AS prime_index, pa, pp, split_part(pp, ' ', 3) AS aux, CASE WHEN split_part(pa, ' ', 1) = 'the' THEN 'def' ELSE 'indef' END AS fam FROM quartets),
t2 AS (SELECT *, row_number() OVER (PARTITION BY aux, fam ORDER BY item_index) AS k FROM tg), p2 AS (SELECT *, row_number() OVER (PARTITION BY aux, fam ORDER BY md5(concat('13|', prime_index)), prime_index) AS k FROM pr)
SELECT t2.item_index, p2.prime_index, p2.pa, p2.pp, t2.ta, t2.tp FROM t2 {how} JOIN p2 USING (aux, fam, k)"""


@query("j14_assign_opposite", MIXED.format(how="LEFT"))
def _(t):
    q = t.quartets()
    return corpus.build_mixed(q, q, seed=13, require_all=False)


@query(
    "j15_filter_edges",
    f"""WITH e AS ({_EDGE} UNION SELECT 'baker', 'baker' UNION SELECT 'baker', 'x1'), v AS (SELECT DISTINCT split_part(pa, ' ', 2) AS word FROM quartets WHERE length(split_part(pa, ' ', 2)) <= 6)
SELECT cue, target FROM e WHERE cue IN (SELECT word FROM v) AND target IN (SELECT word FROM v) AND cue <> target""",
)
def _(t):
    extra = t.spark.createDataFrame([("baker", "baker"), ("baker", "x1")], "cue string, target string")
    words = t.quartets().select(text.parse_active("pa")["agent"].alias("word"))
    words = words.where(F.length("word") <= 6)
    return joins.filter_edges(edges_of(t).unionByName(extra), words)


@query(
    "tx46_build_edges",
    f"""WITH l AS (SELECT split_part(ta, ' ', 2) AS cue, split_part(ta, ' ', 5) AS target, CASE WHEN length(ta) % 7 = 0 THEN NULL WHEN length(ta) % 7 = 1 THEN 0 ELSE (length(ta) % 7) / 10.0 END AS fsg, item_index % 5 <> 0 AS whole FROM quartets),
v AS (SELECT DISTINCT split_part(pa, ' ', 2) AS word FROM quartets)
SELECT cue, target, R6(max(fsg)) AS fsg FROM l WHERE whole AND fsg > 0 AND cue <> target AND cue IN (SELECT word FROM v) AND target IN (SELECT word FROM v) GROUP BY 1, 2""",
)
def _(t):
    ta = text.parse_active("ta")
    k = F.length("ta") % 7
    strength = F.when(k == 0, "n/a").when(k == 1, "0").otherwise((k / 10).cast("string"))
    parts = [F.upper(ta["agent"]), ta["patient"], F.lit("YES"), F.lit("100"), F.lit("20"), strength]
    short = F.concat_ws(", ", *parts[:4])
    line = F.when(F.col("item_index") % 5 == 0, short).otherwise(F.concat_ws(", ", *parts, F.lit("0")))
    words = t.quartets().select(text.parse_active("pa")["agent"].alias("word"))
    return joins.build_edges(t.quartets().select(line.alias("value")), words)


@query(
    "j16_join_effects",
    f"""WITH r AS (SELECT item_index, target_voice, avg(CASE WHEN prime_condition = target_voice THEN CAST(matched_label = 'correct' AS INT) END) - avg(CASE WHEN prime_condition <> target_voice THEN CAST(matched_label = 'correct' AS INT) END) AS e
  FROM {ANSWERS} WHERE prime_condition <> 'no_prime' GROUP BY 1, 2), p AS (SELECT item_index, target_structure, sum(token_pe) AS pe FROM token_rows GROUP BY 1, 2)
SELECT CAST(r.item_index AS VARCHAR) AS item_index, r.target_voice, R6(r.e) AS effect, R6(p.pe) AS pe FROM r LEFT JOIN p ON r.item_index = p.item_index AND r.target_voice = p.target_structure""",
)
def _(t):
    from ..functions import arrays

    rows = review.score_answers(t.role_answers(), "answer_raw", "correct_head", "foil_head")
    comp = effects.congruency_effect(
        rows, ["item_index", "target_voice"], "prime_condition", "target_voice", "is_correct"
    ).select("item_index", "target_voice", F.col("comprehension_congruency_effect").alias("effect"))
    pe = t.token_lists().select(
        "item_index", F.col("target_structure").alias("target_voice"),
        arrays.array_sum(arrays.token_pe("congruent", "incongruent")).alias("pe"),
    )
    return joins.join_effects(comp, pe, ["item_index", "target_voice"])


@query(
    "j17_join_predictor",
    f"""WITH s AS ({SHIFT}), p AS (SELECT model_condition, lexicality_condition, item_id, prime_condition AS prime_type, R6(avg(active_target_token_count)) AS predictor FROM item_scores WHERE prime_condition = 'active' GROUP BY ALL)
SELECT model_condition, lexicality_condition, item_id, prime_type, shift_from_no_prime, predictor FROM s LEFT JOIN p USING (model_condition, lexicality_condition, item_id, prime_type)""",
)
def _(t):
    keys = [*UNIT, "prime_type"]
    predictor = (
        t.item_scores().where("prime_condition = 'active'")
        .withColumnRenamed("prime_condition", "prime_type")
        .groupBy(*keys).agg(F.avg("active_target_token_count").alias("predictor"))
    )
    return joins.join_predictor(shifts(t), predictor, keys).select(
        *keys, "shift_from_no_prime", "predictor"
    )


@query(
    "tx45_lexicon_audit",
    f"""WITH {_VOCAB}, c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations),
st AS (SELECT word, unnest([1, 2, 3, 4, 5, 6]) AS i, unnest([CASE WHEN word LIKE '%ed' AND length(word) > 3 THEN left(word, -2) END, CASE WHEN word LIKE '%ied' AND length(word) > 3 THEN concat(left(word, -3), 'y') END,
  CASE WHEN word LIKE '%es' AND length(word) > 3 THEN left(word, -2) END, CASE WHEN word LIKE '%s' AND length(word) > 2 THEN left(word, -1) END,
  CASE WHEN word LIKE '%es' AND length(word) > 2 THEN left(word, -2) END, CASE WHEN word LIKE '%ing' AND length(word) > 4 THEN left(word, -3) END]) AS stem FROM w),
su AS (SELECT word, stem, min(i) AS i FROM st WHERE stem IS NOT NULL AND stem <> word GROUP BY 1, 2),
n AS (SELECT word, string_agg(concat(candidate, ':', distance), ';' ORDER BY rank) AS nearest_neighbors, min(distance) AS min_neighbor_distance FROM k2 WHERE rank <= 5 GROUP BY 1)
SELECT w.word, w.word IN (SELECT word FROM r) AS exact_english, w.word IN (SELECT word FROM c) AS exact_controlled,
  coalesce((SELECT string_agg(stem, ';' ORDER BY i) FROM su WHERE su.word = w.word AND stem IN (SELECT word FROM r)), '') AS english_stem_overlap,
  coalesce((SELECT string_agg(stem, ';' ORDER BY i) FROM su WHERE su.word = w.word AND stem IN (SELECT word FROM c)), '') AS controlled_stem_overlap,
  coalesce(n.nearest_neighbors, '') AS nearest_neighbors, n.min_neighbor_distance FROM w LEFT JOIN n ON w.word = n.word""".replace(
        "n AS (SELECT word, string_agg",
        """rr AS (SELECT word FROM r UNION SELECT word FROM c), bb AS (SELECT DISTINCT substr(word, 1, 1) AS i, length(word) AS n FROM rr),
ll AS (SELECT word FROM w WHERE NOT EXISTS (SELECT 1 FROM bb WHERE bb.i = substr(w.word, 1, 1) AND abs(bb.n - length(w.word)) <= 2)),
pp AS (SELECT w.word, rr.word AS candidate, levenshtein(w.word, rr.word) AS distance FROM w JOIN rr ON substr(w.word, 1, 1) = substr(rr.word, 1, 1) AND abs(length(w.word) - length(rr.word)) <= 2 AND w.word <> rr.word
  UNION ALL SELECT ll.word, rr.word, levenshtein(ll.word, rr.word) FROM ll JOIN rr ON abs(length(ll.word) - length(rr.word)) <= 2 AND ll.word <> rr.word),
k2 AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, abs(length(candidate) - length(word)), candidate) AS rank FROM pp WHERE distance <= 2),
n AS (SELECT word, string_agg""",
    ),
)
def _(t):
    return neighbors.lexicon_audit(
        vocabulary(t.documents), vocabulary(t.benchmark), vocabulary(t.conversations)
    )


@query(
    "tx49_question_variants",
    """WITH x AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 'Who spoke, {role}?' ELSE 'What came next?' END AS own FROM conversations),
v AS (SELECT *, unnest(list_distinct([own, 'What came next?', 'Turn {turn} of {nobody}?'])) AS tpl FROM x)
SELECT conv_id, turn, CASE tpl WHEN 'Who spoke, {role}?' THEN concat('Who spoke, ', role, '?') ELSE tpl END AS question,
  CAST(CASE WHEN tpl = own THEN 0 WHEN tpl = 'What came next?' THEN 1 WHEN own = 'What came next?' THEN 1 ELSE 2 END AS BIGINT) AS template_rank FROM v""",
)
def _(t):
    own = F.when(F.col("turn") == 0, "Who spoke, {role}?").otherwise("What came next?")
    rows = t.conversations.select("conv_id", "turn", "role", own.alias("own"))
    extra = ["What came next?", "", "Turn {turn} of {nobody}?"]
    return joins.question_variants(rows, "own", extra, {"role": "role", "turn": "turn"}).select(
        "conv_id", "turn", "question", "template_rank"
    )

