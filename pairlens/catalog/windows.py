"""Order inside groups, centring, picks, sorts and limits."""

from pyspark.sql import functions as F

from ..functions import clean, fixed, text
from ..operators import effects, ranking, summaries, vectors
from .aggregates import people_pool
from .registry import query

_FAM = "CASE WHEN {0} = 'the' THEN 'def' WHEN {0} IN ('a', 'an') THEN 'indef' ELSE 'unknown' END"
CELL = f"""concat({_FAM.format("split_part(ta, ' ', 1)")}, '_', CASE split_part(tp, ' ', 3) WHEN 'is' THEN 'present' ELSE 'past' END)"""
ROLE = f"""CASE WHEN (row_number() OVER (PARTITION BY {CELL} ORDER BY item_index) - 1) % 2 = 0 THEN 'agent_first' ELSE 'patient_first' END"""


@query("w01_counterbalance", f"SELECT item_index, {CELL} AS cell, {ROLE} AS role_order FROM quartets")
def _(t):
    rows = t.quartets().select(
        "item_index", text.cell(text.parse_active("ta"), text.parse_passive("tp")).alias("cell")
    )
    return ranking.counterbalance(rows, ["cell"], "item_index", width=1000)


@query(
    "w02_zscore_by_group",
    """SELECT item_id, line_no, R6((active_choice_logprob - avg(active_choice_logprob) OVER w) / nullif(stddev_samp(active_choice_logprob) OVER w, 0)) AS z
FROM item_scores WINDOW w AS (PARTITION BY model_condition, lexicality_condition, prime_condition)""",
)
def _(t):
    by = ["model_condition", "lexicality_condition", "prime_condition"]
    return ranking.zscore(t.item_scores(), "active_choice_logprob", by, name="z").select(
        "item_id", "line_no", "z"
    )


@query(
    "w03_zscore_global",
    """SELECT o_orderkey, R6((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()) AS z1,
  R6((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()) AS z0, 0.0::DOUBLE AS flat FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", F.lit(2.5).alias("same"))
    rows = ranking.zscore(rows, "o_totalprice", name="z1")
    rows = ranking.zscore(rows, "o_totalprice", ddof=0, name="z0")
    return ranking.zscore(rows, "same", ddof=0, zero=True, name="flat").select(
        "o_orderkey", "z1", "z0", "flat"
    )


SHIFT = """SELECT model_condition, lexicality_condition, item_id, prime_type, 'no_prime' AS baseline_condition, R6(b) AS baseline_logodds_passive, R6(v) AS primed_logodds_passive,
  R6(v - b) AS shift_from_no_prime FROM (SELECT model_condition, lexicality_condition, item_id, prime_condition AS prime_type, avg(passive_choice_logprob - active_choice_logprob) AS v
  FROM item_scores WHERE prime_condition IN ('active', 'passive') GROUP BY ALL) p
JOIN (SELECT model_condition, lexicality_condition, item_id, avg(passive_choice_logprob - active_choice_logprob) AS b FROM item_scores WHERE prime_condition = 'no_prime' GROUP BY ALL) n
USING (model_condition, lexicality_condition, item_id)"""
UNIT = ["model_condition", "lexicality_condition", "item_id"]


def shifts(t, **options):
    rows = t.item_scores().withColumn(
        "logodds_passive", F.col("passive_choice_logprob") - F.col("active_choice_logprob")
    )
    return effects.baseline_shift(rows, UNIT, **options)


@query("w04_baseline_shift", SHIFT)
def _(t):
    return shifts(t)


@query(
    "w05_first_exemplar",
    f"""SELECT s.model_condition, s.lexicality_condition, s.item_id, s.prime_type, s.shift_from_no_prime, f.role_order, f.line_no
FROM ({SHIFT}) s JOIN (SELECT *, row_number() OVER (PARTITION BY model_condition, lexicality_condition, item_id ORDER BY line_no, ts, active_choice_logprob, role_order) AS rn FROM item_scores) f
ON s.model_condition = f.model_condition AND s.lexicality_condition = f.lexicality_condition AND s.item_id = f.item_id AND f.rn = 1""",
)
def _(t):
    order = ["line_no", "ts", "active_choice_logprob", "role_order"]
    return shifts(t, carry=["role_order", "line_no"], row_order=order).select(
        *UNIT, "prime_type", "shift_from_no_prime", "role_order", "line_no"
    )


@query(
    "w06_best_per_key",
    """SELECT l_partkey, arg_min(l_suppkey, -l_extendedprice * 1000000 + l_orderkey / 1000000.0) AS l_suppkey, max(l_extendedprice) AS l_extendedprice
FROM lineitem GROUP BY 1""",
)
def _(t):
    order = [(-F.col("l_extendedprice") * 1000000 + F.col("l_orderkey") / 1000000.0)]
    return ranking.best_per_key(t.lineitem, ["l_partkey"], order, ["l_suppkey", "l_extendedprice"])


@query(
    "w07_topk_per_key",
    """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) r WHERE rank <= 5""",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.topk_per_key(
        rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5
    )


_POOL = "[" + ", ".join(f"'{s}'" for s in fixed.CORE_FILLERS) + "]"


@query(
    "w08_round_robin",
    f"SELECT item_index, ({_POOL})[item_index % {len(fixed.CORE_FILLERS)} + 1] AS filler FROM quartets",
)
def _(t):
    return t.quartets().select(
        "item_index", text.round_robin(fixed.CORE_FILLERS, "item_index").alias("filler")
    )


SEEDED_PICK = f"""(SELECT *, CASE WHEN len(k0) > 0 THEN k0 ELSE {_POOL} END AS k FROM (SELECT *, list_filter({_POOL}, lambda s: NOT list_has_any(string_split(lower(replace(s, ' .', '')), ' '),
  [split_part(ta, ' ', 2), split_part(ta, ' ', 5)])) AS k0 FROM quartets) x) y"""
PICKED = "k[CAST(CAST('0x' || substr(md5(concat('13|', item_index)), 1, 8) AS BIGINT) % len(k) AS INT) + 1]"


@query("w09_seeded_pick", f"SELECT item_index, {PICKED} AS filler FROM {SEEDED_PICK}")
def _(t):
    ta = text.parse_active("ta")
    pick = ranking.seeded_pick(
        fixed.CORE_FILLERS, 13, "item_index", F.array(ta["agent"], ta["patient"])
    )
    return t.quartets().select("item_index", pick.alias("filler"))


_NUMBERED = """p AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS position, count(*) OVER () AS n
  FROM (SELECT DISTINCT unnest([split_part(pa, ' ', 2), split_part(pa, ' ', 5), split_part(ta, ' ', 2), split_part(ta, ' ', 5)]) AS word FROM quartets) w)"""


@query(
    "w10_rotating_pick",
    f"""WITH {_NUMBERED}, c AS (SELECT q.item_index, p.word, (p.position - (q.item_index * 7) % p.n + p.n) % p.n AS step FROM quartets q JOIN p
  ON p.word NOT IN (split_part(pa, ' ', 2), split_part(pa, ' ', 5), split_part(ta, ' ', 2), split_part(ta, ' ', 5))),
r AS (SELECT *, row_number() OVER (PARTITION BY item_index ORDER BY step) AS k FROM c)
SELECT item_index, string_agg(word, ';' ORDER BY step) AS picks FROM r WHERE k <= 2 GROUP BY 1""",
)
def _(t):
    used = F.array(*[text.parse_active(c)[r] for c in ("pa", "ta") for r in ("agent", "patient")])
    picked = ranking.rotating_pick(
        t.quartets(), ["item_index"], used, F.col("item_index") * 7, F.lit(2), people_pool(t)
    )
    return picked.select("item_index", F.array_join("picks", ";").alias("picks"))


@query(
    "w11_offset_row",
    """SELECT a.item_index, b.ta AS filler FROM quartets a JOIN quartets b ON b.item_index = (a.item_index + 137) % (SELECT count(*) FROM events)""",
)
def _(t):
    return ranking.offset_row(t.quartets(), "item_index", "ta", 137, "filler").select(
        "item_index", "filler"
    )


@query(
    "w12_first_in_word",
    """SELECT item_index, target_structure, word_index, min(token_index) AS first_token_index FROM token_rows GROUP BY 1, 2, 3""",
)
def _(t):
    return ranking.first_in_word(
        t.token_rows(), ["item_index", "target_structure"], "word_index", "token_index"
    )


# ---- sorts and limits -------------------------------------------------------


@query(
    "sl01_sorted_summary",
    """SELECT model_condition, prime_condition, count(*) AS n_rows FROM item_scores GROUP BY 1, 2 ORDER BY 1, 2""",
)
def _(t):
    by = ["model_condition", "prime_condition"]
    return t.item_scores().groupBy(*by).agg(F.count("*").alias("n_rows")).orderBy(*by)


@query(
    "sl02_order_by_levels",
    """SELECT prime_condition_raw, n, CAST(CASE prime_condition_raw WHEN 'active' THEN 0 WHEN 'filler' THEN 1 ELSE 4 END AS BIGINT) AS place
FROM (SELECT prime_condition_raw, count(*) AS n FROM item_scores GROUP BY 1) c ORDER BY place, prime_condition_raw""",
)
def _(t):
    counts = t.item_scores().groupBy("prime_condition_raw").agg(F.count("*").alias("n"))
    ordered = summaries.order_by_levels(
        counts, {"prime_condition_raw": fixed.PRIME_ORDER}, "prime_condition_raw"
    )
    return ordered.withColumn("place", clean.level_rank("prime_condition_raw", fixed.PRIME_ORDER))


@query(
    "sl03_mixed_sort",
    """SELECT model_condition, prime_condition, count(*) AS n FROM item_scores GROUP BY 1, 2 ORDER BY model_condition, n DESC, prime_condition""",
)
def _(t):
    counts = t.item_scores().groupBy("model_condition", "prime_condition").agg(F.count("*").alias("n"))
    return counts.orderBy(F.asc("model_condition"), F.desc("n"), F.asc("prime_condition"))


@query("sl04_take_items", "SELECT item_index, ta, tp FROM quartets WHERE item_index < 512")
def _(t):
    return ranking.take_items(t.quartets(), "item_index", 512).select("item_index", "ta", "tp")


@query(
    "sl05_sample_items",
    "SELECT item_index, ta FROM quartets ORDER BY md5(concat('13|', item_index)), item_index LIMIT 256",
)
def _(t):
    return ranking.sample_items(t.quartets(), "item_index", 256, 13).select("item_index", "ta")


@query(
    "sl06_preview",
    """SELECT item_index, ta, pa FROM quartets WHERE split_part(ta, ' ', 2) = split_part(pa, ' ', 2) ORDER BY item_index LIMIT 5""",
)
def _(t):
    from ..operators import validate

    same = text.parse_active("ta")["agent"] == text.parse_active("pa")["agent"]
    return validate.preview(t.quartets(), same, ["item_index"]).select("item_index", "ta", "pa")


@query(
    "ar18_center_vectors",
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, i, R6(x - avg(x) OVER (PARTITION BY i)) AS x FROM e""",
)
def _(t):
    rows = vectors.center_vectors(t.embeddings, "embedding")
    return rows.select("vec_id", F.posexplode("centered").alias("i", "x"))


@query(
    "ar18_mean_pool",
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, i, R6(avg(x)) AS x FROM e GROUP BY 1, 2""",
)
def _(t):
    rows = vectors.mean_pool(t.embeddings, ["label"], "embedding")
    return rows.select("label", F.posexplode("embedding").alias("i", "x"))


_COS = """WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.vec_id AS query, b.vec_id AS reference, list_cosine_similarity(a.e, b.e) AS s
  FROM q a JOIN q b ON {on}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, reference) AS k FROM c)
SELECT CAST(query AS VARCHAR) AS query, R6(max(s)) AS max_cosine, R6(avg(s)) AS mean_topk_cosine,
  string_agg(concat(reference, ':', printf('%.4f', s)), ';' ORDER BY s DESC, reference) AS nearest_neighbors FROM r WHERE k <= 5 GROUP BY 1"""


@query("ar19_cosine_topk", _COS.format(on="a.label = 0 AND b.label <> 0"))
def _(t):
    e = t.embeddings
    return vectors.cosine_topk(e.where("label = 0"), e.where("label <> 0"), "vec_id", "embedding", 5)


@query("ar20_leave_one_out", _COS.format(on="a.vec_id <> b.vec_id"))
def _(t):
    e = t.embeddings
    return vectors.cosine_topk(e, e, "vec_id", "embedding", 5, exclude_self=True)


@query(
    "j10_cosine_neighbors",
    """WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT CAST(a.vec_id AS VARCHAR) AS query, CAST(b.vec_id AS VARCHAR) AS reference,
  list_cosine_similarity(a.e, b.e) AS s FROM q a JOIN q b ON a.label = 0 AND b.label <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, reference) AS rank FROM c)
SELECT query, reference, R6(s) AS cosine, rank FROM r WHERE rank <= 10""",
)
def _(t):
    e = t.embeddings
    return vectors.cosine_neighbors(
        e.where("label = 0"), e.where("label <> 0"), "vec_id", "embedding", 10, block=128
    )

