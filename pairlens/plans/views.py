"""Input bindings: the given tables shaped as score, sentence and answer tables.

``SHARED_SQL`` is read by both engines; the lists and expansions below it are written
for Spark with array functions, so no binding joins a literal table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PEOPLE = (
    "baker captain doctor farmer judge lawyer nurse painter pilot poet singer teacher waiter "
    "guard clerk guest"
)
_VERBS_S = "asks follows helps joins pushes visits greets calls"
_VERBS_ED = "asked followed helped joined pushed visited greeted called"

SHARED_SQL = {
    "item_scores": """
SELECT l.l_orderkey AS item_id, CAST(l.l_linenumber AS BIGINT) AS line_no, l.l_shipdate AS ts,
  l.l_orderkey * 10 + l.l_linenumber AS row_id,
  o.o_orderpriority AS model_condition,
  CASE o.o_orderstatus WHEN 'O' THEN 'core' WHEN 'F' THEN 'jabberwocky' ELSE 'mixed' END AS lexicality_condition,
  CASE l.l_linenumber % 4 WHEN 1 THEN 'active' WHEN 2 THEN 'passive_prime' WHEN 3 THEN 'filler' ELSE 'no_demo' END AS prime_condition_raw,
  CASE l.l_linenumber % 4 WHEN 1 THEN 'active' WHEN 2 THEN 'passive' WHEN 3 THEN 'filler' ELSE 'no_prime' END AS prime_condition,
  CASE WHEN l.l_returnflag = 'A' THEN 'agent_first' ELSE 'patient_first' END AS role_order,
  CAST(floor(l.l_quantity) AS BIGINT) % 5 + 5 AS active_target_token_count,
  CAST(floor(l.l_quantity) AS BIGINT) % 4 + 7 AS passive_target_token_count,
  -(l.l_discount * 10 + 1) AS active_choice_logprob,
  -(l.l_tax * 10 + 1) AS passive_choice_logprob
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""",
    "doc_tokens": """
SELECT d.doc_id, d.lang AS model_condition, d.source AS dataset,
  CASE d.doc_id % 4 WHEN 1 THEN 'active' WHEN 2 THEN 'passive' WHEN 3 THEN 'filler' ELSE 'no_prime' END AS prime_condition,
  regexp_extract_all(lower(d.text), '([a-z]+|[.?!])', 1) AS tokens
FROM documents d
""",
    "quartets": f"""
SELECT event_id AS item_index,
  concat(CASE WHEN det = 1 THEN 'the' ELSE 'a' END, ' ', ta_a, ' ', CASE WHEN past = 1 THEN verb_ed ELSE verb_s END, ' ', CASE WHEN det = 1 THEN 'the' ELSE 'a' END, ' ', ta_p, ' .') AS ta,
  concat(CASE WHEN det = 1 THEN 'the' ELSE 'a' END, ' ', ta_p, ' ', CASE WHEN past = 1 THEN 'was' ELSE 'is' END, ' ', verb_ed, ' by ', CASE WHEN det = 1 THEN 'the' ELSE 'a' END, ' ', ta_a, ' .') AS tp,
  concat(CASE WHEN det = 0 THEN 'the' ELSE 'a' END, ' ', pa_a, ' ', CASE WHEN past = 0 THEN pverb_ed ELSE pverb_s END, ' ', CASE WHEN det = 0 THEN 'the' ELSE 'a' END, ' ', pa_p, ' .') AS pa,
  concat(CASE WHEN det = 0 THEN 'the' ELSE 'a' END, ' ', pa_p, ' ', CASE WHEN past = 0 THEN 'was' ELSE 'is' END, ' ', pverb_ed, ' by ', CASE WHEN det = 0 THEN 'the' ELSE 'a' END, ' ', pa_a, ' .') AS pp
FROM (
  SELECT event_id, event_id % 2 AS det, CAST(floor(event_id / 2) AS BIGINT) % 2 AS past,
    split_part('{_PEOPLE}', ' ', CAST(user_id % 16 + 1 AS INT)) AS ta_a,
    split_part('{_PEOPLE}', ' ', CAST((user_id + 1 + event_id % 15) % 16 + 1 AS INT)) AS ta_p,
    split_part('{_PEOPLE}', ' ', CAST((user_id + event_id * 3 + 5) % 16 + 1 AS INT)) AS pa_a,
    split_part('{_PEOPLE}', ' ', CAST((user_id + event_id * 3 + 8) % 16 + 1 AS INT)) AS pa_p,
    split_part('{_VERBS_S}', ' ', CAST(event_id % 8 + 1 AS INT)) AS verb_s,
    split_part('{_VERBS_ED}', ' ', CAST(event_id % 8 + 1 AS INT)) AS verb_ed,
    split_part('{_VERBS_S}', ' ', CAST((event_id * 5 + 3) % 8 + 1 AS INT)) AS pverb_s,
    split_part('{_VERBS_ED}', ' ', CAST((event_id * 5 + 3) % 8 + 1 AS INT)) AS pverb_ed
  FROM events) e
""",
}

_GENERATED = """CASE (item_index * 7 + k) % 6 WHEN 0 THEN ta WHEN 1 THEN tp
  WHEN 2 THEN concat('the ', split_part(tp, ' ', 2), ' was ', split_part(tp, ' ', 4), ' .')
  WHEN 3 THEN concat('the ', split_part(tp, ' ', 2), ' was happy .')
  WHEN 4 THEN concat('the one who did it was the ', split_part(ta, ' ', 2), ' .')
  ELSE concat('the ', split_part(ta, ' ', 2), ' waited, and the ', split_part(ta, ' ', 5), ' left .') END"""
_ANSWER = """CASE (item_index + pk * 3 + vk) % 4 WHEN 0 THEN concat('Answer: The doer was the ', split_part(ta, ' ', 2), '. And more')
  WHEN 1 THEN concat('the ', split_part(ta, ' ', 5)) WHEN 2 THEN concat('The ', split_part(ta, ' ', 2), ' and the ', split_part(ta, ' ', 5)) ELSE 'someone else' END"""

# The same bindings for the checking engine, which has other list functions.
CHECK_SQL = {
    **SHARED_SQL,
    "generations": f"""
SELECT item_index, concat('prompt_', prime_condition) AS prompt_column, prime_condition,
  CASE WHEN item_index % 2 = 0 THEN 'agent_first' ELSE 'patient_first' END AS role_order,
  ta AS target_active, tp AS target_passive, {_GENERATED} AS generated
FROM quartets CROSS JOIN (SELECT 0 AS k, 'active' AS prime_condition UNION ALL SELECT 1, 'filler' UNION ALL SELECT 2, 'no_prime' UNION ALL SELECT 3, 'passive') c
""",
    "role_answers": f"""
SELECT item_index, prime_condition, target_voice, question_type,
  CASE WHEN item_index % 3 = 0 THEN 'core' ELSE 'jabberwocky' END AS lexicality_condition,
  CASE WHEN question_type = 'doer' THEN split_part(ta, ' ', 2) ELSE split_part(ta, ' ', 5) END AS correct_head,
  CASE WHEN question_type = 'doer' THEN split_part(ta, ' ', 5) ELSE split_part(ta, ' ', 2) END AS foil_head,
  {_ANSWER} AS answer_raw
FROM quartets
CROSS JOIN (SELECT 0 AS pk, 'active' AS prime_condition UNION ALL SELECT 1, 'passive' UNION ALL SELECT 2, 'filler' UNION ALL SELECT 3, 'no_prime') p
CROSS JOIN (SELECT 0 AS vk, 'active' AS target_voice, 'doer' AS question_type UNION ALL SELECT 1, 'passive', 'doer' UNION ALL SELECT 2, 'active', 'acted_on' UNION ALL SELECT 3, 'passive', 'acted_on') v
""",
    "pieces": """
SELECT item_index, CASE item_index % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'jabberwocky' ELSE 'mixed' END AS condition,
  target_structure, target_text, paired_text,
  flatten(list_transform(string_split(target_text, ' '), lambda w: CASE WHEN length(w) > 4 THEN [substr(w, 1, 4), substr(w, 5)] ELSE [w] END)) AS tokens
FROM (SELECT item_index, 'active' AS target_structure, ta AS target_text, tp AS paired_text FROM quartets
  UNION ALL SELECT item_index, 'passive', tp, ta FROM quartets) s
""",
    "token_lists": """
SELECT item_index, condition, target_structure, target_text, paired_text, tokens,
  list_transform(tokens, lambda w, i: -(length(w) * 0.25 + (item_index % 11) * 0.125 + (i - 1) * 0.0625)) AS congruent,
  list_transform(tokens, lambda w, i: -(length(w) * 0.375 + (item_index % 13) * 0.0625)) AS incongruent
FROM pieces
""",
    "scored_pairs": """
SELECT a.item_index, a.condition AS lexicality_condition,
  CASE a.item_index % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'passive' WHEN 2 THEN 'filler' ELSE 'no_prime' END AS prime_condition,
  'active_completion' AS candidate_a_label, 'passive_completion' AS candidate_b_label,
  a.target_text AS candidate_a_text, b.target_text AS candidate_b_text,
  a.tokens AS candidate_a_tokens, b.tokens AS candidate_b_tokens,
  a.congruent AS candidate_a_token_logprobs, b.congruent AS candidate_b_token_logprobs
FROM token_lists a JOIN token_lists b ON a.item_index = b.item_index AND a.target_structure = 'active' AND b.target_structure = 'passive'
""",
    "token_rows": """
SELECT item_index, condition, target_structure, target_text, token_index, token, congruent_log_prob, incongruent_log_prob,
  congruent_log_prob - incongruent_log_prob AS token_pe, word_index
FROM (SELECT *, unnest(tokens) AS token, unnest(congruent) AS congruent_log_prob, unnest(incongruent) AS incongruent_log_prob,
  unnest(flatten(list_transform(string_split(target_text, ' '), lambda w, i: CASE WHEN length(w) > 4 THEN [i - 1, i - 1] ELSE [i - 1] END))) AS word_index,
  generate_subscripts(tokens, 1) - 1 AS token_index FROM token_lists) u
""",
}
VIEW_NEEDS = {
    "generations": ("quartets",),
    "role_answers": ("quartets",),
    "pieces": ("quartets",),
    "token_lists": ("pieces",),
    "scored_pairs": ("token_lists",),
    "token_rows": ("token_lists",),
}


#: Each row can become eight, at up to a millisecond each: a task then takes a few minutes at most.
ROWS_A_TASK = 25_000


class Tables:
    """The given parquet tables and the bindings over them."""

    names = (
        "region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations"
    ).split()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.root = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in type(self).names:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        raise AttributeError(name)

    def _parallel(self, table: str) -> DataFrame:
        """A table whose rows meet costly expressions. One stored in few parts is spread over the session's
        shuffle partitions (or cores), and over more where a task would get above ``ROWS_A_TASK`` rows, so
        that a task's share grows neither with the table nor with fewer cores."""
        df = getattr(self, table)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(parts, self.spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
        return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df

    def _shared(self, view: str, *tables: str) -> DataFrame:
        sql = SHARED_SQL[view]
        for t in tables:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        read = getattr if len(tables) > 1 else type(self)._parallel
        return self.spark.sql(sql, **{t: read(self, t) for t in tables})

    def item_scores(self) -> DataFrame:
        return self._shared("item_scores", "lineitem", "orders")

    def doc_tokens(self) -> DataFrame:
        return self._shared("doc_tokens", "documents")

    def quartets(self) -> DataFrame:
        return self._shared("quartets", "events")

    def generations(self) -> DataFrame:
        names = ("active", "filler", "no_prime", "passive")
        rows = self.quartets().select(
            "*", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("k", "prime_condition")
        )
        return rows.selectExpr(
            "item_index",
            "concat('prompt_', prime_condition) AS prompt_column",
            "prime_condition",
            "CASE WHEN item_index % 2 = 0 THEN 'agent_first' ELSE 'patient_first' END AS role_order",
            "ta AS target_active",
            "tp AS target_passive",
            f"{_GENERATED} AS generated",
        )

    def role_answers(self) -> DataFrame:
        primes = ("active", "passive", "filler", "no_prime")
        asks = [("active", "doer"), ("passive", "doer"), ("active", "acted_on"), ("passive", "acted_on")]
        pairs = F.array(
            *[F.struct(F.lit(v).alias("target_voice"), F.lit(q).alias("question_type")) for v, q in asks]
        )
        rows = self.quartets().select(
            "*", F.posexplode(F.array(*[F.lit(p) for p in primes])).alias("pk", "prime_condition")
        )
        rows = rows.select("*", F.posexplode(pairs).alias("vk", "v")).select("*", "v.*")
        return rows.selectExpr(
            "item_index", "prime_condition", "target_voice", "question_type",
            "CASE WHEN item_index % 3 = 0 THEN 'core' ELSE 'jabberwocky' END AS lexicality_condition",
            "CASE WHEN question_type = 'doer' THEN split_part(ta, ' ', 2) ELSE split_part(ta, ' ', 5) END AS correct_head",
            "CASE WHEN question_type = 'doer' THEN split_part(ta, ' ', 5) ELSE split_part(ta, ' ', 2) END AS foil_head",
            f"{_ANSWER} AS answer_raw",
        )

    def pieces(self) -> DataFrame:
        sides = F.array(
            F.struct(F.lit("active").alias("target_structure"), F.col("ta").alias("target_text"),
                     F.col("tp").alias("paired_text")),
            F.struct(F.lit("passive").alias("target_structure"), F.col("tp").alias("target_text"),
                     F.col("ta").alias("paired_text")),
        )
        rows = self.quartets().select("item_index", F.explode(sides).alias("s")).select("item_index", "s.*")
        return rows.selectExpr(
            "item_index",
            "CASE item_index % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'jabberwocky' ELSE 'mixed' END AS condition",
            "target_structure", "target_text", "paired_text",
            "flatten(transform(split(target_text, ' '), w -> CASE WHEN length(w) > 4 THEN array(substr(w, 1, 4), substr(w, 5)) ELSE array(w) END)) AS tokens",
        )

    def token_lists(self) -> DataFrame:
        return self.pieces().selectExpr(
            "*",
            "transform(tokens, (w, i) -> CAST(-(length(w) * 0.25D + (item_index % 11) * 0.125D + i * 0.0625D) AS DOUBLE)) AS congruent",
            "transform(tokens, (w, i) -> CAST(-(length(w) * 0.375D + (item_index % 13) * 0.0625D) AS DOUBLE)) AS incongruent",
        )

    def scored_pairs(self) -> DataFrame:
        """One row per item with both candidates: gathered by an aggregation on the item."""
        rows = self.token_lists()
        cell = F.struct("target_text", "tokens", "congruent")
        sides = rows.groupBy("item_index", "condition").agg(
            *[
                F.max_by(cell, F.col("target_structure") == s).alias(s) for s in ("active", "passive")
            ]
        )
        out = [
            "item_index", F.col("condition").alias("lexicality_condition"),
            F.expr("CASE item_index % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'passive' WHEN 2 THEN 'filler' ELSE 'no_prime' END").alias("prime_condition"),
        ]
        for slot, side in (("a", "active"), ("b", "passive")):
            out += [
                F.lit(f"{side}_completion").alias(f"candidate_{slot}_label"),
                F.col(f"{side}.target_text").alias(f"candidate_{slot}_text"),
                F.col(f"{side}.tokens").alias(f"candidate_{slot}_tokens"),
                F.col(f"{side}.congruent").alias(f"candidate_{slot}_token_logprobs"),
            ]
        return sides.select(*out)

    def token_rows(self, words: bool = True) -> DataFrame:
        """One row per token. ``words=False`` leaves out ``word_index``, by far the costliest column."""
        from ..functions import arrays

        rows = self.token_lists().withColumn("__pe", arrays.token_pe("congruent", "incongruent"))
        if words:
            rows = rows.withColumn("__w", arrays.align_tokens("tokens", F.split("target_text", " ")))
        zipped = F.arrays_zip(
            F.col("tokens").alias("token"), F.col("congruent").alias("congruent_log_prob"),
            F.col("incongruent").alias("incongruent_log_prob"), F.col("__pe").alias("token_pe"),
            *([F.col("__w").alias("word_index")] if words else []),
        )
        return rows.select(
            "item_index", "condition", "target_structure", "target_text",
            F.posexplode(zipped).alias("token_index", "z"),
        ).select(
            "item_index", "condition", "target_structure", "target_text", "token_index",
            *[
                F.col("z").getField(i).alias(i)
                for i in ("token", "congruent_log_prob", "incongruent_log_prob", "token_pe", *(["word_index"] if words else []))
            ],
        )
