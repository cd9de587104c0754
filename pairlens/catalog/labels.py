"""Sentence labels, review queue and overlay, scored answers and generations."""

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import review
from .aggregates import labelled
from .registry import query
from .texts import NORMAL

# Which of the six generated forms a row of the binding has.
_K = """(item_index * 7 + CASE prime_condition WHEN 'active' THEN 0 WHEN 'filler' THEN 1 WHEN 'no_prime' THEN 2 ELSE 3 END) % 6"""
_G = f"(SELECT *, {_K} AS k FROM generations) g"
KEYS = ["item_index", "prime_condition"]


@query(
    "tx19_classify_structure",
    """SELECT item_index, prime_condition, CASE WHEN generated = target_active THEN 'active_exact' WHEN generated = target_passive THEN 'passive_exact' ELSE 'other' END AS plain,
  CASE WHEN generated = target_active THEN 'active_prefix' WHEN generated = target_passive THEN 'passive_prefix' ELSE 'other' END AS longer, 'active_structural' AS adverb, 'passive_structural' AS adverb_passive FROM generations""",
)
def _(t):
    def classify(sentence):
        return labels.classify_structure(sentence, prepared="targets")

    moved = F.regexp_replace("target_active", r"^(\S+ \S+) ", "$1 quickly ")
    moved_passive = F.regexp_replace("target_passive", " by ", " quickly by ")
    rows = t.generations().withColumn("targets", labels.prepared_targets("target_active", "target_passive"))
    return rows.select(
        *KEYS,
        classify("generated").alias("plain"),
        classify(F.concat("generated", F.lit(" and more"))).alias("longer"),
        classify(moved).alias("adverb"),
        classify(moved_passive).alias("adverb_passive"),
    )


_TOKENS = "array_to_string(regexp_extract_all(lower(generated), '[a-z'']+'), ' ')"


@query(
    "tx20_detect_passive",
    f"""SELECT item_index, prime_condition, CASE WHEN k = 1 THEN 'passive_by' WHEN k = 2 THEN 'passive_short' END AS label, CASE WHEN k = 1 THEN 'be_participle_by' WHEN k = 2 THEN 'be_participle_no_by' END AS reason FROM {_G}""",
)
def _(t):
    p = labels.detect_passive("tokens")
    rows = t.generations().withColumn("tokens", labels.token_text("generated"))
    return rows.select(*KEYS, p["label"].alias("label"), p["reason"].alias("reason"))


@query(
    "tx20_detect_passive_documents",
    r"""WITH b AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'the man was not ' WHEN 1 THEN 'they are being ' WHEN 2 THEN 'she got ' ELSE 'it is ' END, w, ' ', CASE WHEN doc_id % 3 = 0 THEN 'by us' ELSE 'now' END) AS s, w
  FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) x),
p AS (SELECT *, (length(w) > 3 AND (w LIKE '%ed' OR w LIKE '%en')) OR w IN ('beaten','bent','bound','brought','built','bought','caught','chosen','done','driven','eaten','fallen','felt','found','forgiven','forgotten','given','gone','heard','held','hit','hurt','kept','known','left','lost','made','met','paid','put','read','run','said','seen','sent','shot','sold','spent','struck','taught','told','understood','won','written') AS part FROM b)
SELECT doc_id, w, CASE WHEN NOT part THEN NULL WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'passive_progressive_by' ELSE 'passive_progressive_short' END WHEN doc_id % 3 = 0 THEN 'passive_by' ELSE 'passive_short' END AS label FROM p""",
)
def _(t):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    rows = t.documents.select("doc_id", F.explode(F.array_distinct(found)).alias("w"))
    k = F.col("doc_id") % 4
    head = (
        F.when(k == 0, "the man was not ").when(k == 1, "they are being ").when(k == 2, "she got ").otherwise("it is ")
    )
    tail = F.when(F.col("doc_id") % 3 == 0, " by us").otherwise(" now")
    return rows.select("doc_id", "w", labels.detect_passive(F.concat(head, "w", tail))["label"].alias("label"))


@query(
    "tx21_detect_copular",
    f"""SELECT item_index, prime_condition, CASE k WHEN 3 THEN 'copular_adjectival' WHEN 4 THEN 'copular_nominal' WHEN 2 THEN 'copular_participial' END AS label FROM {_G}""",
)
def _(t):
    rows = t.generations().withColumn("tokens", labels.token_text("generated"))
    return rows.select(*KEYS, labels.detect_copular("tokens")["label"].alias("label"))


@query(
    "tx21_detect_copular_documents",
    r"""WITH b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT doc_id, w, CASE WHEN w IN ('not','never','just','already','still','really','very','quite','too','also') THEN NULL WHEN w IN ('a','an','the','this','that','these','those','my','your','his','her','our','their') THEN 'copular_nominal'
  WHEN w IN ('by','to','for','with','near','behind','before','after','during','across','through','in','on','at','from','into','onto','over','under','around','between','without','within','of','as') THEN 'copular_prepositional'
  WHEN regexp_matches(w, '(ous|ful|ive|able|ible|less|al|ic|y)$') THEN 'copular_adjectival' WHEN regexp_matches(w, '..(ed|en)$') OR w IN ('beaten','bent','bound','brought','built','bought','caught','chosen','done','driven','eaten','fallen','felt','found','forgiven','forgotten','given','gone','heard','held','hit','hurt','kept','known','left','lost','made','met','paid','put','read','run','said','seen','sent','shot','sold','spent','struck','taught','told','understood','won','written') THEN 'copular_participial' END AS label
FROM b""",
)
def _(t):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    rows = t.documents.select("doc_id", F.explode(F.array_distinct(found)).alias("w"))
    shown = F.concat(F.lit("someone was "), "w", F.lit(" here"))
    return rows.select("doc_id", "w", labels.detect_copular(shown)["label"].alias("label"))


@query(
    "tx22_detect_active",
    f"""SELECT item_index, prime_condition, CASE k WHEN 0 THEN 'active_transitive' WHEN 5 THEN 'active_other' END AS label FROM {_G}""",
)
def _(t):
    rows = t.generations().withColumn("tokens", labels.token_text("generated"))
    return rows.select(*KEYS, labels.detect_active("tokens")["label"].alias("label"))


_DETAIL = """CASE k WHEN 0 THEN 'active_target_transitive_like' WHEN 1 THEN 'passive_target_by' WHEN 2 THEN 'passive_short' WHEN 3 THEN 'copular_adjectival' WHEN 4 THEN 'other_relative_identity_clause' ELSE 'other_coordinate_multiclause' END"""


@query(
    "tx23_label_structure",
    f"""SELECT item_index, prime_condition, {_DETAIL} AS generation_class_detailed, CASE WHEN k = 0 THEN 'active' WHEN k IN (1, 2) THEN 'passive' ELSE 'other' END AS generation_voice_auto,
  CASE k WHEN 0 THEN 'target_active_exact' WHEN 1 THEN 'target_passive_exact_by' WHEN 2 THEN 'be_participle_no_by' WHEN 3 THEN 'be_adjectival_predicate' WHEN 4 THEN 'one_who_did_it_pattern' ELSE 'coordination_with_punctuation' END AS generation_structure_reason FROM {_G}""",
)
def _(t):
    rows = labels.label_structure(t.generations(), "generated")
    return rows.select(
        *KEYS, "generation_class_detailed", "generation_voice_auto", "generation_structure_reason"
    )


@query(
    "tx24_label_arguments",
    f"""SELECT item_index, prime_condition, CASE k WHEN 0 THEN 'active_monotransitive_patient' WHEN 1 THEN 'passive_like' WHEN 2 THEN 'passive_like' WHEN 3 THEN 'copular_like' WHEN 4 THEN 'copular_like' ELSE 'multiclause' END AS argument_structure_inferred,
  CASE k WHEN 0 THEN 'agent>patient' WHEN 1 THEN 'patient>(agent)' WHEN 2 THEN 'patient>(agent)' WHEN 3 THEN 'theme>predicate' WHEN 4 THEN 'theme>predicate' ELSE 'mixed' END AS role_frame_inferred,
  CASE k WHEN 0 THEN 'object_inferred_as_patient_human' WHEN 1 THEN 'passive_pattern_detected' WHEN 2 THEN 'passive_pattern_detected' WHEN 3 THEN 'copular_pattern_detected' WHEN 4 THEN 'copular_pattern_detected' ELSE 'coordination_detected' END AS argument_inference_note FROM {_G}""",
)
def _(t):
    rows = labels.label_arguments(t.generations(), "generated")
    return rows.select(
        *KEYS, "argument_structure_inferred", "role_frame_inferred", "argument_inference_note"
    )


@query(
    "tx25_binary_class",
    f"""SELECT item_index, prime_condition, CASE WHEN k = 0 THEN 'active' WHEN k = 1 THEN 'passive' ELSE 'other' END AS generation_class_strict, CASE WHEN k = 0 THEN 'active' WHEN k IN (1, 2) THEN 'passive' ELSE 'other' END AS generation_class_lax,
  k NOT IN (0, 1) AS review_remaining_strict, k NOT IN (0, 1, 2) AS review_remaining_lax FROM {_G}""",
)
def _(t):
    return labelled(t).select(
        *KEYS, "generation_class_strict", "generation_class_lax", "review_remaining_strict", "review_remaining_lax"
    )


@query(
    "tx26_coordination_identity",
    f"SELECT item_index, prime_condition, k = 5 AS coordination, k = 4 AS identity FROM {_G}",
)
def _(t):
    rows = t.generations().withColumn("tokens", labels.token_text("generated"))
    return rows.select(
        *KEYS,
        text.has_coordination(F.split("tokens", " "), "generated").alias("coordination"),
        text.is_relative_identity(F.col("tokens")).alias("identity"),
    )


@query(
    "tx30_overlay_reviews",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE l.quality WHEN 1 THEN 'active' ELSE 'other' END ELSE d.lang END AS generation_class_strict_final,
  CASE WHEN l.toxic = 1 THEN 'passive' WHEN l.doc_id IS NOT NULL THEN '' ELSE d.source END AS generation_class_lax_final, l.doc_id IS NOT NULL AS manually_reviewed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    return review.overlay_reviews(
        *_overlay_inputs(t), ["doc_id"], ["generation_class_strict", "generation_class_lax"]
    ).select("doc_id", "generation_class_strict_final", "generation_class_lax_final", "manually_reviewed")


def _overlay_inputs(t):
    rows = t.documents.select(
        "doc_id", F.col("lang").alias("generation_class_strict"), F.col("source").alias("generation_class_lax"),
        (F.col("lang") == "en").alias("needed"),
    )
    reviews = t.labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, "active").otherwise("other").alias("reviewed_generation_class_strict"),
        F.when(F.col("toxic") == 1, "passive").otherwise("").alias("reviewed_generation_class_lax"),
    )
    return rows, reviews


@query(
    "tx30_overlay_needed_only",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND lang = 'en' THEN CASE l.quality WHEN 1 THEN 'active' ELSE 'other' END ELSE d.lang END AS generation_class_strict_final,
  CASE WHEN l.toxic = 1 AND lang = 'en' THEN 'passive' ELSE d.source END AS generation_class_lax_final, l.doc_id IS NOT NULL AND lang = 'en' AS manually_reviewed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    columns = ["generation_class_strict", "generation_class_lax"]
    rows, reviews = _overlay_inputs(t)
    out = review.overlay_reviews(rows, reviews, ["doc_id"], columns, "needed_only", "needed")
    return out.select("doc_id", "generation_class_strict_final", "generation_class_lax_final", "manually_reviewed")


@query(
    "tx31_review_queue",
    """WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS s FROM documents), b AS (SELECT substr(sha1(s), 1, 16) AS review_key, s, count(*) AS occurrence_count, min(doc_id) AS doc_id FROM d GROUP BY 1, 2),
v AS (SELECT DISTINCT substr(sha1(s), 1, 16) AS review_key, 'source' AS l, source AS x FROM d UNION SELECT DISTINCT substr(sha1(s), 1, 16), 'doc', CAST(doc_id AS VARCHAR) FROM d), r AS (SELECT * FROM v)
SELECT b.review_key, md5(b.s) AS digest, b.occurrence_count, b.doc_id, (SELECT string_agg(x, ';' ORDER BY x) FROM r WHERE r.review_key = b.review_key AND l = 'source') AS source_list,
  (SELECT string_agg(x, ';' ORDER BY x) FROM r WHERE r.review_key = b.review_key AND l = 'doc') AS doc_list FROM b""",
)
def _(t):
    rows = t.documents.select(
        "doc_id", F.col("doc_id").alias("doc"), "source",
        F.lower(text.compact("text")).alias("sentence"), text.review_key("text").alias("review_key"),
    )
    out = review.review_queue(rows, "review_key", "sentence", ["source", "doc"], ["doc_id"], ["doc_id"])
    return out.withColumn("digest", F.md5("sentence")).drop("sentence")


@query(
    "tx31_review_values",
    """WITH d AS (SELECT doc_id, source, substr(sha1(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 16) AS review_key FROM documents)
SELECT review_key, 'source' AS list, source AS value, count(*) AS n FROM d GROUP BY 1, 3 UNION ALL SELECT review_key, 'doc', CAST(doc_id AS VARCHAR), count(*) FROM d GROUP BY 1, 3""",
)
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("doc"), "source", text.review_key("text").alias("review_key"))
    return review.review_values(rows, "review_key", ["source", "doc"])


_ANSWER_KEYS = ["item_index", "prime_condition", "target_voice", "question_type"]


@query(
    "s05_score_answers",
    f"""SELECT item_index, prime_condition, target_voice, question_type, generated_answer_normalized, CASE WHEN c AND f THEN 'ambiguous' WHEN c THEN 'correct' WHEN f THEN 'foil' ELSE 'other' END AS matched_label, c AND NOT f AS is_correct, f AND NOT c AS is_foil
FROM (SELECT *, list_contains(regexp_extract_all(lower(concat(answer_raw, ' ', generated_answer_normalized)), '[a-z]+'), correct_head) AS c, list_contains(regexp_extract_all(lower(concat(answer_raw, ' ', generated_answer_normalized)), '[a-z]+'), foil_head) AS f FROM {NORMAL}) z""",
)
def _(t):
    rows = review.score_answers(t.role_answers(), "answer_raw", "correct_head", "foil_head")
    return rows.select(
        *_ANSWER_KEYS, "generated_answer_normalized", "matched_label", "is_correct", "is_foil"
    )


@query(
    "s06_score_generations",
    f"""SELECT item_index, prime_condition, concat('Then ', CASE WHEN k = 5 THEN concat(rtrim(replace(generated, '.', '')), ' .') ELSE generated END) AS greedy_answer_first_sentence,
  concat('then ', generated) AS greedy_answer_first_sentence_normalized, CASE k WHEN 0 THEN 'active_structural' WHEN 1 THEN 'passive_structural' ELSE 'other' END AS generation_class FROM {_G}""",
)
def _(t):
    rows = t.generations().withColumn("completion", F.concat("generated", F.lit(" And then some.")))
    return review.score_generations(rows, "completion", stub="Then ").select(
        *KEYS, "greedy_answer_first_sentence", "greedy_answer_first_sentence_normalized", "generation_class"
    )
