"""Text functions, corpus building and prompts."""

from pyspark.sql import functions as F

from ..functions import fixed, prompts, text
from ..operators import audits, corpus
from .aggregates import people_pool
from .joins import MIXED
from .registry import query
from .windows import PICKED, ROLE, SEEDED_PICK


def pretty(x):
    """SQL of the tidy form of a binding sentence (one blank between words, ` .` at the end)."""
    return f"concat(upper(substr({x}, 1, 1)), substr(replace({x}, ' .', '.'), 2))"


@query(
    "tx01_pretty_sentence",
    """SELECT doc_id, concat(upper(left(b, 1)), substr(b, 2)) AS pretty FROM (SELECT doc_id, replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' .', '.'), ' ,', ',') AS b FROM documents) x""",
)
def _(t):
    return t.documents.select("doc_id", text.pretty_sentence("text").alias("pretty"))


@query(
    "tx02_normalize_generated",
    """SELECT doc_id, trim(regexp_replace(replace(lower(text), '.', ' . '), '\\s+', ' ', 'g')) AS normal FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", text.normalize_generated("text").alias("normal"))


@query(
    "tx03_sentence_key",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(text), '"', ''), '\\s+', ' ', 'g')), '\\s+([.?!,;:])', '\\1', 'g'), '([.?!,;:])', ' \\1 ', 'g'), '\\s+', ' ', 'g')) AS key FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", text.sentence_key("text").alias("key"))


@query(
    "tx04_review_key",
    """SELECT doc_id, substr(sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16) AS review_key FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", text.review_key("text").alias("review_key"))


@query(
    "tx05_words",
    """SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '([a-z]+|[.?!])', 1) AS w FROM documents) x""",
)
def _(t):
    rows = t.documents.select("doc_id", text.words("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(
    "tx06_words_apostrophe",
    """SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(concat(text, ' it''s o''clock ''tis')), '([a-z]+(?:''[a-z]+)?)', 1), ' ') AS words FROM conversations""",
)
def _(t):
    longer = F.concat("text", F.lit(" it's o'clock 'tis"))
    return t.conversations.select(
        "conv_id", "turn", F.array_join(text.words(longer, apostrophe=True), " ").alias("words")
    )


@query(
    "tx07_plain_tokens",
    """SELECT item_index, rtrim(replace(lower(upper(ta)), ' .', '')) AS final_period, trim(replace(replace(tp, ' .', ''), ',', '')) AS all_punctuation, trim(replace(concat('Mr ', pa), ' .', '')) AS letters FROM quartets""",
)
def _(t):
    def joined(value, mode, lower=True):
        return F.array_join(text.plain_tokens(value, mode, lower), " ")

    stuck = F.regexp_replace(F.upper("ta"), r" \.$", ".")
    return t.quartets().select(
        "item_index",
        joined(stuck, "final_period").alias("final_period"),
        joined(F.concat("tp", F.lit(" , .")), "all_punctuation").alias("all_punctuation"),
        joined(F.concat(F.lit("Mr. "), F.col("pa")), "letters", lower=False).alias("letters"),
    )


@query(
    "tx08_parse_active",
    """SELECT item_index, split_part(ta, ' ', 1) AS det, split_part(ta, ' ', 2) AS agent, split_part(ta, ' ', 3) AS verb, split_part(ta, ' ', 4) AS patient_det, split_part(ta, ' ', 5) AS patient,
  true AS wrong_is_null FROM quartets""",
)
def _(t):
    rows = t.quartets().select(
        "item_index", text.parse_active(F.upper("ta"), final_stop=True).alias("p"),
        (text.parse_active("tp").isNull() & text.parse_active(F.replace("ta", F.lit(" ."), F.lit(" !")), final_stop=True).isNull()).alias("wrong_is_null"),
    )
    return rows.select("item_index", "p.*", "wrong_is_null")


@query(
    "tx09_parse_active_lenient",
    """SELECT item_index, split_part(ta, ' ', 2) AS agent, split_part(ta, ' ', 3) AS verb, split_part(ta, ' ', 5) AS patient FROM quartets""",
)
def _(t):
    longer = F.concat(F.replace("ta", F.lit(" ."), F.lit("")), F.lit(" again and again."))
    p = text.parse_active(longer, strict=False)
    return t.quartets().select(
        "item_index", p["agent"].alias("agent"), p["verb"].alias("verb"), p["patient"].alias("patient")
    )


@query(
    "tx10_parse_passive",
    """SELECT item_index, split_part(tp, ' ', 1) AS det, split_part(tp, ' ', 2) AS patient, split_part(tp, ' ', 3) AS aux, split_part(tp, ' ', 4) AS participle,
  split_part(tp, ' ', 6) AS agent_det, split_part(tp, ' ', 7) AS agent, true AS wrong_is_null FROM quartets""",
)
def _(t):
    wrong = text.parse_passive(F.replace("tp", F.lit(" by "), F.lit(" near ")), check_by=True)
    rows = t.quartets().select(
        "item_index", text.parse_passive("tp", check_by=True).alias("p"),
        wrong.isNull().alias("wrong_is_null"),
    )
    return rows.select("item_index", "p.*", "wrong_is_null")


_LEMMA3 = "CASE WHEN {0} LIKE '%es' THEN left({0}, -2) WHEN {0} LIKE '%s' THEN left({0}, -1) ELSE {0} END"


@query(
    "tx11_role_bundle",
    f"""SELECT item_index, split_part(ta, ' ', 1) AS agent_det, split_part(ta, ' ', 2) AS agent_noun, split_part(ta, ' ', 4) AS patient_det, split_part(ta, ' ', 5) AS patient_noun,
  split_part(ta, ' ', 3) AS active_verb_form, split_part(tp, ' ', 4) AS passive_verb_form, {_LEMMA3.format("split_part(ta, ' ', 3)")} AS verb_lemma, ta <> pa AS mismatch_is_null FROM quartets""",
)
def _(t):
    same = (text.parse_active("ta"), text.parse_passive("tp"))
    cross = text.role_bundle(text.parse_active("ta"), text.parse_passive("pp"))
    rows = t.quartets().select(
        "item_index", text.role_bundle(*same).alias("b"),
        (cross.isNull() | (F.col("ta") != F.col("pa"))).alias("mismatch_is_null"),
    )
    return rows.select("item_index", "b.*", "mismatch_is_null")


@query(
    "tx12_cell",
    """SELECT item_index, CASE WHEN split_part(ta, ' ', 1) = 'the' THEN 'def' ELSE 'indef' END AS family, CASE split_part(tp, ' ', 3) WHEN 'is' THEN 'present' ELSE 'past' END AS tense,
  concat(CASE WHEN split_part(ta, ' ', 1) = 'the' THEN 'def' ELSE 'indef' END, '_', CASE split_part(tp, ' ', 3) WHEN 'is' THEN 'present' ELSE 'past' END) AS cell FROM quartets""",
)
def _(t):
    a, p = text.parse_active("ta"), text.parse_passive("tp")
    return t.quartets().select(
        "item_index", text.det_family(a["det"]).alias("family"), text.aux_tense(p["aux"]).alias("tense"),
        text.cell(a, p).alias("cell"),
    )


@query(
    "tx13_verb_tense_lemma",
    """WITH v AS (SELECT item_index, split_part(ta, ' ', 3) AS f FROM quartets) SELECT item_index, f AS form, CASE WHEN f = 'asks' THEN 'habitual' WHEN f LIKE '%ed' THEN 'past' WHEN f LIKE '%s' THEN 'present' ELSE 'unknown' END AS tense,
  CASE WHEN f LIKE '%s' THEN 'present' ELSE 'past' END AS lenient_tense, CASE f WHEN 'asks' THEN 'ask' WHEN 'asked' THEN 'ask' ELSE f END AS lemma FROM v""",
)
def _(t):
    from ..operators import joins

    known = t.spark.createDataFrame(
        [("asks", "ask", "habitual"), ("asked", "ask", None)], "form string, lemma string, tense string"
    )
    rows = t.quartets().select("item_index", text.parse_active("ta")["verb"].alias("verb"))
    rows = joins.lookup(rows, known, "verb", "lemma", "lemma", dim_key="form")
    rows = joins.lookup(rows, known, "verb", "tense", "known", F.lit(None).cast("string"), "form")
    return rows.select(
        "item_index", F.col("verb").alias("form"),
        text.verb_tense("verb", F.col("known")).alias("tense"),
        text.verb_tense("verb", lenient=True).alias("lenient_tense"), "lemma",
    )


@query(
    "tx14_infer_lemma",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM documents)
SELECT form, CASE WHEN form LIKE '%ies' AND length(form) > 3 THEN concat(left(form, -3), 'y') WHEN form LIKE '%es' AND length(form) > 2 THEN left(form, -2) WHEN form LIKE '%s' AND length(form) > 1 THEN left(form, -1) ELSE form END AS lemma FROM w""",
)
def _(t):
    return _forms(t).select("form", text.infer_lemma("form").alias("lemma"))


def _forms(t):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    return t.documents.select(F.explode(F.array_distinct(found)).alias("form")).distinct()


_FORMS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents)"


@query(
    "tx15_content_frame",
    """SELECT item_index, concat(split_part(ta, ' ', 2), '|', split_part(ta, ' ', 3), '|', split_part(ta, ' ', 5)) AS frame, split_part(ta, ' ', 3) AS verb, '' AS short FROM quartets""",
)
def _(t):
    return t.quartets().select(
        "item_index", text.content_frame("ta").alias("frame"), text.finite_verb("ta").alias("verb"),
        text.content_frame(F.split_part("ta", F.lit(" "), F.lit(2))).alias("short"),
    )


def _sib(x):
    return f"regexp_matches({x}, '(ches|shes|sses|xes|zes|oes)$')"


_E = "WHEN {0} LIKE '%ie' AND length({0}) > 2 THEN concat(left({0}, -2), 'ying') WHEN {0} LIKE '%e' AND NOT regexp_matches({0}, '(ee|oe|ye)$') THEN concat(left({0}, -1), 'ing')"
_CVC = "WHEN regexp_matches({0}, '[^aeiou][aeiou][^aeiouy]$') THEN concat({0}, right({0}, 1), 'ing')"
_CVC_WXY = "WHEN regexp_matches({0}, '[^aeiou][aeiou][^aeiouwxy]$') THEN concat({0}, right({0}, 1), 'ing')"
_PAST = "CASE WHEN t LIKE '%ied' AND length(t) > 4 THEN concat(left(t, -3), 'y') WHEN t LIKE '%ed' AND length(t) > 4 THEN left(t, -2) ELSE t END"
_BASE = "CASE WHEN p LIKE '%ies' AND length(p) > 4 THEN concat(left(p, -3), 'y') WHEN {sib} AND length(p) > 4 THEN left(p, -2) WHEN p LIKE '%es' AND length(p) > 3 THEN left(p, -1) WHEN p LIKE '%s' AND length(p) > 3 THEN left(p, -1) ELSE p END".format(sib=_sib("p"))


@query(
    "tx16_to_ing",
    f"""WITH {_FORMS}, a AS (SELECT t, {_PAST} AS p, t LIKE '%ed' AND length(t) > 4 AS u FROM w), b AS (SELECT *, {_BASE} AS b FROM a)
SELECT t AS form, CASE {_E.format('b')} WHEN b LIKE '%y' AND length(b) > 1 THEN concat(b, 'ing') WHEN NOT u AND regexp_matches(b, '[^aeiou][aeiou][^aeiouy]$') THEN concat(b, right(b, 1), 'ing') ELSE concat(b, 'ing') END AS finite,
  CASE WHEN t IN ('be', 'do', 'go') THEN concat(t, 'ing') WHEN t = 'see' THEN 'seeing' {_E.format('t')} {_CVC_WXY.format('t')} ELSE concat(t, 'ing') END AS nominal,
  CASE WHEN t IN ('s', 'ed') THEN '' {_E.format('t')} ELSE concat(t, 'ing') END AS label FROM b""",
)
def _(t):
    return _forms(t).select(
        "form",
        *[text.to_ing("form", v).alias(v) for v in ("finite", "nominal", "label")],
    )


@query(
    "tx17_lemma_3sg",
    f"""WITH {_FORMS} SELECT t AS form, CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN concat(left(t, -3), 'y') WHEN {_sib('t')} AND length(t) > 4 THEN left(t, -2) WHEN t LIKE '%es' AND length(t) > 3 THEN left(t, -1)
  WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' THEN left(t, -1) ELSE t END AS lemma,
  CASE WHEN t LIKE '%ied' AND length(t) > 4 THEN concat(left(t, -3), 'y') WHEN t LIKE '%ed' AND length(t) > 4 THEN CASE WHEN substr(t, length(t) - 2, 1) = substr(t, length(t) - 3, 1) THEN left(t, -3) ELSE left(t, -2) END
  WHEN t LIKE '%ies' AND length(t) > 4 THEN concat(left(t, -3), 'y') WHEN {_sib('t')} AND length(t) > 4 THEN left(t, -2) WHEN t LIKE '%es' AND length(t) > 3 THEN left(t, -1)
  WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' THEN left(t, -1) ELSE t END AS past_lemma FROM w""",
)
def _(t):
    return _forms(t).select(
        "form", text.lemma_3sg("form").alias("lemma"), text.lemma_3sg("form", past=True).alias("past_lemma")
    )


_UNDOUBLE = "CASE WHEN length(st) >= 2 AND right(st, 1) = substr(st, length(st) - 1, 1) AND right(st, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(st, -1) ELSE st END"


@query(
    "tx18_verb_key",
    f"""WITH {_FORMS}, s AS (SELECT t, CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, -3) WHEN t LIKE '%ed' AND length(t) > 4 AND t NOT LIKE '%ied' THEN left(t, -2) END AS st FROM w)
SELECT t AS form, CASE WHEN (t LIKE '%ies' OR t LIKE '%ied') AND length(t) > 4 THEN concat(left(t, -3), 'y') WHEN st IS NOT NULL THEN {_UNDOUBLE}
  WHEN t LIKE '%es' AND length(t) > 4 THEN CASE WHEN {_sib('t')} OR t LIKE '%ges' THEN left(t, -2) ELSE left(t, -1) END WHEN t LIKE '%s' AND length(t) > 3 THEN left(t, -1) ELSE t END AS verb_key FROM s""",
)
def _(t):
    return _forms(t).select("form", text.verb_key("form").alias("verb_key"))


@query(
    "tx44_stems",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
s AS (SELECT w, unnest(range(7)) AS i, unnest([w, CASE WHEN w LIKE '%ed' AND length(w) > 3 THEN left(w, -2) END, CASE WHEN w LIKE '%ied' AND length(w) > 3 THEN concat(left(w, -3), 'y') END, CASE WHEN w LIKE '%es' AND length(w) > 3 THEN left(w, -2) END,
  CASE WHEN w LIKE '%s' AND length(w) > 2 THEN left(w, -1) END, CASE WHEN w LIKE '%es' AND length(w) > 2 THEN left(w, -2) END, CASE WHEN w LIKE '%ing' AND length(w) > 4 THEN left(w, -3) END]) AS st FROM w),
d AS (SELECT w, st, min(i) AS i FROM s WHERE st IS NOT NULL GROUP BY 1, 2) SELECT w AS form, string_agg(st, ';' ORDER BY i) AS stems FROM d GROUP BY 1""",
)
def _(t):
    return _forms(t).select("form", F.array_join(text.stems("form"), ";").alias("stems"))


@query(
    "tx27_first_sentence",
    """SELECT conv_id, turn, CASE WHEN contains(text, '.') THEN concat(trim(split_part(replace(replace(trim(text), chr(10), ' '), '"', ''), '.', 1)), ' .') ELSE trim(replace(replace(trim(text), chr(10), ' '), '"', '')) END AS sentence,
  CASE WHEN contains(c, '.') THEN trim(split_part(c, '.', 1)) WHEN contains(c, '?') THEN trim(split_part(c, '?', 1)) WHEN contains(c, '!') THEN trim(split_part(c, '!', 1)) WHEN contains(c, ';') THEN trim(split_part(c, ';', 1)) ELSE c END AS clause
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM conversations) x""",
)
def _(t):
    return t.conversations.select(
        "conv_id", "turn", text.first_sentence("text").alias("sentence"), text.first_clause("text").alias("clause")
    )


_AW = "regexp_extract_all(lower({0}), '([a-z]+(?:''[a-z]+)?)', 1)"
_NORM = f"""CASE WHEN list_contains({_AW.format('b')}, correct_head) THEN concat('the ', correct_head) WHEN list_contains({_AW.format('b')}, foil_head) THEN concat('the ', foil_head)
  WHEN lower(regexp_extract(b, '(?i)\\bwas\\s+(?:the|a|an)?\\s*([A-Za-z]+)\\b', 1)) <> '' THEN concat('the ', lower(regexp_extract(b, '(?i)\\bwas\\s+(?:the|a|an)?\\s*([A-Za-z]+)\\b', 1)))
  WHEN len(list_filter({_AW.format('b')}, lambda x: x NOT IN ('the', 'a', 'an'))) > 0 THEN concat('the ', list_filter({_AW.format('b')}, lambda x: x NOT IN ('the', 'a', 'an'))[1]) ELSE '' END"""
NORMAL = f"""(SELECT *, {_NORM} AS generated_answer_normalized FROM (SELECT *, trim(regexp_replace(trim(split_part(answer_raw, '.', 1)), '(?i)^answer\\s*:\\s*', '')) AS b FROM role_answers) x) y"""


@query(
    "tx28_normalize_answer",
    f"SELECT item_index, prime_condition, target_voice, question_type, generated_answer_normalized AS normalized FROM {NORMAL}",
)
def _(t):
    return t.role_answers().select(
        "item_index", "prime_condition", "target_voice", "question_type",
        text.normalize_answer("answer_raw", "correct_head", "foil_head").alias("normalized"),
    )


@query(
    "tx29_evaluate_answer",
    f"""SELECT item_index, prime_condition, target_voice, question_type, CASE WHEN c AND f THEN 'ambiguous' WHEN c THEN 'correct' WHEN f THEN 'foil' ELSE 'other' END AS matched_label, head
FROM (SELECT *, list_contains(list_concat({_AW.format('answer_raw')}, {_AW.format('generated_answer_normalized')}), correct_head) AS c, list_contains(list_concat({_AW.format('answer_raw')}, {_AW.format('generated_answer_normalized')}), foil_head) AS f,
  coalesce(list_filter({_AW.format('answer_raw')}, lambda x: x NOT IN ('the', 'a', 'an'))[-1], '') AS head FROM {NORMAL}) z""",
)
def _(t):
    normal = text.normalize_answer("answer_raw", "correct_head", "foil_head")
    rows = t.role_answers().withColumn("normalized", normal)
    return rows.select(
        "item_index", "prime_condition", "target_voice", "question_type",
        text.evaluate_answer("answer_raw", "normalized", "correct_head", "foil_head").alias("matched_label"),
        text.head_noun("answer_raw").alias("head"),
    )


# ---- prompts ----------------------------------------------------------------


def np(side, a, b):
    return f"concat(split_part({side}, ' ', {a}), ' ', split_part({side}, ' ', {b}))"


_ING = "CASE {0} WHEN 'asks' THEN 'asking' WHEN 'follows' THEN 'following' WHEN 'helps' THEN 'helping' WHEN 'joins' THEN 'joining' WHEN 'pushes' THEN 'pushing' WHEN 'visits' THEN 'visiting' WHEN 'greets' THEN 'greeting' WHEN 'calls' THEN 'calling' " \
    "WHEN 'asked' THEN 'asking' WHEN 'followed' THEN 'following' WHEN 'helped' THEN 'helping' WHEN 'joined' THEN 'joining' WHEN 'pushed' THEN 'pushing' WHEN 'visited' THEN 'visiting' WHEN 'greeted' THEN 'greeting' WHEN 'called' THEN 'calling' END"
# The finite rule doubles a final consonant after one vowel unless -ed was undone.
_ING_FINITE = _ING.replace("'visits' THEN 'visiting'", "'visits' THEN 'visitting'").replace(
    "'follows' THEN 'following'", "'follows' THEN 'followwing'"
)
# The label takes the lemma as found, so past forms keep their -ed.
_LABEL = "concat({0}, 'ing')"
NL = "chr(10)"


def event(agent, patient, label):
    return f"concat('There was ', CASE WHEN left({label}, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END, {label}, ' event involving ', {agent}, ' and ', {patient}, '.')"


def roles(agent, patient, order):
    did = f"concat('The one who did it was ', {agent}, '.')"
    got = f"concat('The one it happened to was ', {patient}, '.')"
    return f"CASE WHEN {order} = 'agent_first' THEN concat({did}, {NL}, {got}) ELSE concat({got}, {NL}, {did}) END"


_OPEN = f"""concat({NL}, {NL}, 'Bridget asked, "What happened?"', {NL}, 'Mary answered, "')"""


@query(
    "tx47_event_lines",
    f"""WITH q AS (SELECT *, {np('ta', 1, 2)} AS ag, {np('ta', 4, 5)} AS pt, split_part(ta, ' ', 3) AS v, CASE WHEN item_index % 3 = 0 THEN 'agent_first' ELSE 'patient_first' END AS ro FROM quartets)
SELECT item_index, concat({event('ag', 'pt', _ING_FINITE.format('v'))}, {NL}, {roles('ag', 'pt', 'ro')}, {_OPEN}) AS prompt,
  concat('There was an event involving ', ag, ' and ', pt, '.', {NL}, {roles('ag', 'pt', 'ro')}, {_OPEN}) AS nonce_prompt FROM q""",
)
def _(t):
    p = text.parse_active("ta")
    agent = F.concat_ws(" ", p["det"], p["agent"])
    patient = F.concat_ws(" ", p["patient_det"], p["patient"])
    order = F.when(F.col("item_index") % 3 == 0, "agent_first").otherwise("patient_first")
    return t.quartets().select(
        "item_index",
        prompts.target_event_prompt(agent, patient, p["verb"], order).alias("prompt"),
        prompts.target_event_prompt(agent, patient, F.lit("ed"), order).alias("nonce_prompt"),
    )


@query(
    "tx50_event_fields",
    f"""SELECT item_index, {np('ta', 1, 2)} AS agent_a, {np('ta', 4, 5)} AS patient_a, split_part(ta, ' ', 3) AS verb_a, {np('tp', 6, 7)} AS agent_p, {np('tp', 1, 2)} AS patient_p, split_part(tp, ' ', 4) AS verb_p FROM quartets""",
)
def _(t):
    out = ["item_index"]
    for c, s in (("ta", "a"), ("tp", "p")):
        f = text.event_fields(c)
        out += [
            f["agent_phrase"].alias(f"agent_{s}"), f["patient_phrase"].alias(f"patient_{s}"),
            f["verb"].alias(f"verb_{s}"),
        ]
    return t.quartets().select(*out)


def _demo_sql(prime, sentence, with_demo):
    """SQL of one demonstration prompt in the default style."""
    lemma = _LEMMA3
    target_label = _LABEL.format(lemma.format("split_part(ta, ' ', 3)"))
    prime_label = _LABEL.format(lemma.format("split_part(pa, ' ', 3)"))
    tag, tpt, pag, ppt = np("ta", 1, 2), np("ta", 4, 5), np("pa", 1, 2), np("pa", 4, 5)
    ask = """'Bridget asked, "What happened?"'"""
    target = f"""concat({event(tag, tpt, target_label)}, {NL}, {roles(tag, tpt, 'ro')}, {NL}, 'Use the verb "', {lemma.format("split_part(ta, ' ', 3)")}, '" in the answer.', {NL}, {NL}, {ask}, {NL}, 'Mary answered, "The')"""
    if with_demo == "solved":
        demo = f"""concat({event(pag, ppt, prime_label)}, {NL}, {roles(pag, ppt, 'ro')}, {NL}, {NL}, {ask}, {NL}, 'Mary answered, "', {pretty(sentence)}, '"', {NL}, {NL})"""
    elif with_demo == "filler":
        demo = f"""concat('In another scene, something unrelated happened.', {NL}, {ask}, {NL}, 'Mary answered, "', {pretty(sentence)}, '"', {NL}, {NL})"""
    else:
        demo = "''"
    return f"concat({demo}, {target})"


_POOL = "[" + ", ".join(f"'{s}'" for s in fixed.CORE_FILLERS) + "]"
_DEMO = f"""d AS (SELECT *, {ROLE} AS ro, ({_POOL})[item_index % {len(fixed.CORE_FILLERS)} + 1] AS filler FROM quartets)"""


@query(
    "tx32_render_prompts",
    f"""WITH {_DEMO} SELECT item_index, 'active' AS prime_condition, {_demo_sql('pa', 'pa', 'solved')} AS prompt FROM d UNION ALL SELECT item_index, 'passive', {_demo_sql('pp', 'pp', 'solved')} FROM d
UNION ALL SELECT item_index, 'no_prime', {_demo_sql('', '', '')} FROM d UNION ALL SELECT item_index, 'filler', {_demo_sql('', 'filler', 'filler')} FROM d""",
)
def _(t):
    return corpus.render_prompts(corpus.demo_rows(t.quartets())).select(
        "item_index", "prime_condition", "prompt"
    )


@query(
    "tx33_export_prompts_wide",
    f"""WITH {_DEMO} SELECT item_index, pa AS prime_active_sentence, pp AS prime_passive_sentence, ta AS target_active, tp AS target_passive, filler AS filler_sentence, ro AS role_order,
  {_demo_sql('pa', 'pa', 'solved')} AS prompt_active, {_demo_sql('pp', 'pp', 'solved')} AS prompt_passive, {_demo_sql('', '', '')} AS prompt_no_prime, {_demo_sql('', 'filler', 'filler')} AS prompt_filler FROM d""",
)
def _(t):
    return corpus.export_prompts_wide(corpus.demo_rows(t.quartets()))


# ---- complex corpus ---------------------------------------------------------

_N = """n AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT unnest([split_part(pa, ' ', 2), split_part(pa, ' ', 5), split_part(ta, ' ', 2), split_part(ta, ' ', 5)]) AS word FROM quartets) w)"""
_SEQ = "[" + ", ".join(f"'{p}'" for p, _ in fixed.PREPOSITION_SEQUENCE) + "]"
_SECOND = "[" + ", ".join(
    "[" + ", ".join(f"'{p}'" for p in fixed.PREPOSITION_GROUPS[g]) + "]" for _, g in fixed.PREPOSITION_SEQUENCE
) + "]"
_COMPLEX = f"""{_N}, k AS (SELECT q.*, c.ci, c.cc FROM quartets q CROSS JOIN (SELECT 0 AS ci, 'agent_complex' AS cc UNION ALL SELECT 1, 'patient_complex' UNION ALL SELECT 2, 'both_complex') c),
cand AS (SELECT k.item_index, k.ci, n.word, (n.position - (k.item_index * 7 + k.ci * 13) % n.n + n.n) % n.n AS step FROM k JOIN n ON n.word NOT IN (split_part(pa, ' ', 2), split_part(pa, ' ', 5), split_part(ta, ' ', 2), split_part(ta, ' ', 5))),
r AS (SELECT *, row_number() OVER (PARTITION BY item_index, ci ORDER BY step) AS rn FROM cand), m AS (SELECT item_index, ci, max(CASE WHEN rn = 1 THEN word END) AS w1, max(CASE WHEN rn = 2 THEN word END) AS w2 FROM r WHERE rn <= 2 GROUP BY 1, 2),
x AS (SELECT k.*, m.w1, m.w2, ({_SEQ})[(item_index + ci) % 7 + 1] AS p1, ({_SECOND})[(item_index + ci) % 7 + 1] AS p2s FROM k JOIN m USING (item_index, ci)),
y AS (SELECT *, p2s[((item_index + ci) // 7) % len(p2s) + 1] AS p2, CASE WHEN split_part(ta, ' ', 1) = 'the' THEN 'the' ELSE NULL END AS d FROM x),
z AS (SELECT *, CASE WHEN cc <> 'patient_complex' THEN w1 END AS am, CASE cc WHEN 'both_complex' THEN w2 WHEN 'patient_complex' THEN w1 END AS pm, CASE WHEN cc <> 'patient_complex' THEN p1 END AS ap, CASE cc WHEN 'both_complex' THEN p2 WHEN 'patient_complex' THEN p1 END AS ppr FROM y),
f AS (SELECT *, CASE WHEN ap IS NULL THEN '' ELSE concat(' ', ap, ' ', coalesce(d, CASE WHEN regexp_matches(am, '^[bcdfghjklmnpqrstvwxyz]') THEN 'a' ELSE 'an' END), ' ', am) END AS a_tail,
  CASE WHEN ppr IS NULL THEN '' ELSE concat(' ', ppr, ' ', coalesce(d, CASE WHEN regexp_matches(pm, '^[bcdfghjklmnpqrstvwxyz]') THEN 'a' ELSE 'an' END), ' ', pm) END AS p_tail FROM z),
g AS (SELECT *, concat('exp4_core_', lpad(CAST(item_index AS VARCHAR), CAST(greatest(4, length(CAST(item_index AS VARCHAR))) AS INTEGER), '0'), '_', cc) AS iid,
  concat({np('ta', 1, 2)}, a_tail, ' ', split_part(ta, ' ', 3), ' ', {np('ta', 4, 5)}, p_tail, ' .') AS tac,
  concat({np('tp', 1, 2)}, p_tail, ' ', split_part(tp, ' ', 3), ' ', split_part(tp, ' ', 4), ' by ', {np('tp', 6, 7)}, a_tail, ' .') AS tpc FROM f)"""


@query(
    "tx38_complex_targets",
    f"WITH {_COMPLEX} SELECT item_index, cc AS complexity_condition, tac AS target_active_complex, tpc AS target_passive_complex FROM g",
)
def _(t):
    return corpus.build_complex(t.quartets(), people_pool(t), "core").select(
        "item_index", "complexity_condition", "target_active_complex", "target_passive_complex"
    )


@query(
    "tx39_build_complex",
    f"""WITH {_COMPLEX} SELECT iid AS item_id, item_index, CAST(ci AS BIGINT) AS complexity_index, cc AS complexity_condition, tac AS target_active_complex, tpc AS target_passive_complex, coalesce(am, '') AS agent_modifier_noun, coalesce(pm, '') AS patient_modifier_noun,
  coalesce(ap, '') AS agent_modifier_prep, coalesce(ppr, '') AS patient_modifier_prep, split_part(ta, ' ', 2) AS target_agent, split_part(tp, ' ', 3) AS target_passive_aux FROM g""",
)
def _(t):
    return corpus.build_complex(t.quartets(), people_pool(t), "core").select(
        "item_id", "item_index", "complexity_index", "complexity_condition", "target_active_complex",
        "target_passive_complex", "agent_modifier_noun", "patient_modifier_noun", "agent_modifier_prep",
        "patient_modifier_prep", "target_agent", "target_passive_aux",
    )


def _turn(pool):
    return "(CASE split_part(tp, ' ', 3) WHEN 'is' THEN [" + ", ".join(f"'{s}'" for s in pool["past"]) + "] ELSE [" + ", ".join(
        f"'{s}'" for s in pool["present"]
    ) + "] END)[(item_index * 3 + ci) % 12 + 1]"


_FREE = "list_filter([" + ", ".join(f"'{n}'" for n in fixed.NONCE_NOUNS) + "], lambda s: s NOT IN (split_part(ta, ' ', 2), split_part(ta, ' ', 5)))"


@query(
    "tx52_filler_primes",
    f"""WITH {_COMPLEX} SELECT iid AS item_id, {_turn(fixed.TENSED_FILLERS)} AS filler, replace({_turn(fixed.TENSED_NONCE_FILLERS)}, '{{noun}}', ({_FREE})[(item_index * 3 + ci) % 40 + 1]) AS nonce_filler FROM g""",
)
def _(t):
    rows = corpus.build_complex(t.quartets(), people_pool(t), "core").withColumn(
        "row_number", F.col("item_index") * 3 + F.col("complexity_index")
    )
    rows = corpus.filler_primes(rows, False, name="filler")
    return corpus.filler_primes(rows, True, name="nonce_filler").select("item_id", "filler", "nonce_filler")


_NOM = "CASE WHEN v LIKE 'ask%' THEN 'asking' WHEN v LIKE 'follow%' THEN 'following' WHEN v LIKE 'help%' THEN 'helping' WHEN v LIKE 'join%' THEN 'joining' WHEN v LIKE 'push%' THEN 'pushing' WHEN v LIKE 'visit%' THEN 'visitting' WHEN v LIKE 'greet%' THEN 'greeting' ELSE 'calling' END"


@query(
    "tx34_export_prompts_long",
    f"""WITH {_COMPLEX}, h AS (SELECT *, split_part(ta, ' ', 3) AS v, {_turn(fixed.TENSED_FILLERS)} AS fl FROM g), p AS (SELECT h.*, c.pc, tv.tv, qt.qt FROM h CROSS JOIN (SELECT 'active' AS pc UNION ALL SELECT 'passive' UNION ALL SELECT 'filler' UNION ALL SELECT 'no_prime') c
  CROSS JOIN (SELECT 'active' AS tv UNION ALL SELECT 'passive') tv CROSS JOIN (SELECT 'doer' AS qt UNION ALL SELECT 'acted_on') qt),
s AS (SELECT *, CASE pc WHEN 'active' THEN pa WHEN 'passive' THEN pp WHEN 'filler' THEN fl ELSE '' END AS pr, CASE tv WHEN 'active' THEN tac ELSE tpc END AS tg, concat('In the ', {_NOM}, ' event, who was the ', CASE qt WHEN 'doer' THEN 'doer?' ELSE 'one acted on?' END) AS qn,
  CASE qt WHEN 'doer' THEN 'The doer was the ' ELSE 'The one acted on was the ' END AS lead, split_part(ta, ' ', 2) AS ag, split_part(ta, ' ', 5) AS ptn FROM p)
SELECT concat(iid, '_', pc, '_', tv, '_', qt) AS prompt_id, qn AS question_text, concat(CASE WHEN pr = '' THEN '' ELSE concat(pr, {NL}, {NL}) END, tg, {NL}, {NL}, qn, {NL}, 'Answer: ', rtrim(lead)) AS prompt,
  concat(lead, CASE qt WHEN 'doer' THEN ag ELSE ptn END, '.') AS correct_answer, concat(lead, CASE qt WHEN 'doer' THEN ptn ELSE ag END, '.') AS foil_answer, concat_ws(';', am, pm) AS modifier_distractors FROM s""",
)
def _(t):
    rows = corpus.build_complex(t.quartets(), people_pool(t), "core")
    return corpus.export_prompts_long(rows).select(
        "prompt_id", "question_text", "prompt", "correct_answer", "foil_answer", "modifier_distractors"
    )


@query(
    "tx35_between_markers",
    """SELECT item_index, concat('Event. Mary answered, "') AS context, pa AS answer FROM quartets""",
)
def _(t):
    prompt = F.concat(F.lit('Event. Mary answered, "'), "pa", F.lit('" Mary answered, "'), "tp", F.lit('"'))
    rows = t.quartets().select("item_index", text.between_markers(prompt).alias("m"))
    return rows.select("item_index", "m.context", "m.answer")


@query(
    "tx36_sentences_match",
    """SELECT item_index, true AS same, ta = pa AS other FROM quartets""",
)
def _(t):
    shown = F.concat(F.lit("  "), F.upper("ta"), F.lit(" . "))
    return t.quartets().select(
        "item_index", text.sentences_match("ta", shown).alias("same"),
        text.sentences_match("ta", "pa").alias("other"),
    )


@query(
    "tx37_build_question",
    f"""WITH v AS (SELECT item_index, split_part(ta, ' ', 3) AS v FROM quartets), l AS (SELECT item_index, v, CASE WHEN v LIKE '%es' AND v LIKE '%hes' THEN left(v, -2) WHEN v LIKE '%s' THEN left(v, -1) ELSE v END AS l FROM v),
n AS (SELECT *, CASE WHEN regexp_matches(l, '[^aeiou][aeiou][^aeiouwxy]$') THEN concat(l, right(l, 1), 'ing') ELSE concat(l, 'ing') END AS nm FROM l)
SELECT item_index, concat('In the ', nm, ' event, who was the doer?') AS question, l AS verb_lemma, nm AS nominalized, false AS fallback_used, 'In the event just described, who was the doer?' AS broken, 'doing' AS missing FROM n""",
)
def _(t):
    q = prompts.nominalized_question("ta")
    return t.quartets().select(
        "item_index", q["question"].alias("question"), q["verb_lemma"].alias("verb_lemma"),
        q["nominalized"].alias("nominalized"), q["fallback_used"].alias("fallback_used"),
        prompts.nominalized_question("ta", "Who {nobody} knows?")["question"].alias("broken"),
        prompts.nominalized_question(F.lit("two words"))["nominalized"].alias("missing"),
    )


def _nonce(i):
    return "[" + ", ".join(f"'{n}'" for n in fixed.NONCE_NOUNS) + f"][(item_index + {i}) % 40 + 1]"


def _nonce_active(s, p, a, b):
    d = f"split_part({s}, ' ', 1)"
    return f"concat({d}, ' ', {_nonce(a)}, ' ', CASE split_part({p}, ' ', 3) WHEN 'is' THEN 's' ELSE 'ed' END, ' ', {d}, ' ', {_nonce(b)}, ' .')"


def _nonce_passive(p, a, b):
    d = f"split_part({p}, ' ', 1)"
    return f"concat({d}, ' ', {_nonce(b)}, ' ', split_part({p}, ' ', 3), ' ed by ', {d}, ' ', {_nonce(a)}, ' .')"


@query(
    "tx40_build_nonce",
    f"SELECT item_index, {_nonce_active('pa', 'pp', 0, 1)} AS pa, {_nonce_passive('pp', 0, 1)} AS pp, {_nonce_active('ta', 'tp', 2, 3)} AS ta, {_nonce_passive('tp', 2, 3)} AS tp FROM quartets",
)
def _(t):
    return corpus.build_nonce(t.quartets())


@query(
    "tx41_build_mixed",
    f"""WITH m AS (SELECT item_index, prime_index FROM ({MIXED.format(how='')}) q) SELECT m.item_index, {_nonce_active('pa', 'pp', 0, 1).replace('item_index', 'q.item_index').replace('split_part(pa', 'split_part(q.pa').replace('split_part(pp', 'split_part(q.pp')} AS pa, t.ta
FROM m JOIN quartets q ON q.item_index = m.prime_index JOIN quartets t ON t.item_index = m.item_index""",
)
def _(t):
    q = t.quartets()
    mixed = corpus.build_mixed(q, corpus.build_nonce(q), 13, require_all=False)
    return mixed.where("pa IS NOT NULL").select("item_index", "pa", "ta")


_ITEMS = f"""i0 AS (SELECT *, {ROLE} AS role_order FROM quartets), f AS (SELECT item_index, {pretty(PICKED)} AS filler FROM {SEEDED_PICK}),
i AS (SELECT i0.*, f.filler, c.prime_condition, split_part(ta, ' ', 3) AS v, {np('ta', 1, 2)} AS ag, {np('ta', 4, 5)} AS pt FROM i0 JOIN f USING (item_index) CROSS JOIN (SELECT 'active' AS prime_condition UNION ALL SELECT 'passive' UNION ALL SELECT 'filler' UNION ALL SELECT 'no_prime') c),
it AS (SELECT *, concat('core_', lpad(CAST(item_index AS VARCHAR), CAST(greatest(5, length(CAST(item_index AS VARCHAR))) AS INTEGER), '0')) AS item_id, CASE prime_condition WHEN 'active' THEN {pretty('pa')} WHEN 'passive' THEN {pretty('pp')} WHEN 'filler' THEN filler ELSE '' END AS prime_text,
  concat({event('ag', 'pt', _ING_FINITE.format('v'))}, {NL}, {roles('ag', 'pt', 'role_order')}, {_OPEN}) AS target_event_prompt, {pretty('ta')} AS active_completion, {pretty('tp')} AS passive_completion FROM i)"""


def items(t):
    return corpus.build_items(t.quartets(), "core", "real")


@query(
    "tx42_build_items",
    f"""WITH {_ITEMS} SELECT item_id, item_index, prime_condition, prime_text, target_event_prompt, active_completion, passive_completion, role_order, concat('The ', split_part(ta, ' ', 2), '.') AS correct_answer_for_active,
  concat('generated_from_corpus=core;verb=', v, ';filler_source=intransitive_pool;role_order=', role_order) AS notes FROM it""",
)
def _(t):
    return items(t).select(
        "item_id", "item_index", "prime_condition", "prime_text", "target_event_prompt", "active_completion",
        "passive_completion", "role_order", "correct_answer_for_active", "notes",
    )


@query(
    "tx43_join_candidate",
    """SELECT item_index, concat(CASE WHEN item_index % 4 IN (1, 2, 3) THEN '' ELSE ' ' END, CASE WHEN item_index % 4 = 3 THEN ' x' ELSE ta END) AS candidate FROM quartets""",
)
def _(t):
    k = F.col("item_index") % 4
    prefix = F.when(k == 1, 'said "').when(k == 2, "").otherwise("said")
    candidate = F.when(k == 3, " x").otherwise(F.col("ta"))
    return t.quartets().select("item_index", text.join_candidate(prefix, candidate).alias("candidate"))


def _solved(agent, patient, label, sentence):
    return f"""concat({event(agent, patient, label)}, {NL}, {roles(agent, patient, 'role_order')}, {NL}, {NL}, 'Bridget asked, "What happened?"', {NL}, 'Mary answered, "', {sentence}, '"', {NL}, {NL})"""


_PRIME_BLOCK = f"""CASE prime_condition WHEN 'active' THEN {_solved("lower(" + np('pa', 1, 2) + ")", np('pa', 4, 5), _ING_FINITE.format("split_part(pa, ' ', 3)"), 'prime_text')}
  WHEN 'passive' THEN {_solved(np('pp', 6, 7), np('pp', 1, 2), _ING_FINITE.format("split_part(pp, ' ', 4)"), 'prime_text')}
  WHEN 'filler' THEN concat('In another scene, something unrelated happened.', {NL}, 'Bridget asked, "What happened?"', {NL}, 'Mary answered, "', prime_text, '"', {NL}, {NL}) ELSE '' END"""


@query(
    "s02_build_requests",
    f"""WITH {_ITEMS} SELECT item_id, prime_condition, concat({_PRIME_BLOCK}, target_event_prompt) AS prefix, concat(active_completion, '"') AS candidate_a, concat(passive_completion, '"') AS candidate_b, item_id AS pairing_key FROM it""",
)
def _(t):
    return corpus.build_requests(items(t)).select(
        "item_id", "prime_condition", "prefix", "candidate_a", "candidate_b", "pairing_key"
    )


@query(
    "tx48_cue_prompts",
    f"""WITH q AS (SELECT item_index, pa, split_part(ta, ' ', 2) AS a, split_part(ta, ' ', 5) AS p, {_LEMMA3.format("split_part(ta, ' ', 3)")} AS v FROM quartets), s AS (SELECT *, list_sort([concat(md5(concat_ws('|', 13, item_index, 0)), a), concat(md5(concat_ws('|', 13, item_index, 1)), p), concat(md5(concat_ws('|', 13, item_index, 2)), v)]) AS o FROM q)
SELECT item_index, concat('Prime sentence: ', pa, {NL}, 'Event roles: AGENT=', a, '; PATIENT=', p, '; VERB=', v, {NL}, 'The') AS labelled, concat(pa, {NL}, {NL}, 'Another event: ', substr(o[1], 33), ', ', substr(o[2], 33), ', ', substr(o[3], 33), '.', {NL}, 'The') AS shuffled,
  concat('Use these words in one sentence: ', a, ', ', p, ', ', v, {NL}, 'The') AS unprimed FROM s""",
)
def _(t):
    demo = corpus.demo_rows(t.quartets())
    out = corpus.cue_prompts(demo, "role_labeled", F.col("pa")).withColumnRenamed("prompt", "labelled")
    out = corpus.cue_prompts(out, "another_event", F.col("pa"), shuffle_seed=13).withColumnRenamed("prompt", "shuffled")
    out = corpus.cue_prompts(out, "word_list", F.lit("")).withColumnRenamed("prompt", "unprimed")
    return out.select("item_index", "labelled", "shuffled", "unprimed")


@query(
    "tx51_determiner_for",
    """WITH n AS (SELECT item_index, split_part(ta, ' ', 2) AS n FROM quartets) SELECT item_index, 'the' AS def, CASE WHEN regexp_matches(n, '^[bcdfghjklmnpqrstvwxyz]') THEN 'a' ELSE 'an' END AS indef,
  CASE WHEN n = 'baker' THEN 'an' WHEN regexp_matches(n, '^[bcdfghjklmnpqrstvwxyz]') THEN 'a' ELSE 'an' END AS stored, 'an' AS vowel FROM n""",
)
def _(t):
    noun = text.parse_active("ta")["agent"]
    return t.quartets().select(
        "item_index",
        text.determiner_for(noun, F.lit("def")).alias("def"),
        text.determiner_for(noun, F.lit("indef")).alias("indef"),
        text.determiner_for(noun, F.lit("indef"), F.when(noun == "baker", "an")).alias("stored"),
        text.determiner_for(F.concat(F.lit("Owl"), noun), F.lit("indef")).alias("vowel"),
    )


@query(
    "ag40_nonce_corpus_audit",
    """SELECT CAST(0 AS BIGINT) AS unknown_determiner_rows, CAST(0 AS BIGINT) AS bad_indefinite_article_uses, CAST(0 AS BIGINT) AS same_active_fragment_rows, CAST(0 AS BIGINT) AS same_aux_rows,
  CAST(0 AS BIGINT) AS same_det_family_rows, CAST(0 AS BIGINT) AS shared_noun_rows FROM (SELECT count(*) AS n FROM quartets) x""",
)
def _(t):
    return audits.nonce_audit(corpus.build_nonce(t.quartets()))
