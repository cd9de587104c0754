"""Sentence-structure labels as regular expressions over the token string.

Tokens contain letters and apostrophes only and are joined by single blanks, so a
closed word list is an alternation and a token boundary is a blank or an end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, text
from .core import alternation, col, let, literal_array

_END = r"(?= |$)"
_START = r"(?:^|(?<= ))"
_BE = alternation(fixed.BE_FORMS)
_BE_GET = alternation(fixed.BE_FORMS + fixed.GET_FORMS)
_ADV = rf"(?: {alternation(fixed.ADVERBS_OR_NEGATION)}{_END})*+"
_PART = rf"(?:{alternation(fixed.IRREGULAR_PARTICIPLES)}|[a-z']{{2,}}(?:ed|en)){_END}"
_NOT_BY = alternation([p for p in fixed.PREPOSITIONS if p != "by"])
_ADJECTIVAL = rf"(?:{alternation(fixed.COPULAR_PARTICIPIAL)} {_NOT_BY}{_END})"
_HAS_BY = r"(?= (?:.* )?by(?: |$))"

_PASSIVE = (
    rf"{_START}{_BE_GET}{_END}{_ADV}"
    rf"(?: being{_END}{_ADV} ({_PART})|(?! being{_END}) (?!{_ADJECTIVAL})({_PART}))(.*)$"
)
_COPULAR = (
    rf"{_START}{_BE}{_END}(?:((?: {alternation(fixed.ADVERBS_OR_NEGATION)}{_END})++)$"
    rf"|{_ADV} (?:({alternation(fixed.DETERMINERS)}{_END})"
    rf"|({alternation(fixed.PREPOSITIONS)}{_END})"
    rf"|([a-z']*{alternation(fixed.ADJECTIVE_SUFFIXES)}{_END})"
    rf"|({_PART})(?!{_HAS_BY})))"
)


def token_text(sentence: Column | str) -> Column:
    """Letter-and-apostrophe tokens of the normal form, joined by blanks."""
    found = F.regexp_extract_all(F.lower(col(sentence)), F.lit("([a-z']+)"), 1)
    return F.array_join(found, " ")


def has_token(tokens: Column, word: str) -> Column:
    return tokens.rlike(rf"(?:^| ){word}(?: |$)")


def detect_passive(tokens: Column | str) -> Column:
    """``struct(label, reason)`` of the first be/get + participle, else null."""
    t = col(tokens)
    progressive = F.regexp_extract(t, _PASSIVE, 1)
    plain = F.regexp_extract(t, _PASSIVE, 2)
    by = has_token(F.regexp_extract(t, _PASSIVE, 3), "by")
    return (
        F.when((progressive != "") & by, _pair("passive_progressive_by", "be_being_participle_by"))
        .when(
            progressive != "", _pair("passive_progressive_short", "be_being_participle_no_by")
        )
        .when((plain != "") & by, _pair("passive_by", "be_participle_by"))
        .when(plain != "", _pair("passive_short", "be_participle_no_by"))
    )


def detect_copular(tokens: Column | str) -> Column:
    """``struct(label, reason)`` of the first be-form with a nominal, prepositional,
    adjectival, participial or missing predicate, else null."""
    t = col(tokens)

    def group(i):
        return F.regexp_extract(t, _COPULAR, i) != ""

    return (
        F.when(group(2), _pair("copular_nominal", "be_det_nominal_predicate"))
        .when(group(3), _pair("copular_prepositional", "be_prepositional_predicate"))
        .when(group(4), _pair("copular_adjectival", "be_adjectival_predicate"))
        .when(group(5), _pair("copular_participial", "be_participial_no_by"))
        .when(group(1), _pair("copular_incomplete", "be_without_predicate"))
    )


def _pair(label: str, reason: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))


def is_verbish(token: Column) -> Column:
    closed = fixed.AUX_FORMS + fixed.PREPOSITIONS + fixed.DETERMINERS + fixed.PRONOUNS
    form = token.isin(*fixed.IRREGULAR_FINITE_VERBS) | token.rlike("^.{2,}(?:ed|ing|s)$") & (
        F.length(token) > 3
    )
    return F.coalesce(~token.isin(*closed) & form, F.lit(False))


def _subject(words: Column) -> tuple[Column, Column, Column]:
    """(starts like a subject, is 'DET one who', index of the verb slot)."""
    det = F.get(words, 0).isin(*fixed.DETERMINERS)
    starts = det | F.get(words, 0).isin(*fixed.SUBJECT_PRONOUNS)
    one_who = det & (F.get(words, 1) == "one") & (F.get(words, 2) == "who")
    return (
        F.coalesce(starts, F.lit(False)),
        F.coalesce(one_who, F.lit(False)),
        F.when(det, 2).otherwise(1),
    )


def _overlaps(words: Column, closed: Sequence[str]) -> Column:
    return F.arrays_overlap(words, literal_array(closed))


def _from(words: Column, index: Column | int) -> Column:
    """The words from a zero-based index on."""
    start = F.lit(index) if isinstance(index, int) else index
    return F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))


def detect_active(tokens: Column | str) -> Column:
    """``struct(label, reason)`` of a subject-verb sentence, else null.

    A bare ``to`` after the verb counts as a preposition, so no infinitival label
    can arise.
    """

    def rule(words):
        starts, one_who, slot = _subject(words)

        def with_tail(tail):
            verb = F.get(words, slot)
            object_like = fixed.DETERMINERS + fixed.PRONOUNS
            recipient = ("to", "for")
            head = F.get(tail, 0)
            rest = _from(tail, 1)
            after = F.get(tail, 1)
            progressive = (
                F.when(
                    after.isin(*object_like) & _overlaps(rest, recipient),
                    _pair("active_progressive_ditransitive", "be_ing_object_to_for"),
                )
                .when(
                    after.isin(*object_like),
                    _pair("active_progressive_transitive", "be_ing_object"),
                )
                .when(
                    after.isin(*fixed.PREPOSITIONS),
                    _pair("active_progressive_intransitive_pp", "be_ing_prepositional"),
                )
                .otherwise(_pair("active_progressive_intransitive", "be_ing_no_object"))
            )
            finite = (
                F.when(
                    F.size(tail) == 0, _pair("active_intransitive", "finite_verb_no_complement")
                )
                .when(
                    head.isin(*fixed.PREPOSITIONS),
                    _pair("active_intransitive_prepositional", "finite_verb_prepositional"),
                )
                .when(
                    head.isin(*object_like) & _overlaps(rest, recipient),
                    _pair("active_ditransitive_prepositional", "object_plus_to_for_phrase"),
                )
                .when(
                    head.isin(*object_like) & _overlaps(rest, fixed.PREPOSITIONS),
                    _pair("active_transitive_with_pp", "object_plus_prepositional_modifier"),
                )
                .when(
                    head.isin(*object_like),
                    _pair("active_transitive", "finite_verb_direct_object"),
                )
                .otherwise(_pair("active_other", "finite_verb_noncanonical_complement"))
            )
            be = verb.isin(*fixed.BE_FORMS) & (F.size(tail) > 0)
            return F.when(be & head.endswith("ing"), progressive).when(
                ~be & is_verbish(verb), finite
            )

        fits = (F.size(words) >= 3) & starts & ~one_who
        return F.when(fits, let(_from(words, slot + 1), with_tail))

    return let(F.split(col(tokens), " "), rule)


# ---- target-based class -----------------------------------------------------


def _no_stop(normal: Column) -> Column:
    return F.split(F.regexp_replace(normal, r" ?\.$", ""), " ")


def _head(phrase: Column, determiners: Sequence[str]) -> Column:
    """Last word that is no determiner, else the last word."""
    content = F.filter(phrase, lambda t: ~t.isin(*determiners))
    return F.coalesce(
        F.try_element_at(content, F.lit(-1)), F.try_element_at(phrase, F.lit(-1))
    )


def target_signature(
    active: Column | str,
    passive: Column | str,
    determiners: Sequence[str] = fixed.DETERMINERS,
) -> Column:
    """Heads of both roles and the verb keys that a sentence about this target may show.

    Both targets come in their normal form. Taken from the passive target (patient, last be-form before ``by``, participle,
    ``by``, agent), with the active verb added when the active target has the same
    phrases at its ends. Null when the passive does not parse.
    """
    a, p = _no_stop(col(active)), _no_stop(col(passive))

    def keyed(g):
        return F.when(g.isNotNull(), F.struct(g["agent_head"], g["patient_head"], _keys(g["verbs"]).alias("verb_keys")))

    return let(_target_parts(a, p, determiners), keyed)


def _keys(verbs: Column) -> Column:
    return F.transform(F.array_compact(verbs), text.verb_key)


def _target_parts(active: Column, passive: Column, determiners: Sequence[str]) -> Column:
    """``struct(agent_head, patient_head, verbs)`` of a target's words; every step is bound
    once, since an expression inside a lambda is worked out wherever it is named."""

    def with_by(w):
        pt, by = w["p"], w["by"]
        be = F.array_max(
            F.transform(
                F.slice(pt, 1, F.greatest(by - 1, F.lit(0))),
                lambda t, i: F.when(t.isin(*fixed.BE_FORMS), i + 1),
            )
        )

        def with_be(be):
            phrases = F.struct(
                _from(pt, by).alias("agent"),
                F.slice(pt, 1, F.greatest(be - 1, F.lit(0))).alias("patient"),
                F.get(pt, be).alias("participle"),
            )
            return F.when((be > 1) & (be + 1 < by), let(phrases, with_phrases))

        def with_phrases(g):
            at, agent, patient = w["a"], g["agent"], g["patient"]
            n_agent, n_patient = F.size(agent), F.size(patient)
            frame = (
                (F.size(at) > n_agent + n_patient)
                & (F.slice(at, 1, n_agent) == agent)
                & (F.slice(at, F.greatest(F.size(at) - n_patient + 1, F.lit(1)), n_patient) == patient)
            )
            return F.struct(
                _head(agent, determiners).alias("agent_head"),
                _head(patient, determiners).alias("patient_head"),
                F.array(g["participle"], F.when(frame, F.get(at, n_agent))).alias("verbs"),
            )

        return F.when((by > 0) & (F.size(pt) > by), let(be, with_be))

    def with_words(w):
        by = F.array_position(w["p"], "by").cast("int")
        return let(F.struct(w["a"], w["p"], by.alias("by")), with_by)

    return let(F.struct(active.alias("a"), passive.alias("p")), with_words)


def prepared_targets(
    active: Column | str, passive: Column | str, determiners: Sequence[str] = fixed.DETERMINERS
) -> Column:
    """What ``classify_structure`` needs of the two targets, for rows that classify several sentences."""
    both = F.struct(text.normalize_generated(active).alias("a"), text.normalize_generated(passive).alias("p"))
    return let(
        both,
        lambda w: F.struct(
            w["a"], w["p"], _target_parts(_no_stop(w["a"]), _no_stop(w["p"]), determiners).alias("parts")
        ),
    )


def classify_structure(
    sentence: Column | str,
    active: Column | str | None = None,
    passive: Column | str | None = None,
    determiners: Sequence[str] = fixed.DETERMINERS,
    prepared: Column | str | None = None,
) -> Column:
    """active/passive _exact, _prefix or _structural against the two targets, else other.

    ``prepared`` (see ``prepared_targets``) stands for the two targets.
    """
    own = text.normalize_generated(sentence).alias("s")
    if prepared is None:
        a, p = text.normalize_generated(active), text.normalize_generated(passive)
        whole = F.struct(own, a.alias("a"), p.alias("p"))
    else:
        whole = F.struct(own, col(prepared)["a"], col(prepared)["p"], col(prepared)["parts"])

    def has_verb(span, keys):
        return F.exists(span, lambda t: F.array_contains(keys, text.verb_key(t)))

    def structural(tokens, g):
        places = F.struct(
            F.array_position(tokens, g["agent_head"]).cast("int").alias("agent"),
            F.array_position(tokens, g["patient_head"]).cast("int").alias("patient"),
        )

        def between(at):
            agent, patient = at["agent"], at["patient"]
            low, high = F.least(agent, patient), F.greatest(agent, patient)
            span = F.slice(tokens, low + 1, F.greatest(high - low - 1, F.lit(0)))
            words = let(span, lambda s: F.struct(s.alias("s"), F.array_position(s, "by").cast("int").alias("by")))

            def by_order(w):
                s, by = w["s"], w["by"]
                before = F.slice(s, 1, F.greatest(by - 1, F.lit(0)))
                be = F.exists(before, lambda t: t.isin(*fixed.BE_FORMS))
                return F.when(
                    (agent < patient) & (by == 0),
                    F.when(let(_keys(g["verbs"]), lambda keys: has_verb(s, keys)), "active_structural"),
                ).when(
                    (patient < agent) & (by > 0) & be,
                    F.when(let(_keys(g["verbs"]), lambda keys: has_verb(before, keys)), "passive_structural"),
                )

            return F.when((agent > 0) & (patient > 0), let(words, by_order))

        return let(places, between)

    def decide(w):
        s, a, p = w["s"], w["a"], w["p"]
        # the signature is worked out only for sentences that no target starts
        loose = let(
            _target_parts(_no_stop(a), _no_stop(p), determiners) if prepared is None else w["parts"],
            lambda g: F.when(g.isNotNull(), let(_no_stop(s), lambda tokens: structural(tokens, g))),
        )
        return (
            F.when(s == a, "active_exact")
            .when(s == p, "passive_exact")
            .when(s.startswith(a), "active_prefix")
            .when(s.startswith(p), "passive_prefix")
            .otherwise(F.coalesce(loose, F.lit("other")))
        )

    return let(whole, decide)


# ---- cascade ----------------------------------------------------------------


def label_structure(
    df: DataFrame,
    sentence: str,
    active: str = "target_active",
    passive: str = "target_passive",
) -> DataFrame:
    """Add the detailed label, the voice and the reason.

    Order: empty, target-based, coordination, relative identity, passive, copular,
    active, then the leftovers.
    """
    s = "__tokens"
    work = (
        df.withColumn("__raw", F.regexp_replace(F.coalesce(F.col(sentence), F.lit("")), r"^\s+|\s+$", ""))
        .withColumn(s, token_text(text.normalize_generated("__raw")))
        .withColumns(
            {
                "__target": classify_structure("__raw", active, passive),
            }
        )
    )
    tokens = F.col(s)
    target = F.col("__target")
    words = F.split(tokens, " ")

    def out(label, voice, reason):
        return F.struct(
            (F.lit(label) if isinstance(label, str) else label).alias("label"),
            F.lit(voice).alias("voice"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        )

    def tagged(suffix):
        return F.concat(F.lit("target_"), target, F.lit(suffix))

    to_for = has_token(tokens, "(?:to|for)")
    being, by = has_token(tokens, "being"), has_token(tokens, "by")
    act, pas = target.startswith("active"), target.startswith("passive")
    rules = [
        (F.col("__raw") == "", out("other_empty", "other", "empty_sentence")),
        (tokens == "", out("other_empty", "other", "no_word_tokens")),
        (act & to_for, out("active_target_ditransitive_like", "active", tagged("_to_for"))),
        (act & being, out("active_target_progressive_like", "active", tagged("_being"))),
        (act, out("active_target_transitive_like", "active", tagged(""))),
        (pas & being & by, out("passive_target_progressive_by", "passive", tagged("_being_by"))),
        (pas & by, out("passive_target_by", "passive", tagged("_by"))),
        (pas, out("passive_target_short", "passive", tagged("_short"))),
        (
            text.has_coordination(words, "__raw"),
            out("other_coordinate_multiclause", "other", "coordination_with_punctuation"),
        ),
        (
            text.is_relative_identity(tokens),
            out("other_relative_identity_clause", "other", "one_who_did_it_pattern"),
        ),
    ]
    leftovers = [
        (
            has_token(tokens, "who"),
            out("other_relative_clause_misc", "other", "relative_marker_without_confident_parse"),
        ),
        (
            has_token(tokens, alternation(fixed.PREPOSITIONS)),
            out("other_prepositional_misc", "other", "prepositional_without_confident_parse"),
        ),
    ]

    def first(rules, decided):
        for condition, result in reversed(rules):
            decided = F.when(condition, result).otherwise(decided)
        return decided

    def found(hit, voice):
        return let(hit, lambda h: F.when(h.isNotNull(), out(h["label"], voice, h["reason"])))

    # a detector is only asked about sentences that the rules before it leave
    decided = first(
        rules,
        F.coalesce(
            found(detect_passive(s), "passive"),
            found(detect_copular(s), "other"),
            found(detect_active(s), "active"),
            first(leftovers, out("other_unclassified", "other", "fallback_unclassified")),
        ),
    )
    return (
        work.withColumn("__out", decided)
        .withColumns(
            {
                "generation_class_detailed": F.col("__out.label"),
                "generation_voice_auto": F.col("__out.voice"),
                "generation_structure_reason": F.col("__out.reason"),
            }
        )
        .drop("__raw", s, "__target", "__out")
    )


def human_heads(df: DataFrame, active: str = "target_active") -> DataFrame:
    """Distinct agent and patient nouns of all active targets."""
    w = F.split(token_text(active), " ")
    fits = (
        (F.size(w) >= 5)
        & F.get(w, 0).isin(*fixed.DETERMINERS)
        & F.get(w, 3).isin(*fixed.DETERMINERS)
    )
    return (
        df.where(fits)
        .select(F.explode(F.array(F.get(w, 1), F.get(w, 4))).alias("head"))
        .distinct()
    )


def label_arguments(
    df: DataFrame, sentence: str, active: str = "target_active", compat: bool = False
) -> DataFrame:
    """Add argument structure, role frame, note and the two promotion flags.

    The object is looked up among the heads of all targets by a join, so the head
    list may be of any size. ``compat`` compares only the stemmed object with the
    theme lists, under which ``something`` and ``news`` never match.
    """
    raw = F.regexp_replace(F.coalesce(F.col(sentence), F.lit("")), r"^\s+|\s+$", "")
    work = df.withColumn("__tokens", token_text(raw)).withColumn("__words", F.split("__tokens", " "))
    words = F.col("__words")
    starts, one_who, slot = _subject(words)
    ing = (
        F.get(words, slot).isin(*fixed.BE_FORMS)
        & F.coalesce(F.get(words, slot + 1).endswith("ing"), F.lit(False))
    )
    verb_at = F.when(ing, slot + 1).otherwise(slot)

    def noun_phrase(t, start):
        """struct(head, next) of an object starting at ``start``, else null."""
        tok = F.get(t, start)
        after = F.get(t, start + 1)
        single = tok.isin(*fixed.THEME_PRONOUNS, *fixed.PRONOUNS)

        def made(head, nxt):
            return F.struct(head.alias("head"), nxt.cast("int").alias("next"))

        return (
            F.when(single, made(tok, start + 1))
            .when(
                tok.isin(*fixed.DETERMINERS) & after.isNotNull(), made(after, start + 2)
            )
            .when(tok.isin(*fixed.DETERMINERS), made(tok, start + 1))
        )

    work = work.withColumns(
        {
            "__verb": F.get(words, verb_at),
            "__tail": _from(words, F.least(verb_at + 1, F.size(words))),
        }
    )
    tail = F.col("__tail")
    skipped = F.filter(
        F.transform(
            tail, lambda t, i: F.when(~t.isin(*fixed.ADVERBS_OR_NEGATION), i)
        ),
        lambda i: i.isNotNull(),
    )
    work = work.withColumn("__at", F.coalesce(F.get(skipped, 0), F.size("__tail")))
    at = F.col("__at")
    particle = F.coalesce(F.get(tail, at).isin(*fixed.PARTICLES), F.lit(False))
    work = work.withColumns(
        {"__direct": noun_phrase(tail, at), "__phrasal": F.when(particle, noun_phrase(tail, at + 1))}
    ).withColumns(
        {
            "__object": F.coalesce("__direct", "__phrasal"),
            "__particle": F.col("__direct").isNull() & F.col("__phrasal").isNotNull(),
        }
    )
    rest = _from(tail, F.least(F.col("__object.next"), F.size(tail)))
    recipient = F.coalesce(
        F.array_join(rest, " ").rlike(
            rf"(?:^| )(?:to|for) {alternation(fixed.DETERMINERS + fixed.PRONOUNS)}(?: |$)"
        ),
        F.lit(False),
    )
    head = F.col("__object.head")
    stem = text.verb_key(head)
    themes = fixed.THEME_PRONOUNS + fixed.THEME_NOUNS
    theme = stem.isin(*themes) | text.verb_key("__verb").isin(*fixed.THEME_VERBS)
    if not compat:
        theme = theme | head.isin(*themes)
    work = work.withColumns({"__recipient": recipient, "__stem": stem, "__theme": theme})
    heads = human_heads(df, active).select(
        F.col("head").alias("__ask"), F.lit(True).alias("__is_head")
    )
    # Most rows have no stem to look up: they are spread by a key that no head can equal.
    nothing = F.concat(F.lit("\0"), F.pmod(F.xxhash64("__tokens", "__verb"), F.lit(4096)).cast("string"))
    work = work.withColumn("__ask", F.coalesce("__stem", nothing)).join(heads, "__ask", "left").drop("__ask")
    human = F.col("__is_head").isNotNull() | F.col("__stem").isin(*fixed.PRONOUNS)

    def out(structure, frame, note, strict=False, lax=False):
        note = F.lit(note) if isinstance(note, str) else note
        return F.struct(
            F.lit(structure).alias("structure"),
            F.lit(frame).alias("frame"),
            note.alias("note"),
            F.lit(strict).alias("strict"),
            F.lit(lax).alias("lax"),
        )

    used = F.col("__particle")
    rules = [
        (F.col("__tokens") == "", out("unknown", "unknown", "empty_sentence")),
        (
            detect_passive("__tokens").isNotNull(),
            out("passive_like", "patient>(agent)", "passive_pattern_detected"),
        ),
        (
            detect_copular("__tokens").isNotNull(),
            out("copular_like", "theme>predicate", "copular_pattern_detected"),
        ),
        (
            text.has_coordination(words, raw),
            out("multiclause", "mixed", "coordination_detected"),
        ),
        (~starts, out("unknown", "unknown", "noncanonical_subject_start")),
        (one_who, out("relative_identity", "referent>predicate", "one_who_pattern")),
        (slot >= F.size(words), out("unknown", "unknown", "no_verb_slot")),
        (~is_verbish(F.col("__verb")), out("unknown", "unknown", "verb_not_confident")),
        (
            F.col("__object").isNull(),
            out(
                "active_nonobject", "single_core_argument(+oblique)", "no_direct_object_detected"
            ),
        ),
        (
            F.col("__recipient"),
            out(
                "active_ditransitive_prepositional",
                "agent>theme>recipient",
                "direct_object_plus_to_for_recipient",
                lax=True,
            ),
        ),
        (
            F.col("__theme"),
            out(
                "active_monotransitive_theme",
                "agent>theme",
                F.when(used, "phrasal_verb_with_theme_object").otherwise(
                    "object_inferred_as_theme"
                ),
                lax=True,
            ),
        ),
    ]
    decided = out(
        "active_monotransitive_patient",
        "agent>patient",
        F.when(used, "phrasal_verb_with_patient_object")
        .when(human, "object_inferred_as_patient_human")
        .otherwise("object_inferred_as_patient_default"),
        strict=True,
        lax=True,
    )
    for condition, result in reversed(rules):
        decided = F.when(condition, result).otherwise(decided)
    hidden = [c for c in work.columns if c.startswith("__")]
    return (
        work.withColumn("__arg", decided)
        .withColumns(
            {
                "argument_structure_inferred": F.col("__arg.structure"),
                "role_frame_inferred": F.col("__arg.frame"),
                "argument_inference_note": F.col("__arg.note"),
                "inferred_strict_active": F.col("__arg.strict"),
                "inferred_lax_active": F.col("__arg.lax"),
            }
        )
        .drop("__arg", *hidden)
    )


def binary_class(
    detailed: Column | str,
    inferred_active: Column | str | None = None,
    active: Sequence[str] = fixed.STRICT_ACTIVE,
    passive: Sequence[str] = fixed.STRICT_PASSIVE,
) -> Column:
    """active / passive / other; an ``other`` that is no passive is promoted when flagged."""
    label = col(detailed)
    out = F.when(label.isin(*active), "active").when(label.isin(*passive), "passive")
    if inferred_active is not None:
        out = out.when(col(inferred_active) & ~label.startswith("passive"), "active")
    return out.otherwise("other")


def add_binary_classes(df: DataFrame) -> DataFrame:
    """Strict and lax classes plus their review flags."""
    label = "generation_class_detailed"
    return df.withColumns(
        {
            "generation_class_strict": binary_class(label, "inferred_strict_active"),
            "generation_class_lax": binary_class(
                label, "inferred_lax_active", fixed.LAX_ACTIVE, fixed.LAX_PASSIVE
            ),
        }
    ).withColumns(
        {
            "review_remaining_strict": F.col("generation_class_strict") == "other",
            "review_remaining_lax": F.col("generation_class_lax") == "other",
        }
    )
