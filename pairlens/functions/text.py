"""Sentence normal forms, tokens, parses, verb forms and short text rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .core import alternation, col, first_rule, let, literal_array, literal_map

# ---- normal forms -----------------------------------------------------------


def compact(text: Column | str) -> Column:
    """Whitespace runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def pretty_sentence(text: Column | str, commas: bool = True) -> Column:
    body = F.replace(compact(text), F.lit(" ."), F.lit("."))
    if commas:
        body = F.replace(body, F.lit(" ,"), F.lit(","))
    return F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 2**30))


def normalize_generated(text: Column | str) -> Column:
    """Lower case, full stops set off, single blanks."""
    return compact(F.replace(F.lower(col(text)), F.lit("."), F.lit(" . ")))


def sentence_key(text: Column | str) -> Column:
    """Match key: lower, no double quotes, every punctuation mark set off by blanks."""
    body = F.replace(F.lower(F.coalesce(col(text), F.lit(""))), F.lit('"'), F.lit(""))
    body = F.regexp_replace(compact(body), r"\s+([.?!,;:])", "$1")
    return compact(F.regexp_replace(body, r"([.?!,;:])", " $1 "))


def review_key(text: Column | str) -> Column:
    """First 16 hex digits of the sha1 of the lower-case compact text."""
    return F.substring(F.sha1(F.lower(compact(text))), 1, 16)


def sentences_match(declared: Column | str, found: Column | str) -> Column:
    def bare(c):
        return F.lower(F.regexp_replace(F.regexp_replace(col(c), r"\s+", " "), r"^[ .]+|[ .]+$", ""))

    return bare(declared) == bare(found)


def first_sentence(text: Column | str) -> Column:
    """Up to the first full stop, which is set off by a blank; quotes dropped."""
    body = F.translate(F.regexp_replace(col(text), r"^\s+|\s+$", ""), '\n"', " ")
    body = F.trim(body)
    head = F.trim(F.split_part(body, F.lit("."), F.lit(1)))
    return F.when(body.contains("."), F.concat(head, F.lit(" ."))).otherwise(body)


def first_clause(text: Column | str, separators: Sequence[str] = (".", "?", "!", ";")) -> Column:
    """Cut at the first separator *of the list* that occurs, whatever its place."""
    body = F.replace(compact(text), F.lit("’"), F.lit("'"))

    def cut(b):
        out = b
        for sep in reversed(list(separators)):
            out = F.when(b.contains(sep), F.trim(F.split_part(b, F.lit(sep), F.lit(1)))).otherwise(out)
        return out

    return let(body, cut)


def between_markers(
    text: Column | str, opening: str = 'Mary answered, "', closing: str = '"'
) -> Column:
    """``struct(context, answer)`` around the first marked answer; no marker is an error."""

    def cut(t):
        start = F.locate(opening, t)
        answer_at = start + len(opening)
        rest = F.substring(t, answer_at, F.lit(2**30))
        length = F.locate(closing, rest) - 1
        return F.struct(
            F.substring(t, F.lit(1), answer_at - 1).alias("context"),
            F.when((start > 0) & (length > 0), F.substring(rest, F.lit(1), length))
            .otherwise(F.raise_error(F.lit("no marked answer in text")))
            .alias("answer"),
        )

    return let(col(text), cut)


def join_candidate(prefix: Column | str, candidate: Column | str) -> Column:
    """Blank before the candidate unless one side already separates them."""
    p, c = col(prefix), col(candidate)
    separated = (c == "") | c.rlike(r"^\s") | (p == "") | p.rlike("[ \\n\\t\"']$")
    return F.when(separated, c).otherwise(F.concat(F.lit(" "), c))


# ---- tokens -----------------------------------------------------------------


def words(text: Column | str, apostrophe: bool = False) -> Column:
    """Lower-case letter runs, with sentence marks, or with inner apostrophes instead."""
    pattern = r"([a-z]+(?:'[a-z]+)?)" if apostrophe else r"([a-z]+|[.?!])"
    return F.regexp_extract_all(F.lower(col(text)), F.lit(pattern), 1)


def plain_tokens(text: Column | str, mode: str = "final_period", lower: bool = True) -> Column:
    """Blank-separated tokens.

    ``final_period`` drops lone full stops and the one that ends the text,
    ``all_punctuation`` drops every full stop and comma, ``letters`` keeps letters,
    apostrophes and hyphens only.
    """
    body = col(text)
    if mode == "final_period":
        body = F.regexp_replace(body, r"(?<!\S)\.(?!\S)", " ")
        body = F.regexp_replace(body, r"\.\s*$", "")
    elif mode == "all_punctuation":
        body = F.translate(body, ".,", "  ")
    elif mode == "letters":
        body = F.regexp_replace(body, r"[^A-Za-z'\- ]+", " ")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if lower:
        body = F.lower(body)
    return F.filter(F.split(compact(body), " "), lambda t: t != "")


def pool_words(entry: str) -> list[str]:
    """What ``plain_tokens(mode="all_punctuation")`` gives for an entry of a fixed pool."""
    body = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("[.,]", " ", entry).lower())
    return [t for t in body.split(" ") if t]


def split_tokens(text: Column | str) -> Column:
    """Blank-separated lower-case tokens, punctuation kept."""
    return F.split(F.lower(compact(text)), " ")


def nonstop_words(text: Column | str) -> Column:
    """Distinct letters-only tokens that are not function words."""
    return F.array_distinct(
        F.filter(
            split_tokens(text),
            lambda t: t.rlike("^[a-z]+$") & ~t.isin(*fixed.AUDIT_FUNCTION_WORDS),
        )
    )


# ---- sentence parses --------------------------------------------------------


def parse_active(text: Column | str, strict: bool = True, final_stop: bool = False) -> Column:
    """``struct(det, agent, verb, patient_det, patient)`` of an active sentence, else null."""

    def parts(t):
        fits = F.size(t) == 6 if strict else F.size(t) >= 5
        if final_stop:
            fits = fits & (F.get(t, 5) == ".")
        return F.when(
            fits,
            F.struct(
                F.get(t, 0).alias("det"),
                F.get(t, 1).alias("agent"),
                F.get(t, 2).alias("verb"),
                F.get(t, 3).alias("patient_det"),
                F.get(t, 4).alias("patient"),
            ),
        )

    return let(split_tokens(text) if strict else plain_tokens(text), parts)


def parse_passive(text: Column | str, check_by: bool = False) -> Column:
    """``struct(det, patient, aux, participle, agent_det, agent)`` of a passive, else null."""

    def parts(t):
        fits = F.size(t) == 8
        if check_by:
            fits = fits & (F.get(t, 4) == "by") & (F.get(t, 7) == ".")
        return F.when(
            fits,
            F.struct(
                F.get(t, 0).alias("det"),
                F.get(t, 1).alias("patient"),
                F.get(t, 2).alias("aux"),
                F.get(t, 3).alias("participle"),
                F.get(t, 5).alias("agent_det"),
                F.get(t, 6).alias("agent"),
            ),
        )

    return let(split_tokens(text), parts)


def role_bundle(active: Column, passive: Column, lemma: Column | None = None) -> Column:
    """Agent, patient and verb forms when both parses name the same roles, else null."""
    agree = (
        (active["patient_det"] == passive["det"])
        & (active["patient"] == passive["patient"])
        & (active["det"] == passive["agent_det"])
        & (active["agent"] == passive["agent"])
    )
    lemma = infer_lemma(active["verb"]) if lemma is None else lemma
    return F.when(
        agree,
        F.struct(
            active["det"].alias("agent_det"),
            active["agent"].alias("agent_noun"),
            active["patient_det"].alias("patient_det"),
            active["patient"].alias("patient_noun"),
            active["verb"].alias("active_verb_form"),
            passive["participle"].alias("passive_verb_form"),
            lemma.alias("verb_lemma"),
        ),
    )


def det_family(det: Column | str) -> Column:
    det = F.lower(col(det))
    return F.when(det == "the", "def").when(det.isin("a", "an"), "indef").otherwise("unknown")


def aux_tense(aux: Column | str) -> Column:
    aux = F.lower(col(aux))
    return F.when(aux == "is", "present").when(aux == "was", "past").otherwise("unknown")


def cell(active: Column, passive: Column) -> Column:
    """``{determiner family}_{tense}``; unequal families give ``mixed``."""
    family = det_family(active["det"])
    same = det_family(active["patient_det"]) == family
    return F.concat_ws("_", F.when(same, family).otherwise("mixed"), aux_tense(passive["aux"]))


def verb_tense(form: Column | str, known: Column | None = None, lenient: bool = False) -> Column:
    """Tense of a finite form: the looked-up one, else by suffix.

    ``lenient`` takes every form without a final s as past.
    """
    form = F.lower(col(form))
    if lenient:
        guess = F.when(form.endswith("s"), "present").when(form != "", "past").otherwise("unknown")
    else:
        guess = (
            F.when(form.endswith("ed"), "past")
            .when(form.endswith("s"), "present")
            .otherwise("unknown")
        )
    return guess if known is None else F.coalesce(known, guess)


def content_frame(text: Column | str) -> Column:
    """``noun|verb|noun`` by position of a sentence of five words or more, else empty."""
    return let(
        words(text),
        lambda t: F.when(
            F.size(t) >= 5, F.concat_ws("|", F.get(t, 1), F.get(t, 2), F.get(t, 4))
        ).otherwise(""),
    )


def finite_verb(text: Column | str) -> Column:
    """Third word of a sentence of five words or more, else empty."""
    return let(words(text), lambda t: F.when(F.size(t) >= 5, F.get(t, 2)).otherwise(""))


def event_fields(text: Column | str) -> Column:
    """``struct(agent_phrase, patient_phrase, verb)``; ``by`` at token 4 or later is a passive."""

    def phrase(t, start):
        return F.concat_ws(" ", F.slice(t, start, 2))

    def parts(t):
        by = F.array_position(t, "by").cast("int")  # one-based, 0 when absent
        passive = (F.size(t) >= 7) & (by >= 5) & (by + 2 <= F.size(t))
        return F.when(
            F.size(t) >= 5,
            F.when(
                passive,
                F.struct(
                    phrase(t, F.greatest(by + 1, F.lit(1))).alias("agent_phrase"),
                    phrase(t, F.lit(1)).alias("patient_phrase"),
                    F.get(t, by - 2).alias("verb"),
                ),
            ).otherwise(
                F.struct(
                    phrase(t, F.lit(1)).alias("agent_phrase"),
                    phrase(t, F.lit(4)).alias("patient_phrase"),
                    F.get(t, 2).alias("verb"),
                )
            ),
        )

    return let(plain_tokens(text), parts)


# ---- verb forms -------------------------------------------------------------
# Each rule list is tried in order; the first pattern that matches rewrites the form.

_SIBILANT = r"^(?=.{5,}$)(.*(?:ch|sh|ss|x|z|o))es$"
_KEY_Y = r"^(.{2,})(?:ies|ied)$"
#: In the order of the alternatives; only groups of the one that fits are not empty. A form in -es that
#: the sibilants do not take loses its s like any other.
_KEY_REST = (
    r"^(?:(.+)([^aeiou])\2ing|(.{3,})ing|(.+)([^aeiou])\5ed|(.{3,})ed"
    r"|(?=.{5,}$)(.*(?:ch|sh|ss|x|z|o|g))es|(.{3,})s)$"
)
_THIRD_PERSON_RULES = (
    (r"^(.{2,})ies$", "$1y"),
    (_SIBILANT, "$1"),
    (r"^(.{2,})es$", "$1e"),
    (r"^(.{2,}[^s])s$", "$1"),
)
_PAST_RULES = (
    (r"^(.{2,})ied$", "$1y"),
    (r"^(.+)(.)\2ed$", "$1$2"),
    (r"^(.{3,})ed$", "$1"),
)
_PAIR_RULES = ((r"^(.+)ies$", "$1y"), (r"^(.+)es$", "$1"), (r"^(.+)s$", "$1"))
_ING_PAST = ((r"^(.{2,})ied$", "$1y"), (r"^(.{3,})ed$", "$1"))
_ING_PRESENT = (
    (r"^(.{2,})ies$", "$1y"),
    (_SIBILANT, "$1"),
    (r"^(.{2,})es$", "$1e"),
    (r"^(.{3,})s$", "$1"),
)
_ING_E = ((r"^(.+)ie$", "$1ying"), (r"^(.*(?<![eoy]))e$", "$1ing"))
_ING_Y = ((r"^(.+y)$", "$1ing"),)
_ING_DOUBLE = ((r"^(.*[^aeiou][aeiou]([^aeiouy]))$", "$1$2ing"),)
_NOMINAL_DOUBLE = ((r"^(.*[^aeiou][aeiou]([^aeiouwxy]))$", "$1$2ing"),)


def _ing(token: Column) -> Column:
    return F.concat(token, F.lit("ing"))


def verb_key(token: Column | str) -> Column:
    """Rough stem that lets the forms of one verb meet."""

    def key(t):
        rest = F.regexp_replace(t, _KEY_REST, "$1$2$3$4$5$6$7$8")
        return F.when(t.rlike(_KEY_Y), F.regexp_replace(t, _KEY_Y, "$1y")).otherwise(rest)

    return let(F.lower(col(token)), key)


def lemma_3sg(form: Column | str, past: bool = False, empty: str = "do") -> Column:
    """Lemma of a third-person form by suffix; ``past`` also undoes -ed."""
    rules = (_PAST_RULES if past else ()) + _THIRD_PERSON_RULES
    tidy = F.lower(F.trim(col(form)))
    return let(tidy, lambda t: F.when(t == "", empty).otherwise(first_rule(t, rules, t)))


def infer_lemma(form: Column | str) -> Column:
    """Suffix rules used when a (finite, participle) pair is not in the verb table."""
    return let(F.lower(col(form)), lambda t: first_rule(t, _PAIR_RULES, t))


def to_ing(
    form: Column | str,
    variant: str = "finite",
    overrides: Mapping[str, str] | None = None,
) -> Column:
    """-ing form.

    ``finite`` first undoes -ed and -s and doubles a final consonant unless -ed was
    undone; ``participle`` is the same after a table of irregular participles;
    ``nominal`` takes a lemma and doubles except w, x, y; ``label`` never doubles.
    """
    if variant not in ("finite", "participle", "nominal", "label"):
        raise ValueError(f"unknown variant {variant!r}")
    tidy = F.lower(F.trim(col(form)))
    table = dict(overrides or {})
    if variant == "participle":
        table = {**fixed.IRREGULAR_ING, **table}
    if variant == "nominal":
        table = {**fixed.NOMINAL_OVERRIDES, **table}
    if variant == "label":
        table = {**fixed.LABEL_ING, **table}

    if variant == "nominal":
        body = lambda t: first_rule(t, _ING_E + _NOMINAL_DOUBLE, _ing(t))
    elif variant == "label":
        body = lambda t: first_rule(t, _ING_E + _ING_Y, _ing(t))
    else:

        def body(t):
            past = let(t, lambda x: first_rule(x, _ING_PAST, x))
            base = let(past, lambda x: first_rule(x, _ING_PRESENT, x))
            undone = t.rlike(_ING_PAST[0][0]) | t.rlike(_ING_PAST[1][0])
            return let(
                base,
                lambda b: F.when(undone, first_rule(b, _ING_E + _ING_Y, _ing(b))).otherwise(
                    first_rule(b, _ING_E + _ING_Y + _ING_DOUBLE, _ing(b))
                ),
            )

    empty = "" if variant == "label" else "doing"
    out = let(tidy, lambda t: F.when(t == "", empty).otherwise(body(t)))
    if variant == "label":
        out = F.when(tidy.isin("s", "ed"), "").otherwise(out)
    return F.coalesce(literal_map(table)[tidy], out) if table else out


def stems(word: Column | str) -> Column:
    """The word and its possible stems by suffix, in order, without repeats."""

    def cut(w):
        parts = [F.array(w)]
        for suffix in fixed.STEM_SUFFIXES:
            base = F.substring(w, F.lit(1), F.length(w) - len(suffix))
            fits = w.endswith(suffix) & (F.length(w) > len(suffix) + 1)
            found = [F.when(fits, base)]
            chopped = F.substring(w, F.lit(1), F.length(w) - len(suffix) - 1)
            if suffix == "ed":
                found.append(F.when(fits & base.endswith("i"), F.concat(chopped, F.lit("y"))))
            if suffix == "s":
                found.append(F.when(fits & base.endswith("e"), chopped))
            parts.append(F.array(*found))
        return F.array_distinct(F.filter(F.concat(*parts), lambda s: s.isNotNull()))

    return let(col(word), cut)


def determiner_for(
    noun: Column | str, family: Column | str, known: Column | None = None
) -> Column:
    """the / a / an for a noun; a stored article wins over the first-letter rule."""
    noun = col(noun)
    by_letter = F.when(F.lower(noun).rlike("^[bcdfghjklmnpqrstvwxyz]"), "a").otherwise("an")
    if known is not None:
        by_letter = F.coalesce(F.when(known.isin("a", "an"), known), by_letter)
    family = col(family)
    return F.when(family == "def", "the").when(family == "indef", by_letter)


# ---- answers ----------------------------------------------------------------


def content_answer_words(text: Column | str) -> Column:
    return F.filter(
        words(text, apostrophe=True), lambda t: ~t.isin(*fixed.SIMPLE_DETERMINERS)
    )


def head_noun(answer: Column | str) -> Column:
    """Last word that is no determiner, else empty."""
    return let(
        content_answer_words(answer),
        lambda t: F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit("")),
    )


def normalize_answer(
    raw: Column | str, correct_head: Column | str, foil_head: Column | str
) -> Column:
    """``the X``: correct head, else foil head, else the word after was, else the first content word."""
    correct, foil = col(correct_head), col(foil_head)

    def pick(both):
        body, tokens = both["body"], both["tokens"]
        was = F.lower(
            F.regexp_extract(body, r"(?i)\bwas\s+(?:the|a|an)?\s*([A-Za-z]+)\b", 1)
        )
        first = F.get(F.filter(tokens, lambda t: ~t.isin(*fixed.SIMPLE_DETERMINERS)), 0)
        the = F.lit("the ")
        other = let(
            was,
            lambda w: F.when(w != "", F.concat(the, w)).otherwise(
                F.coalesce(F.concat(the, first), F.lit(""))
            ),
        )
        return (
            F.when((correct != "") & F.array_contains(tokens, correct), F.concat(the, correct))
            .when((foil != "") & F.array_contains(tokens, foil), F.concat(the, foil))
            .otherwise(other)
        )

    body = F.trim(F.regexp_replace(first_clause(raw), r"(?i)^answer\s*:\s*", ""))
    whole = let(
        body,
        lambda t: F.struct(t.alias("body"), words(t, apostrophe=True).alias("tokens")),
    )
    return let(whole, pick)


def evaluate_answer(
    raw: Column | str,
    normalized: Column | str,
    correct_head: Column | str,
    foil_head: Column | str,
) -> Column:
    """correct / foil / ambiguous / other from the raw and the normalised words."""
    correct, foil = col(correct_head), col(foil_head)
    universe = F.concat(words(raw, apostrophe=True), words(normalized, apostrophe=True))

    def label(u):
        c = (correct != "") & F.array_contains(u, correct)
        f = (foil != "") & F.array_contains(u, foil)
        return (
            F.when(c & f, "ambiguous").when(c, "correct").when(f, "foil").otherwise("other")
        )

    return let(universe, label)


def round_robin(pool: Sequence[str], index: Column | str) -> Column:
    """Entry ``index mod size`` of a fixed pool."""
    return F.get(literal_array(pool), F.pmod(col(index), F.lit(len(pool))).cast("int"))


def has_coordination(token_array: Column, raw: Column | str) -> Column:
    raw = col(raw)
    return F.arrays_overlap(token_array, literal_array(fixed.CONJUNCTIONS)) & (
        raw.contains(",") | raw.contains(";")
    )


def is_relative_identity(token_text: Column) -> Column:
    """`the one who did it was ...`, or a person with a who-clause and a be-form."""
    be = alternation(fixed.BE_FORMS)
    first = token_text.rlike(rf"^the one who did it {be} \S+")
    det = alternation(fixed.DETERMINERS)
    second = (
        token_text.rlike(rf"^{det} (?:man|woman|person)(?: \S+){{6,}}$")
        & token_text.rlike(r"(?:^| )who(?: |$)")
        & token_text.rlike(rf"(?:^| ){be}(?: |$)")
    )
    return first | second
