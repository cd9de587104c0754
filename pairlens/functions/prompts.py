"""Prompt text from sentence parts. Absent sections are null and drop out of the joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .core import col, let, literal_array

# --- fixed values: prompt wording --------------------------------------------
QUESTION_LINE = 'Bridget asked, "What happened?"'
ANSWER_OPENING = 'Mary answered, "'
UNRELATED_SCENE = "In another scene, something unrelated happened."
ROLE_WORDING = {
    "did_to": ("The one who did it was ", "The one it happened to was "),
    "responsible_affected": ("The responsible person was ", "The affected person was "),
}
QUOTES = {"mary_answered": (ANSWER_OPENING, '"'), "said_mary": ('"', '" said Mary.')}
DOER_QUESTION = "In the {event_reference}, who was the doer?"
ACTED_ON_QUESTION = "In the {event_reference}, who was the one acted on?"
DOER_PREFIX = "Answer: The doer was the"
ACTED_ON_PREFIX = "Answer: The one acted on was the"
CUE_TEMPLATES = {
    "word_list": "Use these words in one sentence: {cues}",
    "role_labeled": "Event roles: {cues}",
    "cue_list": "{cues}",
    "another_event": "Another event: {cues}.",
    "same_kind_event": "Different people, same kind of event: {cues}.",
}


def lines(*parts: Column | str) -> Column:
    """Parts joined by line breaks; null parts are left out. Plain strings are literals."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def sections(*parts: Column) -> Column:
    """Non-blank parts separated by an empty line."""
    filled = [F.when(F.trim(p) != "", p) for p in parts]
    return F.regexp_replace(F.concat_ws("\n\n", *filled), r"\s+$", "")


def tidy_lines(value: Column | str) -> Column:
    """Blanks at line ends and blank ends of the text removed."""
    body = F.regexp_replace(col(value), r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def article(word: Column) -> Column:
    return F.when(F.lower(word).rlike("^[aeiou]"), "an").otherwise("a")


def role_lines(
    agent: Column, patient: Column, role_order: Column | str, style: str = "did_to"
) -> Column:
    """Who did it and whom it happened to, in the stated order."""
    did, suffered = ROLE_WORDING[style]
    a = F.concat(F.lit(did), agent, F.lit("."))
    p = F.concat(F.lit(suffered), patient, F.lit("."))
    order = col(role_order)
    return F.when(order == "agent_first", lines(a, p)).when(
        order == "patient_first", lines(p, a)
    )


def event_sentence(agent: Column, patient: Column, label: Column) -> Column:
    """The event line; an empty label (nonce verbs) gives the neutral wording."""
    return let(
        label,
        lambda e: F.concat(
            F.lit("There was "),
            F.when(e == "", "an event").otherwise(F.concat_ws(" ", article(e), e, F.lit("event"))),
            F.lit(" involving "),
            agent,
            F.lit(" and "),
            patient,
            F.lit("."),
        ),
    )


def verb_event_label(verb: Column, variant: str = "finite") -> Column:
    """-ing label of a verb; the bare fragments s and ed have none."""
    return F.when(F.lower(F.trim(verb)).isin("s", "ed"), "").otherwise(text.to_ing(verb, variant))


def target_event_prompt(
    agent: Column, patient: Column, verb: Column, role_order: Column | str
) -> Column:
    """Event line, role lines and the open question of a target."""
    return lines(
        event_sentence(agent, patient, verb_event_label(verb)),
        role_lines(agent, patient, role_order),
        "",
        QUESTION_LINE,
        ANSWER_OPENING,
    )


def event_lines(
    bundle: Column, role_order: Column | str, event_style: str = "involving_event",
    role_style: str = "did_to",
) -> Column:
    """Event and role description of a role bundle in one of two event wordings."""
    agent = F.concat_ws(" ", bundle["agent_det"], bundle["agent_noun"])
    patient = F.concat_ws(" ", bundle["patient_det"], bundle["patient_noun"])
    label = text.to_ing(bundle["verb_lemma"], "label")
    if event_style == "there_was_event":
        capital = F.concat(F.upper(F.substring(agent, 1, 1)), F.substring(agent, 2, 2**30))
        opening = lines(
            F.concat(capital, F.lit(" and "), patient, F.lit(" were involved in the same event.")),
            let(
                label,
                lambda e: F.when(e == "", "There was an event.").otherwise(
                    F.concat(F.lit("There was "), article(e), F.lit(" "), e, F.lit(" event."))
                ),
            ),
        )
    elif event_style == "involving_event":
        opening = event_sentence(agent, patient, label)
    else:
        raise ValueError(f"unknown event style {event_style!r}")
    return lines(opening, role_lines(agent, patient, role_order, role_style))


def answer_line(sentence: Column, quote_style: str = "mary_answered") -> Column:
    before, after = QUOTES[quote_style]
    return F.concat(F.lit(before), text.pretty_sentence(sentence, commas=False), F.lit(after))


def demo_prompt(
    condition: Column | str,
    target: Column,
    prime: Column,
    prime_sentence: Column,
    filler: Column,
    role_order: Column | str,
    event_style: str = "involving_event",
    role_style: str = "did_to",
    quote_style: str = "mary_answered",
    verb_cue: str = "auto_real_targets",
) -> Column:
    """Solved example (event and answer, or an unrelated filler scene), then the open target."""
    cond = col(condition)
    solved = lines(
        event_lines(prime, role_order, event_style, role_style),
        "",
        QUESTION_LINE,
        answer_line(prime_sentence, quote_style),
        "",
    )
    unrelated = lines(UNRELATED_SCENE, QUESTION_LINE, answer_line(filler, quote_style), "")
    demo = F.when(cond.isin("active", "passive"), solved).when(cond == "filler", unrelated)
    cue = F.concat(F.lit('Use the verb "'), target["verb_lemma"], F.lit('" in the answer.'))
    if verb_cue == "none":
        cue = F.lit(None).cast("string")
    elif verb_cue == "auto_real_targets":
        cue = F.when(~target["verb_lemma"].isin("s", "ed"), cue)
    elif verb_cue != "all":
        raise ValueError(f"unknown verb cue {verb_cue!r}")
    return lines(
        demo,
        event_lines(target, role_order, event_style, role_style),
        cue,
        "",
        QUESTION_LINE,
        F.lit(QUOTES[quote_style][0] + "The"),
    )


def prime_block(condition: Column | str, prime_text: Column | str) -> Column:
    """The prime sentence; null without a prime."""
    return F.when(col(condition) != "no_prime", tidy_lines(prime_text))


def solved_prime_block(
    condition: Column | str, prime_text: Column | str, role_order: Column | str
) -> Column:
    """The prime as a solved example. A prime that does not parse keeps question and answer."""
    cond = col(condition)
    answer = F.concat(
        F.lit(ANSWER_OPENING), text.pretty_sentence(prime_text), F.lit('"')
    )

    def solved(f):
        return F.when(
            f.isNotNull(),
            lines(
                event_sentence(
                    f["agent_phrase"],
                    f["patient_phrase"],
                    verb_event_label(f["verb"], "participle"),
                ),
                role_lines(f["agent_phrase"], f["patient_phrase"], role_order),
                "",
                QUESTION_LINE,
                answer,
            ),
        ).otherwise(lines(QUESTION_LINE, answer))

    unrelated = lines(UNRELATED_SCENE, QUESTION_LINE, answer)
    return F.when(cond == "filler", unrelated).when(
        cond != "no_prime", let(text.event_fields(prime_text), solved)
    )


def nominalized_question(
    target_active: Column | str,
    template: str = DOER_QUESTION,
    fallback: str = "In the event just described, who was the doer?",
) -> Column:
    """``struct(question, verb_lemma, nominalized, fallback_used)`` of a target sentence.

    The third word is lemmatised and nominalised into the template; nonce fragments ask
    for the event just described; a sentence without a third word falls back to ``do``.
    """
    tokens = text.plain_tokens(target_active, "letters")

    def ask(verb):
        lemma = (
            F.when(verb.isNull(), "do")
            .when(verb.isin("s", "ed"), "event")
            .otherwise(text.lemma_3sg(verb))
        )

        def build(lem):
            nominal = F.when(lem == "event", "event").otherwise(text.to_ing(lem, "nominal"))
            reference = F.when(lem == "event", "event just described").otherwise(
                F.concat(nominal, F.lit(" event"))
            )
            filled = F.replace(F.lit(template), F.lit("{event_reference}"), reference)
            filled = F.replace(filled, F.lit("{nominalized_verb}"), nominal)
            broken = filled.rlike(r"\{[^{}]*\}")
            return F.struct(
                F.when(broken, fallback).otherwise(filled).alias("question"),
                lem.alias("verb_lemma"),
                nominal.alias("nominalized"),
                (broken | verb.isNull()).alias("fallback_used"),
            )

        return let(lemma, build)

    return let(F.get(tokens, 2), ask)


def event_reference(verb_form: Column | str, lemma: Column, nonce: Column) -> Column:
    """``X-ing event`` from a looked-up lemma or the suffix rules; nonce: event just described."""
    base = F.coalesce(lemma, text.lemma_3sg(verb_form, past=True, empty="event"))
    return F.when(nonce, "event just described").otherwise(
        F.concat(text.to_ing(base, "nominal"), F.lit(" event"))
    )


def role_question(question_type: Column | str, reference: Column) -> Column:
    asked = F.when(col(question_type) == "doer", DOER_QUESTION).when(
        col(question_type) == "acted_on", ACTED_ON_QUESTION
    )
    return F.replace(asked, F.lit("{event_reference}"), reference)


def answer_prefix(question_type: Column | str) -> Column:
    return F.when(col(question_type) == "doer", DOER_PREFIX).when(
        col(question_type) == "acted_on", ACTED_ON_PREFIX
    )


def cue_prompt(
    bundle: Column,
    template: str,
    prime_sentence: Column,
    stub: str,
    draw: Column | None = None,
) -> Column:
    """Cue-list prompt: bare or role-labelled words after an optional prime.

    With ``draw`` (a text per row) the words are ordered by md5(draw, place), else they
    keep the order agent, patient, verb.
    """
    nouns = ("agent_noun", "patient_noun", "verb_lemma")
    if template == "role_labeled":
        labels = ("AGENT=", "PATIENT=", "VERB=")
        words = [F.concat(F.lit(x), bundle[n]) for x, n in zip(labels, nouns)]
    else:
        words = [bundle[n] for n in nouns]
    if draw is None:
        ordered = F.array(*words)
    else:
        keyed = [
            F.struct(F.md5(F.concat_ws("|", draw, F.lit(str(i)))).alias("d"), w.alias("w"))
            for i, w in enumerate(words)
        ]
        ordered = F.transform(F.array_sort(F.array(*keyed)), lambda s: s["w"])
    cues = F.array_join(ordered, "; " if template == "role_labeled" else ", ")
    asked = F.replace(F.lit(CUE_TEMPLATES[template]), F.lit("{cues}"), cues)
    prime = F.regexp_replace(prime_sentence, r"^\s+|\s+$", "")
    if template in ("cue_list", "another_event", "same_kind_event"):
        opening = F.when(prime != "", F.concat(prime, F.lit("\n")))
    else:
        opening = F.when(prime != "", F.concat(F.lit("Prime sentence: "), prime))
    return lines(opening, asked, F.lit(stub))


def tensed_filler(
    tense: Column, index: Column | str, pools: dict[str, Sequence[str]], noun: Column | None = None
) -> Column:
    """Filler of the opposite tense, in turn by index; ``{noun}`` slots take the given noun."""
    index = col(index)

    def turn(pool):
        return F.get(literal_array(pool), F.pmod(index, F.lit(len(pool))).cast("int"))

    out = F.when(tense == "present", turn(pools["past"])).otherwise(turn(pools["present"]))
    return out if noun is None else F.replace(out, F.lit("{noun}"), noun)


def open_noun(pool: Sequence[str], blocked: Column, index: Column | str) -> Column:
    """Pool noun by index among those that are not blocked."""
    free = F.filter(literal_array(pool), lambda n: ~F.array_contains(blocked, n))
    return let(free, lambda f: F.get(f, F.pmod(col(index), F.size(f)).cast("int")))
