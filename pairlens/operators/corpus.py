"""Item, nonce, complex and mixed corpora, and the prompt tables made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, fixed, prompts, text
from ..functions.core import literal_array, literal_map
from . import joins, ranking


def with_parses(df: DataFrame) -> DataFrame:
    """Parses of the four sentences as structs ``_pa, _pp, _ta, _tp``."""
    return df.withColumns(
        {
            "_pa": text.parse_active("pa"),
            "_ta": text.parse_active("ta"),
            "_pp": text.parse_passive("pp"),
            "_tp": text.parse_passive("tp"),
        }
    )


def with_role_order(df: DataFrame, index: str = "item_index") -> DataFrame:
    """Role order in turn inside each determiner-tense cell of the target."""
    parsed = df.withColumn("__cell", text.cell(text.parse_active("ta"), text.parse_passive("tp")))
    return ranking.counterbalance(parsed, ["__cell"], index).drop("__cell")


def build_items(
    quartets: DataFrame,
    corpus_name: str,
    lexicality: str,
    conditions: Sequence[str] = fixed.CONDITIONS,
    question: str = "Who was the agent?",
    fillers: Sequence[str] = fixed.CORE_FILLERS,
    filler_seed: int = 13,
    filler_offset: int | None = None,
) -> DataFrame:
    """Item x condition table: tidy sentences, event prompt, role order, filler, answers, notes.

    The filler comes from a seeded pick of the pool (words of the row blocked), or from
    the target ``filler_offset`` rows further on.
    """
    rows = with_role_order(quartets)
    part = text.parse_active("ta", strict=False)
    rows = rows.withColumn("__t", part)
    agent, patient = F.col("__t.agent"), F.col("__t.patient")
    if filler_offset is None:
        pick = ranking.seeded_pick(fillers, filler_seed, "item_index", F.array(agent, patient))
        rows = rows.withColumn("__filler", text.pretty_sentence(pick))
        source = "intransitive_pool"
    else:
        rows = ranking.offset_row(rows, "item_index", "ta", filler_offset, "__filler")
        rows = rows.withColumn("__filler", text.pretty_sentence("__filler"))
        source = f"offset_target_{filler_offset}"
    sentence = {
        "active": text.pretty_sentence("pa"),
        "passive": text.pretty_sentence("pp"),
        "filler": F.col("__filler"),
        "no_prime": F.lit(""),
    }
    whole = [F.concat_ws(" ", F.col("__t.det"), agent), F.concat_ws(" ", F.col("__t.patient_det"), patient)]
    # What does not depend on the condition is worked out before an item becomes one row for each.
    rows = rows.withColumns(
        {
            "__prompt": prompts.target_event_prompt(whole[0], whole[1], F.col("__t.verb"), "role_order"),
            "__active": text.pretty_sentence("ta"),
            "__passive": text.pretty_sentence("tp"),
        }
    )
    out = joins.expand_conditions(rows, {c: sentence[c] for c in conditions})

    def the(noun: Column) -> Column:
        return F.concat(F.lit("The "), noun, F.lit("."))

    return out.select(
        F.format_string(f"{corpus_name}_%05d", F.col("item_index").cast("bigint")).alias("item_id"),
        "item_index",
        F.col("item_index").alias("item_order"),
        F.lit(corpus_name).alias("model_condition"),
        "prime_condition",
        "prime_text",
        F.col("__prompt").alias("target_event_prompt"),
        F.col("__active").alias("active_completion"),
        F.col("__passive").alias("passive_completion"),
        F.col("__active").alias("target_sentence_active"),
        F.col("__passive").alias("target_sentence_passive"),
        F.lit(question).alias("question_template"),
        the(agent).alias("correct_answer_for_active"),
        the(patient).alias("incorrect_answer_for_active"),
        the(agent).alias("correct_answer_for_passive"),
        the(patient).alias("incorrect_answer_for_passive"),
        F.lit(lexicality).alias("lexicality_condition"),
        "role_order",
        F.concat(
            F.lit(f"generated_from_corpus={corpus_name};verb="), F.col("__t.verb"),
            F.lit(f";filler_source={source};role_order="), F.col("role_order"),
        ).alias("notes"),
    )


def build_requests(items: DataFrame) -> DataFrame:
    """Scoring requests: prompt prefix and the two candidates joined to it, with metadata."""
    block = prompts.solved_prime_block("prime_condition", "prime_text", "role_order")
    prefix = prompts.sections(
        F.coalesce(block, F.lit("")), prompts.tidy_lines("target_event_prompt")
    )
    out = items.withColumn("prefix", prefix)

    def candidate(column: str) -> Column:
        return text.join_candidate("prefix", F.concat(F.col(column), F.lit('"')))

    return out.withColumns(
        {
            "candidate_a": candidate("active_completion"),
            "candidate_b": candidate("passive_completion"),
            "candidate_a_label": F.lit("active_completion"),
            "candidate_b_label": F.lit("passive_completion"),
            "pairing_key": F.col("item_id"),
        }
    )


# ---- nonce corpus -----------------------------------------------------------


def _nonce_np(det: Column, noun: Column) -> Column:
    family = text.det_family(det)
    return F.concat_ws(" ", text.determiner_for(noun, family), noun)


def build_nonce(
    core: DataFrame, nouns: Sequence[str] = fixed.NONCE_NOUNS, index: str = "item_index"
) -> DataFrame:
    """Nonce sentences in the frame of real ones: four consecutive pool nouns per row, the
    fragment s or ed by the passive's auxiliary, a/an by the new noun."""
    rows = with_parses(core)

    def noun(shift: int) -> Column:
        return text.round_robin(nouns, F.col(index) + shift)

    def active(a: str, p: str, agent: Column, patient: Column) -> Column:
        fragment = F.when(F.col(f"{p}.aux") == "is", "s").when(F.col(f"{p}.aux") == "was", "ed")
        return F.concat_ws(
            " ", _nonce_np(F.col(f"{a}.det"), agent), fragment,
            _nonce_np(F.col(f"{a}.patient_det"), patient), F.lit("."),
        )

    def passive(p: str, agent: Column, patient: Column) -> Column:
        return F.concat_ws(
            " ", _nonce_np(F.col(f"{p}.det"), patient), F.col(f"{p}.aux"), F.lit("ed by"),
            _nonce_np(F.col(f"{p}.agent_det"), agent), F.lit("."),
        )

    return rows.select(
        index,
        active("_pa", "_pp", noun(0), noun(1)).alias("pa"),
        passive("_pp", noun(0), noun(1)).alias("pp"),
        active("_ta", "_tp", noun(2), noun(3)).alias("ta"),
        passive("_tp", noun(2), noun(3)).alias("tp"),
    )


def build_mixed(targets: DataFrame, primes: DataFrame, seed: int = 13, require_all: bool = True) -> DataFrame:
    """Targets of one corpus with primes of another from the opposite cell, none used twice."""
    t = targets.select(
        F.col("item_index"), "ta", "tp",
        text.parse_active("ta").alias("_ta"), text.parse_passive("tp").alias("_tp"),
    )
    p = primes.select(
        F.col("item_index").alias("prime_index"), "pa", "pp",
        text.parse_active("pa").alias("_pa"), text.parse_passive("pp").alias("_pp"),
    )
    return joins.assign_opposite(
        t, p, "item_index", "prime_index",
        (F.col("_tp.aux"), text.det_family("_ta.det")),
        (F.col("_pp.aux"), text.det_family("_pa.det")),
        seed, require_all=require_all,
    ).select("item_index", "prime_index", "pa", "pp", "ta", "tp")


# ---- complex noun phrases ---------------------------------------------------


def prepositions_for(index: Column) -> Column:
    """``struct(first, second)`` by index: the sequence turns fastest, then the group members."""
    n = len(fixed.PREPOSITION_SEQUENCE)
    place = F.pmod(index, F.lit(n)).cast("int")
    first = F.get(literal_array([p for p, _ in fixed.PREPOSITION_SEQUENCE]), place)
    pools = F.array(
        *[literal_array(fixed.PREPOSITION_GROUPS[g]) for _, g in fixed.PREPOSITION_SEQUENCE]
    )
    pool = F.get(pools, place)
    second = F.get(pool, F.pmod(F.floor(index / n), F.size(pool)).cast("int"))
    return F.struct(first.alias("first"), second.alias("second"))


def complex_targets(
    active: Column, passive: Column, agent_mod: Column, patient_mod: Column,
    agent_prep: Column, patient_prep: Column, articles: Column | None = None,
) -> tuple[Column, Column]:
    """Active and passive target with prepositional modifiers on the agent, the patient or both.

    ``articles`` is an optional map noun -> a/an. A null preposition leaves its noun simple.
    """
    family = text.det_family(active["det"])

    def phrase(det: Column, head: Column, prep: Column, mod: Column) -> Column:
        known = None if articles is None else articles[mod]
        tail = F.concat_ws(" ", prep, text.determiner_for(mod, family, known), mod)
        return F.when(prep.isNull(), F.concat_ws(" ", det, head)).otherwise(
            F.concat_ws(" ", det, head, tail)
        )

    a = F.concat_ws(
        " ", phrase(active["det"], active["agent"], agent_prep, agent_mod), active["verb"],
        phrase(active["patient_det"], active["patient"], patient_prep, patient_mod), F.lit("."),
    )
    p = F.concat_ws(
        " ", phrase(passive["det"], active["patient"], patient_prep, patient_mod),
        passive["aux"], passive["participle"], F.lit("by"),
        phrase(passive["agent_det"], active["agent"], agent_prep, agent_mod), F.lit("."),
    )
    return a, p


def build_complex(
    quartets: DataFrame,
    pool: DataFrame,
    source_label: str,
    articles: dict[str, str] | None = None,
) -> DataFrame:
    """Three complexity variants per item with rotating modifier nouns.

    ``pool(position, word)`` numbers the modifier nouns; nouns of the row are skipped.
    """
    rows = with_parses(quartets)
    levels = fixed.COMPLEXITIES
    rows = rows.withColumn(
        "__c", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(levels)
        ]))
    ).withColumns({"complexity_index": F.col("__c.i"), "complexity_condition": F.col("__c.name")})
    used = F.array(F.col("_pa.agent"), F.col("_pa.patient"), F.col("_ta.agent"), F.col("_ta.patient"))
    both = F.col("complexity_condition") == "both_complex"
    rows = ranking.rotating_pick(
        rows.drop("__c"), ["item_index", "complexity_index"], used,
        F.col("item_index") * 7 + F.col("complexity_index") * 13,
        F.when(both, 2).otherwise(1), pool,
    )
    rows = rows.withColumn("__p", prepositions_for(F.col("item_index") + F.col("complexity_index")))
    on_agent = F.col("complexity_condition") != "patient_complex"
    on_patient = F.col("complexity_condition") != "agent_complex"
    first, second = F.get("picks", 0), F.get("picks", 1)
    rows = rows.withColumns(
        {
            "agent_modifier_noun": F.when(on_agent, first),
            "patient_modifier_noun": F.when(both, second).when(on_patient, first),
            "agent_modifier_prep": F.when(on_agent, F.col("__p.first")),
            "patient_modifier_prep": F.when(both, F.col("__p.second")).when(
                on_patient, F.col("__p.first")
            ),
        }
    )
    active, passive = complex_targets(
        F.col("_ta"), F.col("_tp"), F.col("agent_modifier_noun"), F.col("patient_modifier_noun"),
        F.col("agent_modifier_prep"), F.col("patient_modifier_prep"),
        literal_map(articles) if articles else None,
    )
    empty = F.lit("")
    return rows.select(
        F.concat(
            F.format_string(f"exp4_{source_label}_%04d_", F.col("item_index").cast("bigint")),
            F.col("complexity_condition"),
        ).alias("item_id"),
        "item_index",
        "complexity_index",
        "complexity_condition",
        F.lit(source_label).alias("source_label"),
        text.cell(F.col("_ta"), F.col("_tp")).alias("target_cell"),
        text.cell(F.col("_pa"), F.col("_pp")).alias("prime_cell"),
        F.col("pa").alias("prime_active"),
        F.col("pp").alias("prime_passive"),
        active.alias("target_active_complex"),
        passive.alias("target_passive_complex"),
        *[
            F.coalesce(c, empty).alias(c)
            for c in ("agent_modifier_noun", "patient_modifier_noun", "agent_modifier_prep",
                      "patient_modifier_prep")
        ],
        text.det_family("_pa.det").alias("prime_det_family"),
        text.det_family("_ta.det").alias("target_det_family"),
        F.col("_pp.aux").alias("prime_passive_aux"),
        F.col("_tp.aux").alias("target_passive_aux"),
        F.col("_pa.verb").alias("prime_verb"),
        F.col("_ta.verb").alias("target_verb"),
        F.col("_ta.agent").alias("target_agent"),
        F.col("_ta.patient").alias("target_patient"),
    )


# ---- prompt tables ----------------------------------------------------------


def demo_rows(
    quartets: DataFrame, fillers: Sequence[str] = fixed.CORE_FILLERS, lemmas: DataFrame | None = None
) -> DataFrame:
    """Quartets with role order, role bundles of target and prime, and a filler in turn."""
    rows = with_parses(with_role_order(quartets))

    def known(df, a, p, name):
        if lemmas is None:
            return df.withColumn(name, text.infer_lemma(f"{a}.verb"))
        small = lemmas.select(
            F.col("finite").alias("__f"), F.col("participle").alias("__q"),
            F.col("lemma").alias("__l"),
        )
        on = (F.col(f"{a}.verb") == F.col("__f")) & (F.col(f"{p}.participle") == F.col("__q"))
        out = df.join(small, on, "left")
        return out.withColumn(
            name, F.coalesce("__l", text.infer_lemma(f"{a}.verb"))
        ).drop("__f", "__q", "__l")

    rows = known(known(rows, "_ta", "_tp", "__tl"), "_pa", "_pp", "__pl")
    return rows.withColumns(
        {
            "target_bundle": text.role_bundle(F.col("_ta"), F.col("_tp"), F.col("__tl")),
            "prime_bundle": text.role_bundle(F.col("_pa"), F.col("_pp"), F.col("__pl")),
            "filler_sentence": text.round_robin(fillers, "item_index"),
        }
    ).drop("__tl", "__pl")


def render_prompts(
    demo: DataFrame,
    conditions: Sequence[str] = ("active", "passive", "no_prime", "filler"),
    **style: str,
) -> DataFrame:
    """One demonstration prompt per item and condition."""
    sentence = {
        "active": F.col("pa"), "passive": F.col("pp"),
        "filler": F.lit(""), "no_prime": F.lit(""),
    }
    rows = joins.expand_conditions(
        demo, {c: sentence[c] for c in conditions}, text_column="prime_sentence"
    )
    return rows.withColumn("prompt", _demo_prompt(F.col("prime_condition"), F.col("prime_sentence"), style))


def _demo_prompt(condition: Column, sentence: Column, style: dict[str, str]) -> Column:
    return prompts.demo_prompt(
        condition, F.col("target_bundle"), F.col("prime_bundle"), sentence,
        F.col("filler_sentence"), "role_order", **style,
    )


def export_prompts_wide(demo: DataFrame, **style: str) -> DataFrame:
    """One row per item, one prompt column per condition."""
    sentence = {"active": F.col("pa"), "passive": F.col("pp"), "no_prime": F.lit(""), "filler": F.lit("")}
    return demo.select(
        "item_index",
        F.col("pa").alias("prime_active_sentence"),
        F.col("pp").alias("prime_passive_sentence"),
        F.col("ta").alias("target_active"),
        F.col("tp").alias("target_passive"),
        "filler_sentence",
        "role_order",
        *[
            _demo_prompt(F.lit(c), s, style).alias(f"prompt_{c}") for c, s in sentence.items()
        ],
    )


def filler_primes(
    rows: DataFrame, nonce: bool = False, row_number: str = "row_number", name: str = "filler_prime"
) -> DataFrame:
    """Filler prime of the tense opposite to the target, in turn by row number; nonce fillers
    take a noun that the row does not use."""
    tense = text.aux_tense("target_passive_aux")
    if nonce:
        blocked = F.array(
            "target_agent", "target_patient", "agent_modifier_noun", "patient_modifier_noun"
        )
        noun = prompts.open_noun(fixed.NONCE_NOUNS, blocked, row_number)
        made = prompts.tensed_filler(tense, row_number, fixed.TENSED_NONCE_FILLERS, noun)
    else:
        made = prompts.tensed_filler(tense, row_number, fixed.TENSED_FILLERS)
    return rows.withColumn(name, made)


def export_prompts_long(
    complex_rows: DataFrame, nonce: bool = False, lemmas: DataFrame | None = None
) -> DataFrame:
    """Prime x voice x question per complex item, with question, answers and distractors."""
    rows = complex_rows.withColumn(
        "row_number", F.col("item_index") * len(fixed.COMPLEXITIES) + F.col("complexity_index")
    )
    rows = filler_primes(rows, nonce)
    if lemmas is None:
        rows = rows.withColumn("__lemma", F.lit(None).cast("string"))
    else:
        rows = joins.lookup(
            rows, lemmas, "target_verb", "lemma", "__lemma", F.lit(None).cast("string"), "form"
        )
    reference = prompts.event_reference("target_verb", F.col("__lemma"), F.lit(nonce))
    rows = rows.withColumn("__reference", reference)  # once per item, before the expansion
    rows = joins.expand_conditions(
        rows,
        {
            "active": F.col("prime_active"), "passive": F.col("prime_passive"),
            "filler": F.col("filler_prime"), "no_prime": F.lit(""),
        },
    )
    rows = joins.expand_grid(
        rows, {"target_voice": ("active", "passive"), "question_type": ("doer", "acted_on")}
    )
    doer = F.col("question_type") == "doer"
    agent, patient = F.col("target_agent"), F.col("target_patient")
    lead = F.when(doer, "The doer was the ").otherwise("The one acted on was the ")
    rows = rows.withColumns(
        {
            "prompt_id": F.concat_ws("_", "item_id", "prime_condition", "target_voice", "question_type"),
            "lexicality_condition": F.lit("nonce" if nonce else "real"),
            "target_sentence": F.when(
                F.col("target_voice") == "active", F.col("target_active_complex")
            ).otherwise(F.col("target_passive_complex")),
            "question_text": prompts.role_question("question_type", F.col("__reference")),
            "answer_prefix": prompts.answer_prefix("question_type"),
            "correct_answer": F.concat(lead, F.when(doer, agent).otherwise(patient), F.lit(".")),
            "foil_answer": F.concat(lead, F.when(doer, patient).otherwise(agent), F.lit(".")),
            "modifier_distractors": F.concat_ws(
                ";",
                F.when(F.col("agent_modifier_noun") != "", F.col("agent_modifier_noun")),
                F.when(F.col("patient_modifier_noun") != "", F.col("patient_modifier_noun")),
            ),
        }
    )
    prompt = prompts.sections(
        F.trim("prime_text"), F.trim("target_sentence"),
        prompts.lines(F.col("question_text"), F.col("answer_prefix")),
    )
    return rows.withColumn("prompt", prompt).drop("__lemma", "__reference")


def free_answer_prompts(items: DataFrame, template: str = prompts.DOER_QUESTION) -> DataFrame:
    """Item x voice prompts with a nominalised question and the answer prefix ``The``."""
    rows = joins.expand_grid(items, {"target_voice": ("active", "passive")})
    rows = rows.withColumn(
        "__q", prompts.nominalized_question("target_sentence_active", template)
    )
    target = F.when(
        F.col("target_voice") == "active", F.col("target_sentence_active")
    ).otherwise(F.col("target_sentence_passive"))
    rows = rows.withColumns(
        {
            "target_sentence": target,
            "question_text": F.col("__q.question"),
            "verb_lemma": F.col("__q.verb_lemma"),
            "verb_nominalized": F.col("__q.nominalized"),
            "nominalization_fallback_used": F.col("__q.fallback_used"),
        }
    )
    block = F.coalesce(prompts.prime_block("prime_condition", "prime_text"), F.lit(""))
    return rows.withColumn(
        "prompt_text",
        prompts.sections(block, F.trim("target_sentence"), prompts.lines(F.col("question_text"), "The")),
    ).drop("__q")


def cue_prompts(
    demo: DataFrame, template: str, prime: Column, stub: str = "The", shuffle_seed: int | None = None
) -> DataFrame:
    draw = None
    if shuffle_seed is not None:
        draw = F.concat_ws("|", F.lit(str(shuffle_seed)), F.col("item_index").cast("string"))
    return demo.withColumn(
        "prompt", prompts.cue_prompt(F.col("target_bundle"), template, prime, stub, draw)
    )


def with_item_ids(df: DataFrame, experiment: str, dataset: str, index: str) -> DataFrame:
    return df.withColumn(
        "item_id", clean.item_id(F.lit(experiment), F.col(dataset), F.col(index))
    )
