"""Vocabulary, labels and templates that define the results.

These must stay as they are for the outputs to keep their meaning. Operators
take them as defaults and accept other values as arguments.
"""

# --- fixed values: condition labels -----------------------------------------
CONDITION_ALIASES = {
    "active_prime": "active",
    "passive_prime": "passive",
    "filler_prime": "filler",
    "no_prime_eos": "no_prime",
    "no_prime_empty": "no_prime",
    "no_demo": "no_prime",
    "none": "no_prime",
}
CONDITIONS = ("active", "passive", "filler", "no_prime")
LEXICALITIES = ("real", "nonce")
ROLE_ORDERS = ("agent_first", "patient_first")
CONDITION_PAIRS = (
    ("active", "passive"),
    ("active", "no_prime"),
    ("passive", "no_prime"),
    ("active", "filler"),
    ("passive", "filler"),
)
ITEM_COLUMNS = (
    "item_id",
    "model_condition",
    "prime_condition",
    "prime_text",
    "target_event_prompt",
    "active_completion",
    "passive_completion",
    "target_sentence_active",
    "target_sentence_passive",
    "question_template",
    "correct_answer_for_active",
    "incorrect_answer_for_active",
    "correct_answer_for_passive",
    "incorrect_answer_for_passive",
    "lexicality_condition",
    "notes",
)
QUARTET_COLUMNS = ("pa", "pp", "ta", "tp")
PROMPT_ORDER = ("prompt_active", "prompt_filler", "prompt_no_prime", "prompt_passive")
PRIME_ORDER = ("active", "filler", "no_prime", "passive")

# --- fixed values: filler sentences ------------------------------------------
CORE_FILLERS = (
    "The lantern glowed near sunset .",
    "The traveler rested beside the river .",
    "The notebook stayed on the shelf .",
    "The window rattled during the storm .",
    "The singer smiled after rehearsal .",
    "The painter waited near the doorway .",
    "The engine cooled before dawn .",
    "The market opened after sunrise .",
    "The blanket dried on the line .",
    "The planet shimmered above the valley .",
    "The baker laughed during breakfast .",
    "The signal flickered across the screen .",
    "The tourist wandered through the plaza .",
    "The kettle whistled in the kitchen .",
    "The garden brightened after rain .",
    "The jacket hung behind the chair .",
    "The radio crackled in the attic .",
    "The witness paused near the doorway .",
    "The package arrived before noon .",
    "The sculpture stood in the hallway .",
    "The captain waited beside the harbor .",
    "The teacher listened during assembly .",
    "The violin echoed in the theater .",
    "The pillow rested on the sofa .",
)
NONCE_FILLERS = (
    "The bri ed near dil .",
    "The dru ed beside the gri .",
    "The mur ed on the dir .",
    "The dur ed during the fab .",
    "The fav ed after fel .",
    "The fil ed near the fol .",
    "The ful ed before gir .",
    "The lav ed after lil .",
    "The mol ed on the mul .",
    "The nav ed above the nin .",
    "The nom ed during nud .",
    "The pav ed across the pel .",
    "The pil ed through the por .",
    "The rav ed in the rom .",
    "The sav ed after som .",
    "The sor ed behind the sul .",
    "The tel ed in the tir .",
    "The tul ed near the vel .",
    "The vil ed before vir .",
    "The vom ed in the vul .",
    "The bri ed beside the dru .",
    "The gri ed during mur .",
    "The dir ed in the dur .",
    "The fab ed on the fav .",
)
NONCE_NOUNS = (
    "bri", "dil", "dru", "gri", "mur", "dir", "dur", "fab", "fav", "fel",
    "fil", "fol", "ful", "gir", "lav", "lil", "mol", "mul", "nav", "nin",
    "nom", "nud", "pav", "pel", "pil", "por", "rav", "rom", "sav", "som",
    "sor", "sul", "tel", "tir", "tul", "vel", "vil", "vir", "vom", "vul",
)
TENSED_FILLERS = {
    "present": (
        "Clouds drift very quietly today .",
        "Rain stops very suddenly today .",
        "Music fades very softly today .",
        "Birds vanish very quickly today .",
        "Clouds slowly drift very quietly today .",
        "Rain suddenly stops very softly today .",
        "Music softly fades very gently today .",
        "Birds quickly vanish very silently today .",
        "Clouds calmly drift very slowly today .",
        "Rain briefly stops very suddenly today .",
        "Music gradually fades very softly today .",
        "Birds quietly vanish very quickly today .",
    ),
    "past": (
        "Clouds drifted very quietly yesterday .",
        "Rain stopped very suddenly yesterday .",
        "Music faded very softly yesterday .",
        "Birds vanished very quickly yesterday .",
        "Clouds slowly drifted very quietly yesterday .",
        "Rain suddenly stopped very softly yesterday .",
        "Music softly faded very gently yesterday .",
        "Birds quickly vanished very silently yesterday .",
        "Clouds calmly drifted very slowly yesterday .",
        "Rain briefly stopped very suddenly yesterday .",
        "Music gradually faded very softly yesterday .",
        "Birds quietly vanished very quickly yesterday .",
    ),
}
TENSED_NONCE_FILLERS = {
    "present": (
        "{noun} s very quietly today .",
        "{noun} s very softly today .",
        "{noun} s very suddenly today .",
        "{noun} s very quickly today .",
        "{noun} s slowly very quietly today .",
        "{noun} s suddenly very softly today .",
        "{noun} s softly very gently today .",
        "{noun} s quickly very silently today .",
        "{noun} s calmly very slowly today .",
        "{noun} s briefly very suddenly today .",
        "{noun} s gradually very softly today .",
        "{noun} s quietly very quickly today .",
    ),
    "past": (
        "{noun} ed very quietly yesterday .",
        "{noun} ed very softly yesterday .",
        "{noun} ed very suddenly yesterday .",
        "{noun} ed very quickly yesterday .",
        "{noun} ed slowly very quietly yesterday .",
        "{noun} ed suddenly very softly yesterday .",
        "{noun} ed softly very gently yesterday .",
        "{noun} ed quickly very silently yesterday .",
        "{noun} ed calmly very slowly yesterday .",
        "{noun} ed briefly very suddenly yesterday .",
        "{noun} ed gradually very softly yesterday .",
        "{noun} ed quietly very quickly yesterday .",
    ),
}

# --- fixed values: complex noun phrases --------------------------------------
COMPLEXITIES = ("agent_complex", "patient_complex", "both_complex")
PREPOSITION_GROUPS = {
    "proximity": ("near",),
    "vertical": ("above", "below"),
    "support": ("on",),
    "containment": ("in",),
    "source": ("from",),
    "instrument": ("with",),
}
PREPOSITION_SEQUENCE = (
    ("near", "vertical"),
    ("above", "proximity"),
    ("with", "source"),
    ("from", "instrument"),
    ("in", "support"),
    ("on", "containment"),
    ("below", "proximity"),
)
FUNCTION_INVENTORY = (
    "a", "an", "the", "is", "was", "by", "near", "above", "below", "on", "in", "from", "with",
)

# --- fixed values: sentence labelling ----------------------------------------
SIMPLE_DETERMINERS = ("a", "an", "the")
DETERMINERS = (
    "a", "an", "the", "this", "that", "these", "those", "my", "your", "his", "her", "our", "their",
)
SUBJECT_PRONOUNS = ("i", "you", "he", "she", "it", "we", "they")
OBJECT_PRONOUNS = ("me", "you", "him", "her", "it", "us", "them")
PRONOUNS = tuple(sorted(set(SUBJECT_PRONOUNS + OBJECT_PRONOUNS)))
BE_FORMS = ("am", "is", "are", "was", "were", "be", "been", "being")
GET_FORMS = ("get", "gets", "got", "getting", "gotten")
AUX_FORMS = BE_FORMS + GET_FORMS + (
    "do", "does", "did", "have", "has", "had", "can", "could", "will", "would",
)
PREPOSITIONS = (
    "by", "to", "for", "with", "near", "behind", "before", "after", "during", "across",
    "through", "in", "on", "at", "from", "into", "onto", "over", "under", "around",
    "between", "without", "within", "of", "as",
)
CONJUNCTIONS = ("and", "but", "or")
ADVERBS_OR_NEGATION = (
    "not", "never", "just", "already", "still", "really", "very", "quite", "too", "also",
)
COPULAR_PARTICIPIAL = ("married", "involved", "related", "known", "located")
IRREGULAR_PARTICIPLES = (
    "beaten", "bent", "bound", "brought", "built", "bought", "caught", "chosen", "done",
    "driven", "eaten", "fallen", "felt", "found", "forgiven", "forgotten", "given", "gone",
    "heard", "held", "hit", "hurt", "kept", "known", "left", "lost", "made", "met", "paid",
    "put", "read", "run", "said", "seen", "sent", "shot", "sold", "spent", "struck", "taught",
    "told", "understood", "won", "written",
)
IRREGULAR_FINITE_VERBS = (
    "beat", "beats", "did", "does", "do", "drank", "fought", "found", "gave", "got", "grew",
    "had", "hung", "hurt", "is", "knew", "left", "made", "met", "paid", "put", "ran", "read",
    "said", "saw", "shot", "slept", "spoke", "stole", "struck", "swam", "taught", "told",
    "understood", "was", "were", "won",
)
ADJECTIVE_SUFFIXES = ("ous", "ful", "ive", "able", "ible", "less", "al", "ic", "y")
THEME_PRONOUNS = ("something", "anything", "nothing", "everything", "what")
THEME_NOUNS = ("money", "event", "book", "story", "message", "birth", "news", "fact", "idea")
THEME_VERBS = (
    "discover", "describe", "read", "write", "say", "tell", "show", "explain", "raise", "know",
    "learn", "find",
)
PARTICLES = ("up", "out", "off", "away", "down", "over", "back")
STRICT_PASSIVE = (
    "passive_target_by",
    "passive_by",
    "passive_target_progressive_by",
    "passive_progressive_by",
)
STRICT_ACTIVE = ("active_target_transitive_like", "active_transitive")
LAX_PASSIVE = STRICT_PASSIVE + (
    "passive_target_short",
    "passive_short",
    "passive_progressive_short",
)
LAX_ACTIVE = STRICT_ACTIVE + (
    "active_target_ditransitive_like",
    "active_target_progressive_like",
    "active_ditransitive_prepositional",
    "active_transitive_with_pp",
    "active_progressive_transitive",
    "active_progressive_ditransitive",
)
REVIEW_COLUMNS = (
    "generation_class_detailed",
    "generation_structure_reason",
    "argument_structure_inferred",
    "role_frame_inferred",
    "argument_inference_note",
    "generation_class_strict",
    "generation_class_lax",
)

# --- fixed values: verb forms ------------------------------------------------
IRREGULAR_ING = {
    "beaten": "beating",
    "caught": "catching",
    "forgotten": "forgetting",
    "forgiven": "forgiving",
    "hurt": "hurting",
    "struck": "striking",
    "taught": "teaching",
    "understood": "understanding",
}
LABEL_ING = {"drag": "dragging", "forget": "forgetting", "grab": "grabbing"}
NOMINAL_OVERRIDES = {
    "be": "being",
    "do": "doing",
    "go": "going",
    "have": "having",
    "die": "dying",
    "lie": "lying",
    "tie": "tying",
    "see": "seeing",
}
SIBILANT_ENDINGS = ("ches", "shes", "sses", "xes", "zes", "oes")
STEM_SUFFIXES = ("ed", "es", "s", "ing")

# --- fixed values: regions and word categories -------------------------------
PASSIVE_REGIONS = (
    "initial_det", "patient_np", "aux", "participle", "by", "agent_det", "agent_np", "punctuation",
)
ACTIVE_REGIONS = (
    "initial_det", "agent_np", "verb", "patient_det", "patient_np", "punctuation",
)
CATEGORY_ORDER = (
    "PUNCT", "DET", "AUX", "PREP", "PARTICIPLE", "FINITE_VERB", "NOUN", "ADJ", "ADV",
)
REGION_CATEGORY = {
    "initial_det": "DET",
    "patient_np": "NOUN",
    "aux": "AUX",
    "participle": "PARTICIPLE",
    "by": "PREP",
    "agent_det": "DET",
    "agent_np": "NOUN",
    "punctuation": "PUNCT",
}
CLOSED_CATEGORIES = {
    "PUNCT": (".", "?", "!"),
    "DET": ("a", "an", "the"),
    "AUX": ("am", "are", "is", "was", "were", "be", "been", "being"),
    "PREP": (
        "about", "above", "after", "around", "as", "at", "before", "below", "beside", "by",
        "during", "for", "from", "in", "inside", "into", "near", "of", "on", "onto", "over",
        "through", "to", "under", "with", "without",
    ),
    "ADJ": (
        "big", "small", "old", "young", "new", "good", "bad", "same", "other", "first", "last",
    ),
    "ADV": ("not", "never", "also", "just", "still", "then", "there", "here"),
}
AUDIT_FUNCTION_WORDS = ("the", "a", "an", "is", "was", "by", ".")

# --- fixed values: measured runs ---------------------------------------------
MODEL_DIMENSION = (
    ("colab_gpt_2_large", "774M", "gpt2", "base", "774M_base", "GPT-2 large"),
    ("colab_Llama_32_3B", "3B", "llama", "base", "3B_base", "Llama 3.2 3B"),
    ("colab_Llama_32_3B_Instruct", "3B", "llama", "instruct", "3B_instruct",
     "Llama 3.2 3B Instruct"),
    ("colab_Llama_31_8B", "8B", "llama", "base", "8B_base", "Llama 3.1 8B"),
    ("colab_Llama_31_8B_Instruct", "8B", "llama", "instruct", "8B_instruct",
     "Llama 3.1 8B Instruct"),
)
EFFECT_METRICS = (
    "pe_active_target_logprob_sum_same_minus_other",
    "pe_passive_target_logprob_sum_same_minus_other",
    "pe_logprob_sum_imbalance_passive_minus_active",
    "pe_active_target_logprob_mean_same_minus_other",
    "pe_passive_target_logprob_mean_same_minus_other",
    "pe_logprob_mean_imbalance_passive_minus_active",
    "active_target_shift_active_minus_no_prime_sum",
    "passive_target_shift_passive_minus_no_prime_sum",
    "active_target_shift_active_minus_filler_sum",
    "passive_target_shift_passive_minus_filler_sum",
    "baseline_no_prime_passive_minus_active_logprob_sum",
    "baseline_filler_passive_minus_active_logprob_sum",
    "active_target_shift_active_minus_no_prime_mean",
    "passive_target_shift_passive_minus_no_prime_mean",
    "active_target_shift_active_minus_filler_mean",
    "passive_target_shift_passive_minus_filler_mean",
    "baseline_no_prime_passive_minus_active_logprob_mean",
    "baseline_filler_passive_minus_active_logprob_mean",
)
