"""What follows from an error: the focus of practice, and how a recommendation is explained."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By kind of error the primary focus, the target position, the preferred focuses and activities, the
#: action, and the reason's code.
FOCUS = {
    "final_sound_error": ("final_consonant", "final", ["final_consonant"], ["display_word_reading", "highlighted_sentence_word"], "remediate", "target_final_sound_error"),
    "initial_sound_error": (
        "initial_consonant", "initial", ["initial_consonant"], ["display_word_reading", "first_letter_identification", "missing_first_letter"], "remediate", "target_initial_sound_error",
    ),
    "vowel_error": ("vowel_sound", "vowel", ["vowel_sound"], ["display_word_reading", "split_word_reading", "highlighted_rhyme_word"], "remediate", "target_vowel_error"),
    "consonant_error": (
        "consonant_accuracy", "consonant", ["initial_consonant", "final_consonant", "consonant_blend"], ["display_word_reading", "split_word_reading"], "remediate", "target_consonant_error",
    ),
    "skipped_word": ("sentence_tracking", "sentence", ["sentence_tracking"], ["simple_sentence_reading", "full_stop_pause_reading"], "practice", "target_skipped_word"),
    "partial_sentence": (
        "fluency_completion", "sentence", ["fluency_pacing", "sentence_tracking"], ["comma_pause_reading", "mixed_punctuation_fluency"], "practice", "target_partial_sentence",
    ),
    "word_order_error": ("sentence_order", "sentence", ["sentence_tracking"], ["simple_sentence_reading", "full_stop_pause_reading"], "practice", "target_word_order"),
    "blank": ("retry_or_easier", "", ["initial_consonant", "vowel_sound"], ["display_word_reading", "letter_pair_identification"], "retry_or_easier", "blank_response"),
    "unclear_asr": ("retry_recording", "", [], [], "retry_recording", "unclear_asr_retry"),
    "correct": ("continue_or_increase", "", [], [], "continue", "correct_continue"),
    "accepted_variant": ("continue", "", [], [], "continue", "accepted_variant_continue"),
    "far_answer": ("easier_review", "", ["word_reading", "sentence_tracking"], ["display_word_reading", "simple_sentence_reading", "review"], "easier_review", "far_answer_review"),
}
#: The focus of any other kind of error, and the kind that a skill stands for where the kind has no focus.
GENERAL = ("general_review", "", ["word_reading"], ["display_word_reading", "review"], "practice", "general_review")
FALLBACKS = {
    "final_consonant": "final_sound_error", "initial_consonant": "initial_sound_error", "vowel_sound": "vowel_error",
    "sentence_tracking": "skipped_word", "fluency_completion": "partial_sentence",
}
#: What a learner is told about a focus.
SUMMARIES = {
    "final_consonant": "Let's practice the ending sound again.", "initial_consonant": "Let's practice the first sound again.", "vowel_sound": "Let's practice the middle sound again.",
    "sentence_tracking": "Let's practice reading each word.", "fluency_completion": "Let's practice reading the whole sentence.", "sentence_order": "Let's practice the word order.",
    "retry_recording": "Let's try recording that again.", "continue_or_increase": "Nice work. Let's keep going.", "easier_review": "Let's review with an easier item.",
    "general_review": "Let's practice another item.",
}
FIELDS = ("primary_focus", "target_position", "preferred_focus", "preferred_activities", "action", "reason")


def _entry(values: tuple) -> Column:
    texts = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    return F.struct(*[(texts(v) if isinstance(v, list) else F.lit(v)).alias(n) for v, n in zip(values, FIELDS, strict=True)])


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def focus(error: Column, skill: Column | None = None) -> Column:
    """struct of FIELDS for a kind of error. A skill decides where the kind has no focus, and leads the preferred focuses."""
    skill = F.lit(None).cast("string") if skill is None else skill
    named = F.coalesce(F.nullif(F.trim(error), F.lit("")), F.lit("incorrect_general"))
    kind = F.when(named.isin(*FOCUS), named).otherwise(F.coalesce(F.element_at(_map(FALLBACKS), skill), named))
    table = F.create_map(*[x for k, v in FOCUS.items() for x in (F.lit(k), _entry(v))])
    found = F.coalesce(F.element_at(table, kind), _entry(GENERAL))
    leads = F.coalesce(skill != "", F.lit(False)) & ~F.array_contains(found["preferred_focus"], F.coalesce(skill, F.lit("")))
    preferred = F.when(leads, F.concat(F.array(skill), found["preferred_focus"])).otherwise(found["preferred_focus"])
    return found.withField("preferred_focus", preferred)


def explained(primary_focus: Column, adjustment: Column, reason: Column, seen: Column) -> Column:
    """struct(teacher, learner, reasons); seen: how often the learner has shown this focus before."""
    f = F.coalesce(F.nullif(primary_focus, F.lit("")), F.lit("general_review"))
    how = F.coalesce(F.nullif(adjustment, F.lit("")), F.lit("same"))
    why = F.coalesce(F.nullif(reason, F.lit("")), F.lit("general_review"))
    again = F.when(F.coalesce(seen, F.lit(0)) >= 2, "repeated ").otherwise("")
    teacher = F.concat(F.lit("The learner has "), again, F.replace(f, F.lit("_"), F.lit(" ")), F.lit(" needs, so the next item targets that focus at "), how, F.lit(" difficulty."))
    learner = F.coalesce(F.element_at(_map(SUMMARIES), f), F.lit(SUMMARIES["general_review"]))
    return F.struct(teacher.alias("teacher"), learner.alias("learner"), F.array(why, F.concat(how, F.lit("_difficulty"))).alias("reasons"))
