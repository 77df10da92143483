"""Enrichment of content items: kind, size, sounds, difficulty and how adaptive practice uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import phonemes as P
from lexmill.functions import text as T

#: The upper limits of the levels, and the use of each level.
LEVELS = (("very_easy", 0.20), ("easy", 0.40), ("medium", 0.60), ("hard", 0.80))
TOP = "very_hard"
ROLE = {"very_easy": "warm_up", "easy": "practice", "medium": "practice", "hard": "challenge", "very_hard": "challenge"}
SINGLE = ("letter", "word")


def level(score: Column) -> Column:
    out = F.when(score <= LEVELS[0][1], LEVELS[0][0])
    for name, limit in LEVELS[1:]:
        out = out.when(score <= limit, name)
    return out.otherwise(TOP)


def enriched(items: DataFrame, text: str) -> DataFrame:
    """Adds kind, words, syllables, phones and pattern (single words), difficulty, level, role and priority."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z']+"), F.lit(0))
    single = F.col("kind").isin(*SINGLE)
    share = lambda c, most: F.least(c / most, F.lit(1.0))
    phones = F.when(single, P.spelled(T.strict(text))).otherwise(F.array().cast("array<string>"))
    items = items.withColumns({"kind": T.item_kind(text), "words": F.size(words), "syllables": T.syllables(text), "letters": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))})
    items = items.withColumn("phones", phones).withColumn("pattern", P.pattern(F.col("phones")))
    blend = F.when(F.exists("phones", lambda p: p.isin("CH", "SH", "TH", "W", "F", "NG")) | F.col("pattern").contains("CC"), 0.2).otherwise(0.0)
    one = (share(F.length(text), 10.0) + share(F.size("phones"), 8.0) + share(F.greatest(F.col("syllables"), F.lit(1)), 4.0) + blend) / 4
    mean = F.when(F.col("words") > 0, F.col("letters") / F.col("words")).otherwise(0.0)
    more = (share(F.col("words"), 15.0) + share(mean, 8.0) + F.when(F.col(text).rlike("[,:;!?]"), 0.15).otherwise(0.0)) / 3
    items = items.withColumn("difficulty", F.round(F.when(single, one).otherwise(more), 3)).withColumn("level", level(F.col("difficulty")))
    return items.withColumn("role", P.looked_up(ROLE, F.col("level"), "practice")).drop("letters")


def _has(column: str, *parts: str) -> Column:
    c = F.lower(F.coalesce(F.col(column), F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def skill_group(kind: str = "kind") -> Column:
    """The group of skills that an item trains; reads module_key, source_file, activity_type and task_type."""
    task = F.lower(F.coalesce("task_type", F.lit("")))
    return (
        F.when(_has("source_file", "comprehension") | (task == "multiple_choice"), "comprehension").when(_has("source_file", "reading_passages"), "fluency")
        .when(_has("module_key", "module_1") | (F.col(kind) == "letter") | _has("activity_type", "letter"), "letter_sound").when(task.contains("rhyme"), "phonemic_awareness")
        .when(_has("module_key", "module_2") | (F.col(kind) == "word"), "word_reading").when(_has("module_key", "module_3") | F.col(kind).isin("sentence", "phrase"), "sentence_reading").otherwise("unknown")
    )


def item_focus(pattern: str = "pattern", phones: str = "phones") -> Column:
    """The error that an item watches for; reads source_file, task_type, activity_type and prompt_text."""
    pacing = F.lower(F.coalesce("activity_type", F.lit(""))).isin("comma_pause_reading", "full_stop_pause_reading", "mixed_punctuation_fluency") | _has("activity_type", "fluency")
    question = F.when(_has("prompt_text", "why", "how"), "comprehension_inference").when(_has("prompt_text", "sequence", "first", "next"), "sequencing").otherwise("comprehension_detail")
    p = F.col(pattern)
    return (
        F.when(_has("source_file", "comprehension_questions") | (F.lower(F.coalesce("task_type", F.lit(""))) == "multiple_choice"), question)
        .when(_has("activity_type", "sentence", "fluency", "pause", "punctuation"), F.when(pacing, "fluency_pacing").otherwise("sentence_tracking"))
        .when((p == "CVC") & (F.size(P.vowels(F.col(phones))) > 0), "vowel_sound").when(p.endswith("C"), "final_consonant").when(p.startswith("C"), "initial_consonant").otherwise("unknown")
    )
