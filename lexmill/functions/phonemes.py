"""Phones of words by rule, their comparison, and what an error tells about a reading, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.distance import edits

#: Letter groups that sound as one, the phones of groups and letters where a word is spelled out, and the vowel phones.
GROUPS = {"ch": "CH", "sh": "SH", "th": "TH", "ph": "F", "wh": "W", "ee": "IY", "ea": "IY", "oo": "UW", "ow": "OW", "ay": "EY", "ai": "EY", "oy": "OY", "oi": "OY"}
LETTERS = {
    "a": "AE", "b": "B", "c": "K", "d": "D", "e": "EH", "f": "F", "g": "G", "h": "HH", "i": "IH", "j": "JH", "k": "K", "l": "L", "m": "M",
    "n": "N", "o": "OW", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "u": "AH", "v": "V", "w": "W", "x": "K S", "y": "Y", "z": "Z",
}
VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")


def spelled(word: Column) -> Column:
    """Phones of a lower-case word by its letters, groups first."""
    parts = F.regexp_extract_all(word, F.lit("|".join(GROUPS) + "|[a-z]"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in (GROUPS | LETTERS).items() for x in pair])
    return F.flatten(F.transform(parts, lambda p: F.split(F.element_at(table, p), " ")))


def without_stress(phones: Column) -> Column:
    return F.transform(phones, lambda p: F.regexp_replace(p, "[0-9]$", ""))


def vowels(phones: Column) -> Column:
    return F.filter(phones, lambda p: p.isin(*VOWELS))


def pattern(phones: Column) -> Column:
    """C and V of each phone."""
    return F.array_join(F.transform(phones, lambda p: F.when(p.isin(*VOWELS), "V").otherwise("C")), "")


def error_focus(text_words: Column, phones: Column) -> Column:
    """What a text's sounds ask to watch: its word sequence if it has several words, else by the pattern; null without phones."""
    p = pattern(phones)
    return F.when(
        F.size(phones) > 0,
        F.when(text_words > 1, "word_sequence").when(p == "CVC", "vowel_sound").when(p.endswith("C"), "final_consonant").when(p.startswith("C"), "initial_consonant").when(p.contains("V"), "vowel_sound"),
    )


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(F.round(1 - edits(a, b) / longest, 6))


def same(a: Column, b: Column) -> Column:
    """True, false, or null where the expected side has nothing to compare."""
    return F.when(a.isNotNull(), a.eqNullSafe(b))


def compared(expected: Column, actual: Column) -> Column:
    """struct(initial, final, vowel, similarity)."""
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.struct(
        same(F.get(expected, F.lit(0)), F.get(actual, F.lit(0))).alias("initial"),
        same(F.get(expected, F.size(expected) - 1), F.get(actual, F.size(actual) - 1)).alias("final"),
        same(some(vowels(expected)), vowels(actual)).alias("vowel"),
        similarity(expected, actual).alias("similarity"),
    )


def word_error(expected: Column, actual: Column, phones: Column) -> Column:
    """The kind of a single word's error from its comparison: the first rule that holds."""
    n, m = F.length(expected), F.length(actual)
    return (
        F.when(actual == "", "blank")
        .when(expected == actual, "correct")
        .when(~phones["initial"] & phones["final"], "initial_sound_error")
        .when(phones["initial"] & ~phones["final"], "final_sound_error")
        .when(phones["initial"] & phones["final"] & ~phones["vowel"], "vowel_error")
        .when(m < n, "omission")
        .when(m > n, "insertion")
        .otherwise("substitution")
    )


#: Of each kind of error the hint's key, the coach's hint, what the learner is told, and the action.
FEEDBACK = {
    "correct": ("praise_continue", "praise_continue", "Good reading. Keep going.", "continue"),
    "accepted_variant": ("praise_continue", "praise_continue", "Good reading. Keep going.", "continue"),
    "blank": ("try_answer_first", "try_answer_first", "Try saying the answer first.", "retry"),
    "initial_sound_error": ("beginning_sound", "listen_to_first_sound", "Listen to the first sound and try again.", "retry"),
    "final_sound_error": ("ending_sound", "listen_to_final_sound", "Listen to the ending sound and try again.", "retry"),
    "vowel_error": ("middle_sound", "listen_to_middle_sound", "Listen to the middle sound and try again.", "retry"),
    "consonant_error": ("consonant_sound", "listen_to_consonant_sound", "Listen to the consonant sounds and try again.", "retry"),
    "skipped_word": ("read_each_word", "read_each_word", "Read each word carefully.", "retry"),
    "partial_sentence": ("read_whole_sentence", "read_whole_sentence", "Try reading the whole sentence.", "retry"),
    "word_order_error": ("word_order", "read_in_order", "Read the words in order.", "retry"),
    "far_answer": ("listen_again", "listen_again", "Listen again and try once more.", "retry"),
    "unclear_asr": ("try_recording_again", "try_recording_again", "Try recording again clearly.", "retry"),
    "incorrect_general": ("try_again_slowly", "try_again_slowly", "Try again slowly.", "retry"),
}


def feedback(error: Column) -> Column:
    """struct(hint, coach, summary, action) for a kind of error; kinds without their own get the general one."""
    names = ("hint", "coach", "summary", "action")
    entry = lambda values: F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names, strict=True)])
    table = F.create_map(*[x for k, v in FEEDBACK.items() for x in (F.lit(k), entry(v))])
    return F.coalesce(F.element_at(table, error), entry(FEEDBACK["incorrect_general"]))


def looked_up(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key), F.lit(default))
