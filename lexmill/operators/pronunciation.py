"""How sounds were said: margins of frames against competitors, words' scores, and what they change in an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import frames as A
from lexmill.functions import phonemes as P
from lexmill.functions import text as T

#: Labels that are no sounds, and limits of a sound's score.
NO_SOUNDS = ("", "<PAD>", "<S>", "</S>", "<UNK>", "[PAD]", "[UNK]", "|", "SIL", "SPN", "UNK", "PAD", "BLANK")
WEAK, ACCEPTABLE = 0.55, 0.75
#: How the letters' names sound.
NAMES = {
    "a": "EY", "b": "B IY", "c": "S IY", "d": "D IY", "e": "IY", "f": "EH F", "g": "JH IY", "h": "EY CH", "i": "AY", "j": "JH EY", "k": "K EY", "l": "EH L", "m": "EH M",
    "n": "EH N", "o": "OW", "p": "P IY", "q": "K Y UW", "r": "AA R", "s": "EH S", "t": "T IY", "u": "Y UW", "v": "V IY", "w": "D AH B AH L Y UW", "x": "EH K S", "y": "W AY", "z": "Z IY",
}
#: Words whose sounds go before the lexicon's.
OVERRIDES = {
    "ten": "T EH N", "then": "DH EH N", "thin": "TH IH N", "tin": "T IH N", "tree": "T R IY", "three": "TH R IY", "red": "R EH D", "read": "R EH D", "to": "T UW", "two": "T UW",
    "too": "T UW", "see": "S IY", "sea": "S IY", "bee": "B IY", "be": "B IY", "right": "R AY T", "write": "R AY T", "hear": "HH IY R", "here": "HH IY R", "one": "W AH N",
    "won": "W AH N", "four": "F AO R", "for": "F AO R", "ate": "EY T", "eight": "EY T", "sun": "S AH N", "son": "S AH N", "there": "DH EH R", "their": "DH EH R", "theyre": "DH EH R",
}
#: By flag of a recording why it is uncertain, and what the learner is told, the first that applies.
DOUBTS = {"too_short": "audio_too_short", "no_speech_detected": "no_speech_detected", "mostly_silent": "mostly_silent", "low_volume": "low_volume", "clipped": "clipped"}
TOLD = (
    (("audio_too_short",), "Please record again. Make sure your voice is clear and at least 1 second long."),
    (("no_speech_detected", "mostly_silent"), "Please record again. Make sure your voice is clear and close enough to the microphone."),
    (("low_volume",), "Please record again with a clearer, louder voice."),
    (("clipped",), "Please record again a little farther from the microphone."),
)
UNRELIABLE = "Please record again. The audio was not reliable enough to score."


def status(score: Column, acceptable: float | Column = WEAK, good: float | Column = ACCEPTABLE) -> Column:
    return F.when(score < acceptable, "weak").when(score < good, "acceptable").otherwise("good")


def scored(rows: DataFrame, frames: str, segments: str, labels: list[str], blank: int, weak: float = WEAK, acceptable: float = ACCEPTABLE) -> DataFrame:
    """One row per segment of each row: place, phone, start, end, score, margin, status, competitor and both mean log scores.

    frames: array of frames, each the labels' log scores; segments: array of struct(label int, at array<int>), the frame
    numbers of each expected sound. Competitors are all sounds but the blank and those that the row expects; with none the
    margin is 0. The score is the sigmoid of the margin; equals go to the lower label. A row without segments gives none.
    """
    none = F.array(F.lit(blank), *[F.lit(i) for i, name in enumerate(labels) if name in NO_SOUNDS])
    names = F.array(*map(F.lit, labels))
    other = rows.columns
    each = rows.withColumn("__out", F.concat(none, F.transform(segments, lambda s: s["label"]))).select("*", F.posexplode(segments).alias("place", "__s"))
    mean = lambda i: A.total(F.transform(F.col("__s.at"), lambda f: F.get(F.get(frames, f), i))) / F.size("__s.at")
    each = each.withColumn("__means", F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: mean(i)))
    rivals = F.filter(F.transform("__means", lambda m, i: F.struct(m.alias("m"), (-i).alias("i"))), lambda x: ~F.array_contains("__out", -x["i"]))
    each = each.withColumns({"__best": F.array_max(rivals), "__own": F.get("__means", F.col("__s.label"))})
    each = each.withColumn("__margin", F.coalesce(F.col("__own") - F.col("__best.m"), F.lit(0.0)))
    keep = [c for c in other if c not in (frames, segments)]
    return each.select(
        *keep, "place", F.get(names, F.col("__s.label")).alias("phone"), F.array_min("__s.at").alias("start"), F.array_max("__s.at").alias("end"),
        F.round(A.sigmoid(F.col("__margin")), 6).alias("score"), F.round("__margin", 6).alias("margin"), status(A.sigmoid(F.col("__margin")), weak, acceptable).alias("status"),
        F.get(names, -F.col("__best.i")).alias("competitor"), F.round("__own", 6).alias("own_lp"), F.round("__best.m", 6).alias("competitor_lp"),
    )


def word_scores(rows: DataFrame, text: str, score: str, threshold: float) -> DataFrame:
    """One row per word of each text with the text's score: place, word, score, status (good from 0.85 or the threshold on)."""
    words = T.tokens(T.for_scoring(text))
    each = rows.select("*", F.posexplode(words).alias("place", "word"))
    return each.withColumns({"status": status(F.col(score), threshold, max(0.85, threshold)), score: F.round(score, 6)})


def position(phone: Column, expected: Column) -> Column:
    """initial, medial or final, by the first place; unknown if the sound isn't expected."""
    at = F.array_position(F.transform(expected, lambda p: F.upper(p)), F.upper(phone))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "unknown").when(at == 1, "initial").when(at == F.size(expected), "final").otherwise("medial")


def acoustic_error(error: Column, right: Column, alignment: Column, weak: Column, nearest: Column, score: Column, expected: Column, decoded: Column) -> Column:
    """The kind of error that the sounds tell; ``error`` itself where they tell nothing.

    right: the analysis holds the answer for correct or accepted; alignment: usable, low_confidence or anything else, which
    is no evidence; weak: the lowest sound; nearest: its competitor; null sounds are ''.
    """
    weak, nearest = F.coalesce(weak, F.lit("")), F.coalesce(nearest, F.lit(""))
    poor, n, m = alignment == "low_confidence", F.size(expected), F.size(decoded)
    where, missing, named = position(weak, expected), ~F.array_contains(decoded, weak), nearest != ""
    kind = (
        F.when(poor & (F.coalesce(score, F.lit(0.0)) < 0.35), "low_confidence_audio").when((m > n) & (n > 0), "phoneme_insertion")
        .when((where == "final") & ((m < n) | (m == 0) | (missing & ~named)), "final_sound_omission").when(missing & ((m < n) | ~named), "phoneme_omission")
        .when(weak.isin(*P.VOWELS) | nearest.isin(*P.VOWELS), "vowel_confusion").when(where == "initial", "initial_sound_substitution")
        .when(where == "medial", "medial_sound_confusion").otherwise("consonant_confusion")
    )
    evidence = F.coalesce(alignment.isin("usable", "low_confidence"), F.lit(False))
    return F.when(~evidence, error).when(right, F.when(poor, "correct_with_low_confidence").otherwise(error)).when(weak == "", error).otherwise(kind)


def uncertainty(flags: Column, heard: Column, observed: Column, expected: Column, retry: bool = True, gate: bool = False) -> Column:
    """struct(uncertain, retry_required, reasons, gate_failed, message) of a recording.

    flags: array of what is wrong with it (keys of DOUBTS); heard: the transcript; observed: array of sounds. Nothing heard
    is a reason of its own, and one more where a text was expected.
    """
    mute = T.blank(heard) & (F.coalesce(F.size(observed), F.lit(0)) <= 0)
    flagged = [F.when(F.array_contains(flags, name), why) for name, why in DOUBTS.items()]
    reasons = F.array_compact(F.array(*flagged, F.when(mute, "blank_asr_transcript"), F.when(mute & ~T.blank(expected), "expected_text_without_reliable_asr_evidence")))
    some = F.size(reasons) > 0
    message = F.when(~some, "")
    for names, words in TOLD:
        message = message.when(F.arrays_overlap(reasons, F.array(*map(F.lit, names))), words)
    failed = F.lit(gate and retry) & F.arrays_overlap(flags, F.array(*map(F.lit, DOUBTS)))
    return F.struct(
        some.alias("uncertain"), (some & F.lit(retry)).alias("retry_required"), reasons.alias("reasons"), failed.alias("gate_failed"), message.otherwise(UNRELIABLE).alias("message")
    )


def _phones(table: dict[str, str], key: Column) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    return F.element_at(m, key)


def expected_phones(rows: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """Adds phones and phones_from: a letter's name, else a single word's override, else the lexicon's first variant.

    lexicon: (word, variant, phones). Texts without a word are empty, several words sentence_skipped, unknown words
    unavailable; all of these have no phones. The lexicon is joined by word, so its size doesn't matter.
    """
    first = lexicon.groupBy(F.col("word").alias("__w")).agg(F.min_by("phones", "variant").alias("__p"))
    form = rows.withColumn("__w", T.for_scoring(text))
    met = form.join(first, "__w", "left")
    w, n = F.col("__w"), F.size(T.tokens(F.col("__w")))
    letter, own, listed = w.rlike("^[a-z]$"), _phones(OVERRIDES, F.replace(w, F.lit("'"), F.lit(""))), P.without_stress(F.col("__p"))
    phones = F.when(letter, _phones(NAMES, w)).when(n == 1, F.coalesce(own, listed))
    source = (
        F.when(letter, "letter_name").when(n == 0, "empty").when(n > 1, "sentence_skipped").when(own.isNotNull(), "override").when(listed.isNotNull(), "lexicon").otherwise("unavailable")
    )
    return met.withColumns({"phones": F.coalesce(phones, F.array().cast("array<string>")), "phones_from": source}).drop("__w", "__p")


def letter_sound(letter: Column) -> Column:
    """The sound, as an array, that a single letter makes by itself: as when a word is spelled out, but for o."""
    return _phones(P.LETTERS | {"o": "AA"}, F.lower(letter))


def canonical_phones(rows: DataFrame, text: str, kind: Column, lexicon: DataFrame) -> DataFrame:
    """Adds phones and phones_from: a letter's own sound where the task asks for sounds, else as expected_phones, else by spelling."""
    known = expected_phones(rows.withColumn("__sound", F.trim(text).rlike("^[A-Za-z]$") & F.lower(kind).contains("sound")), text, lexicon)
    spelled = P.spelled(F.regexp_replace(T.for_scoring(text), "[^a-z]", ""))
    by_rule = (F.size("phones") == 0) & (F.size(spelled) > 0)
    return known.withColumns({
        "phones": F.when(F.col("__sound"), letter_sound(F.trim(text))).when(by_rule, spelled).otherwise(F.col("phones")),
        "phones_from": F.when(F.col("__sound"), "letter_sound").when(by_rule, "spelling").otherwise(F.col("phones_from")),
    }).drop("__sound")


def fragment_reasons(expected: Column, raw: Column, kind: Column, sound: Column, bad_audio: Column, least_share: float = 0.50, least_sound: float = 0.65) -> Column:
    """Why what was heard may be a fragment of the expected text, in order; none for letters. Texts in scoring form.

    sound: how much of the sounds was met, or null; bad_audio: the recording is too poor to judge by.
    """
    e, r = F.replace(expected, F.lit(" "), F.lit("")), F.replace(raw, F.lit(" "), F.lit(""))
    vowel, letters = "[aeiouy]", lambda c: F.regexp_replace(c, "[^a-z]", "")
    bones, heard = F.regexp_replace(letters(e), vowel, ""), letters(r)
    skeleton = (F.length(r) < F.length(e)) & (F.length(heard) >= 2) & (bones != "") & D.is_subsequence(D.letters(heard), D.letters(bones))
    found = [
        ("blank_raw_transcript", r == ""), ("raw_too_short_for_non_letter", (F.length(r) <= 1) & (F.length(e) > 1)), ("raw_missing_vowel_like_character", e.rlike(vowel) & ~r.rlike(vowel)),
        ("raw_shorter_than_expected_ratio", kind.isin("word", "rhyme", "rhyming_word") & (e != "") & (F.length(r) < least_share * F.length(e))), ("raw_looks_like_consonant_skeleton", skeleton),
    ]
    so_far = F.array_compact(F.array(*[F.when(holds, name) for name, holds in found]))
    more = F.array_compact(F.array(F.when((F.size(so_far) > 0) & (sound < least_sound), "incomplete_phoneme_coverage"), F.when(bad_audio, "bad_audio_quality")))
    return F.when(kind == "letter", F.array().cast("array<string>")).otherwise(F.concat(so_far, more))
