"""From frames of sounds to a record: expected phones in a model's labels, their frames, scores, a decision, and what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import kernels as K
from lexmill.functions import phonemes as P
from lexmill.functions import text as T
from lexmill.functions.binding import Get, staged
from lexmill.operators import correction as C
from lexmill.operators import pronunciation as N
from lexmill.operators.dynamic import _met

#: The labels that models have for each phone, the likeliest first.
LABELS = {
    "AA": ["ɑ", "ɑː", "a"], "AE": ["æ", "a"], "AH": ["ʌ", "ə", "ɐ"], "AO": ["ɔ", "ɔː", "o"], "AW": ["aʊ"], "AY": ["aɪ"], "EH": ["ɛ", "e"], "ER": ["ɚ", "ɜː", "ɜ", "ə"], "EY": ["eɪ", "e"],
    "IH": ["ɪ", "i"], "IY": ["i", "iː"], "OW": ["oʊ", "o"], "OY": ["ɔɪ", "oɪ"], "UH": ["ʊ", "u", "uː"], "UW": ["u", "uː"], "B": ["b"], "CH": ["tʃ", "tS"], "D": ["d"], "DH": ["ð"], "F": ["f"],
    "G": ["ɡ", "g"], "HH": ["h"], "JH": ["dʒ", "dZ"], "K": ["k"], "L": ["l"], "M": ["m"], "N": ["n"], "NG": ["ŋ"], "P": ["p"], "R": ["ɹ", "r"], "S": ["s"], "SH": ["ʃ"], "T": ["t"], "TH": ["θ"],
    "V": ["v"], "W": ["w"], "Y": ["j", "y"], "Z": ["z"], "ZH": ["ʒ"],
}
#: Prompts that can be scored; thresholds by kind; limits of the help for short words.
SHORT = ("letter", "word", "rhyme", "rhyming_word")
LONG = ("sentence", "paragraph", "passage", "final_sentence", "reading_passage")
NEED = {"letter": 0.70, "sentence": 0.70, "final_sentence": 0.70, "paragraph": 0.70, "passage": 0.70, "reading_passage": 0.70}
WORD_NEED, USABLE, HELP_OVERALL, HELP_CONSONANT, HELP_PHONES = 0.75, 0.25, 0.60, 0.80, 5
FLAGS = ("mostly_silent", "no_speech_detected", "too_short", "clipped")


def _base(phone: Column) -> Column:
    return F.regexp_replace(F.upper(phone), "[0-9]", "")


def model_labels(phones: Column, labels: list[str]) -> Column:
    """For each phone the label by which a model knows it, null for none: the phone as written, then as LABELS ranks them."""
    known = F.array(*map(F.lit, labels))

    def first(phone: Column) -> Column:
        base = _base(phone)
        ranked = F.concat(F.array(F.trim(phone), F.upper(F.trim(phone)), F.lower(F.trim(phone)), base, F.lower(base)), C._lists(LABELS, base))
        return F.get(F.filter(ranked, lambda x: F.array_contains(known, x)), F.lit(0))

    return F.transform(phones, first)


def _numbers(mapped: Column, labels: list[str]) -> Column:
    """Places of labels in the model's vocabulary, from 0."""
    return F.transform(mapped, lambda x: (F.array_position(F.array(*map(F.lit, labels)), x) - 1).cast("int"))


def helped(phones: Column, scores: Column, overall: Column, usable: Column, kind: Column, single: Column) -> Column:
    """struct(accepted, reason): whether a short word is right by its consonants, its weak vowels being heard as allowed variants.

    scores: array of struct(score, competitor) in the order of phones; single: the text is one word.
    """
    both = F.arrays_zip(phones.alias("phone"), scores.alias("s"))
    vowel = lambda x: _base(x["phone"]).isin(*P.VOWELS)
    weak = lambda x: x["s"]["score"] < HELP_CONSONANT
    allowed = lambda x: F.array_contains(C._lists(LABELS, _base(x["phone"])), x["s"]["competitor"])
    consonants, vowels = F.filter(both, lambda x: ~vowel(x)), F.filter(both, lambda x: vowel(x) & weak(x))
    reason = (
        F.when(~kind.isin("word", "rhyme", "rhyming_word"), F.concat(F.lit("prompt type "), kind, F.lit(" is not a short word prompt"))).when(~single, "expected text is not a single short word")
        .when((F.size(phones) < 2) | (F.size(phones) > HELP_PHONES), "expected phoneme count is outside short-word assist limits").when(~usable, "GOP alignment is not usable")
        .when(overall < HELP_OVERALL, "overall GOP is below short-word assist threshold").when(F.size(scores) != F.size(phones), "phoneme score count does not match expected phoneme count")
        .when(F.size(consonants) < 2, "short-word assist requires at least two consonant phonemes").when(F.exists(consonants, weak), "one or more expected consonants had weak acoustic GOP evidence")
        .when(F.exists(vowels, lambda x: ~F.coalesce(allowed(x), F.lit(False))), "weak vowel competitor is not an allowed acoustic variant").when(F.size(vowels) == 0, "no weak allowed vowel variant needed short-word assist")
        .otherwise("Acoustic GOP matched the expected short-word consonant structure and the weak vowel matched an allowed acoustic variant")
    )
    return F.struct(reason.startswith("Acoustic").alias("accepted"), reason.alias("reason"))


def pronounced(
    rows: DataFrame, key: list[str], frames: str, labels: list[str], blank: int, lexicon: DataFrame, text: str = "expected", kind: str = "kind", raw: str | None = None, decoded: str | None = None,
    flags: str | None = None, retry: str | None = None, uncertain: str | None = None, weak: float = N.WEAK, acceptable: float = N.ACCEPTABLE,
) -> DataFrame:
    """One row per input row: (key, decision, reason, score, confidence, need, phones, mapped, scores, quality, weakest, nearest, help).

    frames: array of frames, each the labels' log scores, or null; key names each row once. What can't be scored says why,
    in the order: no text, kind, recording, phones, frames, labels, path. scores: per phone struct(place, phone, label,
    start, stop, score, margin, status, competitor). decoded: labels that were heard. Of equal scores the first is weakest.
    """
    col = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name else F.lit(default)
    spoken = N.canonical_phones(rows.withColumn("__text", F.trim(F.coalesce(F.col(text), F.lit("")))), "__text", F.coalesce(F.col(kind), F.lit("")), lexicon)
    form = spoken.withColumn("mapped", model_labels(F.col("phones"), labels))
    lacking = F.array_compact(F.transform(F.arrays_zip("phones", "mapped"), lambda x: F.when(x["mapped"].isNull(), x["phones"])))
    bad = F.when(col(retry, False), "retry_required is true").when(col(uncertain, False), "uncertain audio is true")
    if flags:
        for name in FLAGS:
            bad = bad.when(F.array_contains(flags, name), f"audio quality flag {name} is true")
    said = lambda d, r: F.struct(F.lit(d).alias("d"), (F.lit(r) if isinstance(r, str) else r).alias("r"))
    asked = F.coalesce(F.col(kind), F.lit(""))
    why = (
        F.when(F.col("__text") == "", said("skipped_no_expected_text", "expected_text is missing"))
        .when(~asked.isin(*SHORT, *LONG), said("skipped_unsupported_prompt_type", F.concat(F.lit("unsupported prompt type: "), asked))).when(bad.isNotNull(), said("skipped_bad_audio", bad))
        .when(F.size("phones") == 0, said("not_available", "expected phonemes are unavailable")).when(F.col(frames).isNull(), said("not_available", "phoneme frame probabilities are unavailable"))
        .when(F.size(lacking) > 0, said("alignment_failed", F.concat(F.lit("phoneme token not found in model vocabulary: "), F.array_join(lacking, ", "))))
        .when(F.size(frames) == 0, said("alignment_failed", "frame log probabilities are empty"))
    )
    form = form.select(F.struct(*key).alias("__key"), why.alias("why"), "phones", "mapped", F.col("__text").alias("text"), F.coalesce(F.col(kind), F.lit("")).alias("kind"),
        F.col(frames).alias("frames"), (F.col(raw) if raw else F.lit("")).alias("raw"), (F.col(decoded) if decoded else F.lit(None).cast("array<string>")).alias("decoded"))
    ready = form.where("why is null").select("__key", "frames", _numbers(F.col("mapped"), labels).alias("numbers")).withColumn("segments", K.segments("frames", "numbers", F.lit(blank)))
    each = N.scored(ready.where("segments is not null").select("__key", "frames", "segments"), "frames", "segments", labels, blank, weak, acceptable)
    told = F.struct("place", F.col("phone").alias("label"), F.col("start"), (F.col("end") + 1).alias("stop"), "score", "margin", "status", "competitor")
    found = each.groupBy("__key").agg(F.array_sort(F.collect_list(told)).alias("found"))
    out = _met(form.drop("frames"), found, ["__key"], "left")

    def scores(get: Get) -> dict[str, Column]:
        named = F.transform(F.arrays_zip(get("found").alias("f"), get("phones").alias("p")), lambda x: F.struct(
            x["f"]["place"].alias("place"), x["p"].alias("phone"), x["f"]["label"].alias("label"), x["f"]["start"].alias("start"), x["f"]["stop"].alias("stop"), x["f"]["score"].alias("score"),
            x["f"]["margin"].alias("margin"), x["f"]["status"].alias("status"), x["f"]["competitor"].alias("competitor")))
        ok = get("found").isNotNull()
        return {"scores": F.when(ok, named), "score": F.when(ok, F.aggregate(get("found"), F.lit(0.0), lambda a, x: a + x["score"]) / F.size(get("found"))), "need": _need(get("kind"))}

    def weighed(get: Get) -> dict[str, Column]:
        e, r = T.for_scoring(get("text")), T.for_scoring(get("raw"))
        heard = F.filter(F.transform(F.coalesce(get("decoded"), F.array().cast("array<string>")), lambda x: F.regexp_replace(F.upper(x), r"[^\p{L}]", "")), lambda x: x != "")
        alike = F.when(F.size(heard) == 0, 0.0).otherwise(P.similarity(get("phones"), heard))
        lowest = F.array_min(F.transform(get("scores"), lambda x: F.struct(x["score"].alias("score"), x["place"].alias("place"), x["phone"].alias("phone"), x["competitor"].alias("competitor"))))
        usable = get("score") >= USABLE
        return {
            "confidence": F.round((get("score") + alike + C.support(e, r)) / 3, 6), "lowest": lowest, "quality": F.when(get("score").isNull(), "failed").when(usable, "usable").otherwise("low_confidence"),
            "help": helped(get("phones"), get("scores"), get("score"), usable, get("kind"), (e != "") & ~F.contains(e, F.lit(" "))),
        }

    def decided(get: Get) -> dict[str, Column]:
        scored = F.when(get("score") >= get("need"), "accepted_by_pronunciation_evidence").when(get("help")["accepted"], "accepted_by_short_word_gop_structure").otherwise("rejected_low_gop")
        return {
            "decision": F.coalesce(get("why")["d"], F.when(get("score").isNull(), "alignment_failed").otherwise(scored)),
            "reason": F.coalesce(get("why")["r"], F.when(get("score").isNull(), "CTC alignment did not find a valid path")),
        }

    made = staged({c: F.col(c) for c in ("why", "phones", "mapped", "text", "kind", "raw", "decoded", "found")}, scores, weighed, decided)
    out = out.withColumn("__made", made)
    get = lambda name: F.col("__made").getField(name)
    some = get("score").isNotNull()
    return out.select(
        *[F.col("__key").getField(c).alias(c) for c in key], get("decision").alias("decision"), get("reason").alias("reason"), F.round(get("score"), 6).alias("score"), F.when(some, get("confidence")).alias("confidence"),
        get("need").alias("need"), get("phones").alias("phones"), get("mapped").alias("mapped"), get("scores").alias("scores"), get("quality").alias("quality"), get("lowest")["phone"].alias("weakest"),
        get("lowest")["competitor"].alias("nearest"), F.when(some, get("help")).alias("help"),
    )


def _need(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in NEED.items() for x in p]), kind), F.lit(WORD_NEED))


def applied(expected: Column, kind: Column, accepted: Column, alike: Column, threshold: Column, displayed: Column, composite: Column, decision: Column, score: Column) -> Column:
    """struct(accepted, displayed, strategy, composite, changed): what the sounds change in a transcript's record.

    A short word that its consonants carry is accepted outright; other evidence only supports what the transcript has
    accepted, or is alike enough for, of a short prompt. strategy is null where the record's own stays.
    """
    support = F.coalesce(accepted, F.lit(False)) | (F.coalesce(alike, F.lit(0.0)) >= F.coalesce(threshold, F.lit(1.0)))
    text = F.trim(F.coalesce(expected, F.lit(""))) != ""
    by_help = (decision == "accepted_by_short_word_gop_structure") & text & kind.isin("word", "rhyme", "rhyming_word")
    by_sound = (decision == "accepted_by_pronunciation_evidence") & text & kind.isin(*SHORT) & support
    changed = F.coalesce(by_help | by_sound, F.lit(False))
    return F.struct(
        (changed | F.coalesce(accepted, F.lit(False))).alias("accepted"), F.when(changed, F.trim(expected)).otherwise(displayed).alias("displayed"),
        F.when(by_help, "gop_assisted_short_word_structure").when(by_sound, "expected_centric_with_acoustic_gop").alias("strategy"),
        F.when(changed, F.greatest(F.coalesce(composite, F.lit(0.0)), F.coalesce(score, F.lit(0.0)))).otherwise(composite).alias("composite"), changed.alias("changed"),
    )
