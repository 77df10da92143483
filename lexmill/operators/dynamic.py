"""Correction of what was heard towards what was expected, with all evidence made here: words, and chunks of longer texts.

Words: rows that settle themselves (skipped, blank, equal) leave first; only the rest is joined with learned corrections
and a lexicon, compared, and taken down the ladder. Longer texts: every pair of chunks of one to three words is a row of
a table; pairs that can't be better than wrong leave by distances the JVM has built in; what is left is scored once for
each distinct pair, whatever texts it comes from; then each text takes its cheapest path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import kernels as K
from lexmill.functions import phonemes as P
from lexmill.functions import text as T
from lexmill.functions.binding import Get, staged
from lexmill.operators import correction as C
from lexmill.operators import pronunciation as N

#: Kinds of prompts that are read word by word, and thresholds by kind: of words, of spelling variants.
LONG = ("sentence", "paragraph", "passage", "reading_passage", "final_sentence", "final_passage")
NEED = {"letter": 0.72, "rhyme": 0.78, "rhyming_word": 0.78, "sentence": 0.80, "final_sentence": 0.80, "paragraph": 0.82, "passage": 0.82, "reading_passage": 0.82, "final_passage": 0.82}
VARIANT_NEED = {"letter": 0.72, "rhyme": 0.78, "rhyming_word": 0.78, "sentence": 0.82, "final_sentence": 0.82, "paragraph": 0.84, "passage": 0.84, "reading_passage": 0.84, "final_passage": 0.84}
WORD_NEED = 0.78
HOMOPHONE, CLEAR, FRAGMENT_GOP, FRAGMENT_SOUND = 0.96, 0.75, 0.88, 0.82
#: Weights of evidence for letters, longer texts and other words; for variants of letters and of others.
LETTER_WEIGHTS = {"sound": 0.35, "gop": 0.25, "spelling": 0.20, "known": 0.10, "context": 0.10}
LONG_WEIGHTS = {"sound": 0.30, "gop": 0.20, "spelling": 0.20, "context": 0.20, "known": 0.10}
WORD_WEIGHTS = {"sound": 0.30, "gop": 0.25, "spelling": 0.20, "context": 0.15, "known": 0.10}
LETTER_VARIANT = {"skeleton": 0.30, "sound": 0.25, "gop": 0.20, "spelling": 0.15, "context": 0.10}
WORD_VARIANT = {"skeleton": 0.25, "vowels": 0.20, "gop": 0.20, "sound": 0.15, "spelling": 0.10, "context": 0.10}
#: Sizes of chunks that may meet, expected by heard; weights of chunks of one size and of two.
SIZES = ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (1, 3))
SAME_SIZE = {"spelling": 0.25, "skeleton": 0.15, "vowels": 0.15, "sound": 0.30, "gop": 0.10, "context": 0.05}
OTHER_SIZE = {"boundary": 0.28, "skeleton": 0.17, "vowels": 0.15, "sound": 0.25, "gop": 0.10, "context": 0.05}
ACCEPT, PARTIAL, BOUNDARY, COMPARED = 0.82, 0.65, 0.84, 0.58
WRONG = 1.05


def _by_kind(table: dict[str, float], kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), kind), F.lit(WORD_NEED))


def _mean(weights: dict[str, float], get: Get) -> Column:
    """Weighted mean of the evidence that is not null."""
    return C.weighted({name: (get(name), w) for name, w in weights.items()})


def likeness(rows: DataFrame, expected: str, raw: str) -> DataFrame:
    """Adds boundary, spelling, skeleton and vowels: how alike two scoring forms are, from 0 to 1.

    boundary: by matching blocks of the texts without blanks; spelling: the better of that and of the texts as they are;
    skeleton: of the consonants, at least their share where one's stand in the other's; vowels: by edits in which a vowel
    replaces another at a quarter.
    """
    plain = lambda c: F.replace(F.col(c), F.lit("'"), F.lit(""))
    joined = lambda c: F.replace(plain(c), F.lit(" "), F.lit(""))
    ratio = lambda a, b: F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.round(K.block_ratio(a, b), 6))
    only, bones = lambda c: F.regexp_replace(c, "[^a-z]", ""), lambda c: F.regexp_replace(c, "[^a-z]|[aeiouy]", "")
    out = rows.withColumns({"__a": joined(expected), "__b": joined(raw), "__s": bones(expected), "__t": bones(raw), "__x": only(expected), "__y": only(raw)})
    a, b, s, t, x, y = (F.col(c) for c in ("__a", "__b", "__s", "__t", "__x", "__y"))
    out = out.withColumns({"boundary": ratio(a, b), "__spaced": ratio(plain(expected), plain(raw)), "__bones": ratio(s, t), "__edits": K.lenient_edits(x, y)})
    within = D.is_subsequence(D.letters(s), D.letters(t)) | D.is_subsequence(D.letters(t), D.letters(s))
    share = F.least(F.length(s), F.length(t)) / F.greatest(F.length(s), F.length(t))
    longest = F.greatest(F.length(x), F.length(y))
    return out.withColumns({
        "spelling": F.greatest("__spaced", "boundary"),
        "skeleton": F.when((s == "") & (t == ""), F.greatest("__spaced", "boundary")).when((s == "") | (t == ""), 0.0).when(s == t, 1.0)
            .when(within, F.round(F.greatest(F.col("__bones"), share), 6)).otherwise(F.col("__bones")),
        "vowels": F.when(longest == 0, 1.0).when((x == "") | (y == ""), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("__edits") / longest), 6)),
    }).drop("__a", "__b", "__s", "__t", "__x", "__y", "__spaced", "__bones", "__edits")


def with_sounds(rows: DataFrame, expected: str, raw: str, lexicon: DataFrame | None) -> DataFrame:
    """Adds heard_sound: how alike two words sound by their listed phones, null where either has none."""
    spark = rows.sparkSession
    lexicon = lexicon if lexicon is not None else spark.createDataFrame([], "word string, variant int, phones array<string>")
    words = rows.select(F.explode(F.array(expected, raw)).alias("__word")).distinct()
    known = N.expected_phones(words, "__word", lexicon).where(F.size("phones") > 0)
    left = known.select(F.col("__word").alias(expected), F.col("phones").alias("__x"))
    right = known.select(F.col("__word").alias(raw), F.col("phones").alias("__y"))
    both = F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), P.similarity(F.col("__x"), F.col("__y")))
    return rows.join(left, expected, "left").join(right, raw, "left").withColumn("heard_sound", both).drop("__x", "__y")


def _alias(e: Column, r: Column) -> Column:
    compact = F.replace(r, F.lit(" "), F.lit(""))
    return F.array_contains(C._lists(C.SPOKEN, e), compact) | ((e == "q") & (compact == "you"))


def _evidence(get: Get) -> dict[str, Column]:
    e, r, kind, letter = get("e"), get("r"), get("kind"), get("kind") == "letter"
    confused = F.array_contains(C._lists(C.CONFUSED, F.replace(e, F.lit("'"), F.lit(""))), F.replace(r, F.lit("'"), F.lit("")))
    alias = letter & _alias(e, r)
    return {
        "alias": alias, "known": F.when(confused | alias, 0.95).otherwise(0.0), "homophone": F.coalesce(get("sound") >= HOMOPHONE, F.lit(False)) & (e != r),
        "need": _by_kind(NEED, kind), "variant_need": _by_kind(VARIANT_NEED, kind), "fragments": N.fragment_reasons(e, r, kind, get("sound"), get("bad_audio")),
        "gop0": F.coalesce(get("gop"), F.lit(0.0)), "sound0": F.coalesce(get("sound"), F.lit(0.0)),
    }


def _scores(get: Get) -> dict[str, Column]:
    letter, long = get("kind") == "letter", get("kind").isin(*LONG)
    return {
        "final": F.when(letter, _mean(LETTER_WEIGHTS, get)).when(long, _mean(LONG_WEIGHTS, get)).otherwise(_mean(WORD_WEIGHTS, get)),
        "variant": F.when(letter, _mean(LETTER_VARIANT, get)).otherwise(_mean(WORD_VARIANT, get)),
    }


def _rung(get: Get) -> dict[str, Column]:
    found = C.ladder(get("e"), get("r"), get("final"), get("need"), get("spelling"), get("sound"), get("gop"), get("context"), get("known"), get("homophone"), least_acoustic=CLEAR)
    # A noisy spelling of the word: enough consonants, enough vowels or other evidence, and no bare guess at a short word.
    other = (get("gop0") >= 0.82) | (get("sound0") >= 0.70)
    bare = (F.length(get("e")) <= 3) & get("gop").isNull() & get("sound").isNull()
    fits = (get("variant") >= get("variant_need")) & ((get("skeleton") >= 0.80) | (get("spelling") >= 0.84) | other) & ((get("vowels") >= 0.78) | other) & ~bare
    return {"rung": found, "fits": fits & ~C.unsafe_pair(get("e"), get("r")) & ~get("bad_audio")}


def _stage(get: Get) -> dict[str, Column]:
    found, odd = get("rung")["reason"], F.size(get("fragments")) > 0
    clear_cut = found.isin("homophone_match", "known_asr_confusion_match", "gop_supported_expected_match")
    variant, learned = get("fits") & ~clear_cut, get("learned") & (get("kind") != "letter")
    stage = (
        F.when(learned, "reinforcement_error_transcript_match").when(get("alias"), "letter_alias_match").when(odd & get("bad_audio"), "fragment_retry_bad_audio")
        .when(odd & (get("gop0") >= FRAGMENT_GOP), "fragment_gop_supported_expected_match").when(odd & (get("sound0") >= FRAGMENT_SOUND), "fragment_phoneme_supported_expected_match")
        .when(odd, "rejected_suspicious_fragment_low_pronunciation_evidence").when(variant, "vowel_tolerant_consonant_skeleton_match").otherwise(found)
    )
    return {"sub_strategy": stage, "odd": odd & ~learned & ~get("alias"), "is_variant": variant & ~odd & ~learned & ~get("alias"), "by_list": learned, "alias": get("alias") & ~learned}


def _outcome(get: Get) -> dict[str, Column]:
    s, final, sure = get("sub_strategy"), get("final"), get("by_list") | get("alias")
    raised = (
        F.when(s == "homophone_match", F.greatest(final, get("sound0"))).when(s == "gop_supported_expected_match", F.greatest(final, get("gop0")))
        .when(s == "spelling_context_expected_match", F.greatest(final, get("spelling"))).when(s == "known_asr_confusion_match", F.greatest(final, get("known"))).otherwise(final)
    )
    return {
        "accepted": ~(s.startswith("rejected") | (s == "fragment_retry_bad_audio")),
        "strategy": F.when(get("by_list"), "reinforcement_error_transcript_match").when(get("is_variant"), "dynamic_asr_spelling_variant").otherwise("dynamic_expected_word_correction"),
        "confidence": F.round(F.when(get("by_list"), 1.0).when(get("alias"), 0.98).when(get("odd"), F.greatest(get("gop0"), get("sound0"))).when(get("is_variant"), get("variant")).otherwise(raised), 6),
        "need": F.when(get("odd"), F.when(s == "fragment_phoneme_supported_expected_match", FRAGMENT_SOUND).otherwise(FRAGMENT_GOP)).when(get("is_variant"), get("variant_need")).otherwise(get("need")),
        "homophone": get("homophone") & ~sure,
    }


INPUT = ("e", "r", "kind", "gop", "sound", "context", "bad_audio", "learned", "boundary", "spelling", "skeleton", "vowels")
DECISION = (_evidence, _scores, _rung, _stage, _outcome)
#: What is known of a row before it is compared.
READ = ("e", "r", "kind", "gop", "sound", "context", "bad_audio")


RESULT = ("accepted", "strategy", "sub_strategy", "confidence", "need", "spelling", "sound", "homophone", "known", "skeleton", "vowels", "is_variant", "variant", "fragments")


def _compared(rows: DataFrame, lexicon: DataFrame | None, learned: DataFrame | None) -> DataFrame:
    """Rows of e, r, kind, gop, sound, context and bad_audio with all that the decision about them needs."""
    if learned is not None:
        pairs = learned.select(T.for_scoring("expected").alias("e"), T.for_scoring("raw").alias("r"), F.lit(True).alias("learned")).distinct()
        rows = rows.join(pairs, ["e", "r"], "left").withColumn("learned", F.coalesce("learned", F.lit(False)))
    else:
        rows = rows.withColumn("learned", F.lit(False))
    rows = with_sounds(rows, "e", "r", lexicon).withColumn("sound", F.coalesce("sound", "heard_sound")).drop("heard_sound")
    return likeness(K.spread(rows, "e", "r"), "e", "r")


def correct_words(
    rows: DataFrame, lexicon: DataFrame | None = None, learned: DataFrame | None = None, expected: str = "expected", raw: str = "raw", kind: str | None = None, gop: str | None = None,
    sound: str | None = None, context: str | None = None, retry: str | None = None, uncertain: str | None = None, bad_audio: str | None = None,
) -> DataFrame:
    """Adds ``dynamic``, a struct of the decision and its evidence, and ``corrected``: the expected text if accepted, else what was heard.

    lexicon: (word, variant, phones); learned: (expected, raw). kind: the prompt's, else letter, word or sentence by its
    words. gop: score of the sounds; sound: likeness of the sounds, where it is known already. A row is skipped where
    ``retry`` or ``uncertain`` holds or nothing was expected. Null texts are blank, null flags false, a null context 1.
    """
    col = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name else F.lit(default)
    number = lambda name: (F.col(name) if name else F.lit(None)).cast("double")
    e, r = T.for_scoring(expected), T.for_scoring(raw)
    known_kind = F.col(kind) if kind else F.lit(None).cast("string")
    guessed = F.when(e == "", "unknown").when(e.rlike("^[a-z]$"), "letter").when(F.size(T.tokens(e)) == 1, "word").otherwise("sentence")
    form = rows.withColumns({
        "e": e, "r": r, "kind": F.coalesce(known_kind, guessed), "gop": number(gop), "sound": number(sound), "context": F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(context, 1.0))), "bad_audio": col(bad_audio, False),
    })
    settled = (
        F.when(col(retry, False), "skipped_retry_required").when(col(uncertain, False), "skipped_uncertain_audio").when(F.col("e") == "", "skipped_no_expected_text")
        .when(F.col("r") == "", "rejected_blank_raw_transcript").when(F.col("e") == F.col("r"), "exact_normalized_match")
    )
    form = form.withColumn("settled", settled)
    same = F.col("settled") == "exact_normalized_match"
    blank = F.col("settled") == "rejected_blank_raw_transcript"
    plain = {
        "accepted": same, "strategy": F.lit("dynamic_expected_word_correction"), "sub_strategy": F.col("settled"), "confidence": F.when(same, 1.0).otherwise(0.0), "need": _by_kind(NEED, F.col("kind")),
        "spelling": F.when(same, 1.0).otherwise(0.0), "homophone": F.lit(False), "known": F.when(same, 1.0).otherwise(0.0), "skeleton": F.lit(None).cast("double"), "vowels": F.lit(None).cast("double"),
        "is_variant": F.lit(False), "variant": F.lit(None).cast("double"),
        "fragments": F.when(blank, N.fragment_reasons(F.col("e"), F.col("r"), F.col("kind"), F.lit(None).cast("double"), F.col("bad_audio"))).otherwise(F.array().cast("array<string>")),
    }
    packed = lambda df, made: df.withColumn("__made", made).select(*rows.columns, F.struct(*[F.col(f"__made.{n}") for n in RESULT]).alias("dynamic"))
    easy = packed(form.where("settled is not null").withColumns({"sound": F.lit(None).cast("double")}), F.struct(F.lit(None).cast("double").alias("sound"), *[c.alias(n) for n, c in plain.items()]))
    # What a decision reads repeats: each distinct set of it is compared and decided once.
    left = form.where("settled is null")
    decided = _compared(left.select(*READ).distinct().withColumn("given", F.col("sound")), lexicon, learned).withColumn("__made", staged({c: F.col(c) for c in INPUT}, *DECISION))
    decided = decided.select(*[F.col("given" if c == "sound" else c).alias(f"__read_{c}") for c in READ], "__made")
    hard = packed(left.join(decided, [F.col(c).eqNullSafe(F.col(f"__read_{c}")) for c in READ]).withColumn("sound", F.col("__made.sound")), F.col("__made"))
    return easy.unionByName(hard).withColumn("corrected", F.when(F.col("dynamic.accepted"), F.col(expected)).otherwise(F.col(raw)))


#: What chunks are compared by: without blanks, as they are, consonants, and with all vowels alike.
FORMS = ("joined", "plain", "bones", "same")


def _chunks(words: Column, at: str, size: str, text: str) -> Column:
    """All runs of one to three words: struct(place, size, text) and the forms of the text, made once for all that it meets."""

    def run(i: Column, k: Column) -> Column:
        t = F.array_join(F.slice(words, i + 1, k), " ")
        only = F.regexp_replace(t, "[^a-z]", "")
        forms = (F.regexp_replace(t, "[ ']", ""), F.replace(t, F.lit("'"), F.lit("")), F.regexp_replace(only, "[aeiouy]", ""), F.regexp_replace(only, "[aeiouy]", "a"))
        return F.struct(i.alias(at), k.alias(size), t.alias(text), *[f.alias(f"{text}_{n}") for f, n in zip(forms, FORMS, strict=True)])

    runs = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(words) - i)), lambda k: run(i, k))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), runs))


def _worth(cells: DataFrame) -> DataFrame:
    """Adds worth: whether a pair of chunks can be anything but wrong, by bounds that keep all that is.

    Matching blocks are never more than edits leave, and a vowel's quarter is more than nothing. Single words may have
    sounds that speak for them, so they stay if they would be compared at all; others must reach a partial match.
    """

    def most(form: str, of: Callable[[Column, Column], Column]) -> Column:
        a, b = F.col(f"e_{form}"), F.col(f"r_{form}")
        longest = of(F.length(a), F.length(b))
        return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)

    total = lambda a, b: a + b
    start = {c: F.col(c) for c in ("e", "r", "gop", "k", "l", "e_bones", "r_bones")} | {"boundary": most("joined", total), "spaced": most("plain", total), "bones": most("bones", total), "vowels": most("same", F.greatest)}

    def judged(get: Get) -> dict[str, Column]:
        spelling = F.greatest(get("spaced"), get("boundary"))
        skeleton = F.greatest(get("bones"), F.when((get("e_bones") == "") & (get("r_bones") == ""), spelling).otherwise(0.0))
        held = F.when(get("gop").isNotNull(), 0.10).otherwise(0.0)
        rest = 0.15 * get("vowels") + 0.05 + held * F.coalesce(get("gop"), F.lit(0.0))
        apart, alike = (0.28 * get("boundary") + 0.17 * skeleton + rest) / (0.65 + held), (0.25 * spelling + 0.15 * skeleton + rest) / (0.60 + held)
        single, slack = (get("k") == 1) & (get("l") == 1), 1e-6
        stays = (
            F.when(single, F.greatest(spelling, skeleton, get("vowels")) >= COMPARED - slack).when(get("k") != get("l"), (get("boundary") >= BOUNDARY - slack) | (apart >= PARTIAL - slack))
            .otherwise(alike >= PARTIAL - slack)
        )
        return {"stays": stays | (get("e") == get("r")) | F.coalesce(get("gop") >= CLEAR, F.lit(False))}

    return cells.withColumn("worth", staged(start, judged)["stays"])


PAIR = ("e", "r", "k", "l", "kind", "gop")


def _met(rows: DataFrame, other: DataFrame, keys: list[str] | tuple[str, ...], how: str = "inner") -> DataFrame:
    """The rows with the other columns of a table, joined by keys that may be null and that are kept once."""
    named = other.withColumnsRenamed({c: f"__{c}" for c in keys})
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], how).drop(*[f"__{c}" for c in keys])


def _looked(get: Get) -> dict[str, Column]:
    """Sounds count where they are worth looking at; chunks of several words have none."""
    exact, clear = get("e") == get("r"), F.coalesce(get("gop") >= CLEAR, F.lit(False))
    looked = ~exact & ((F.greatest(get("spelling"), get("boundary"), get("vowels"), get("skeleton")) >= COMPARED) | clear)
    return {"exact": exact, "clear": clear, "looked": looked, "sound": F.when(looked, get("sound")), "single": (get("k") == 1) & (get("l") == 1), "split": get("k") != get("l")}


def _sure(get: Get) -> dict[str, Column]:
    return {"sure": F.when(get("split"), _mean(OTHER_SIZE, get)).otherwise(_mean(SAME_SIZE, get)), "unsafe": get("single") & C.unsafe_pair(get("e"), get("r")), "listed": get("single") & get("learned")}


def _status(get: Get) -> dict[str, Column]:
    sure, taken = get("sure"), get("single") & get("looked") & get("accepted")
    joined = lambda c: F.replace(get(c), F.lit(" "), F.lit(""))
    homophone = (get("sound0") >= HOMOPHONE) & (joined("e") != joined("r"))
    merged = get("split") & ((get("boundary") >= BOUNDARY) | ((sure >= ACCEPT) & ((get("sound0") >= 0.80) | get("clear") | ((get("skeleton") >= 0.95) & (get("vowels") >= 0.70)))))
    by_word = (
        F.when(get("strategy") == "dynamic_asr_spelling_variant", "accepted_by_asr_spelling_variant").when(get("homophone"), "accepted_by_homophone").otherwise("accepted_by_dynamic_expected_word_correction")
    )
    status = (
        F.when(get("exact"), "exact_correct").when(get("unsafe"), "incorrect").when(get("listed"), "accepted_by_reinforcement_match").when(taken, by_word).when(homophone, "accepted_by_homophone")
        .when(merged, "accepted_by_split_merge").when(get("clear") & (sure >= ACCEPT), "accepted_by_gop").when((get("sound0") >= ACCEPT) & (sure >= ACCEPT), "accepted_by_phoneme_similarity")
        .when(sure >= PARTIAL, "partial").otherwise("incorrect")
    )
    return {"status": status, "taken": taken & ~get("exact") & ~get("unsafe") & ~get("listed")}


def _weighed(get: Get) -> dict[str, Column]:
    s, sure = get("status"), get("sure")
    raised = (
        F.when(get("exact") | (s == "accepted_by_reinforcement_match"), 1.0).when(get("unsafe"), F.least(sure, F.lit(0.49))).when(get("taken"), F.greatest(sure, get("confidence")))
        .when(s.isin("accepted_by_homophone", "accepted_by_phoneme_similarity"), F.greatest(sure, get("sound0"))).when(s == "accepted_by_gop", F.greatest(sure, get("gop0"))).otherwise(sure)
    )
    why = F.when(get("taken"), get("sub_strategy")).otherwise(F.element_at(F.create_map(*[F.lit(x) for p in BY_STATUS.items() for x in p]), s))
    return {"confidence": F.round(raised, 6), "sub_strategy": why, "correct": get("exact") | s.startswith("accepted_by_")}


def score_chunks(pairs: DataFrame, lexicon: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """Adds status, correct, confidence and the evidence to distinct pairs of chunks: e and r of k and l words, kind, gop."""
    form = pairs.withColumns({"sound": F.lit(None).cast("double"), "context": F.lit(1.0), "bad_audio": F.lit(False)})
    made = staged({c: F.col(c) for c in (*INPUT, "k", "l")}, _looked, *DECISION, _sure, _status, _weighed)
    names = ("status", "correct", "confidence", "sub_strategy", "spelling", "boundary", "sound", "skeleton", "vowels")
    return _compared(form, lexicon, learned).withColumn("__made", made).select(*PAIR, *[F.col(f"__made.{n}").alias(n) for n in names])


#: What a chunk's status is put down to.
BY_STATUS = {
    "exact_correct": "exact_normalized_match", "accepted_by_reinforcement_match": "reinforcement_error_transcript_match", "accepted_by_homophone": "homophone_match", "accepted_by_split_merge": "boundary_repair_expected_raw_joined_match", "accepted_by_gop": "gop_supported_chunk_match",
    "accepted_by_phoneme_similarity": "phoneme_supported_chunk_match", "partial": "partial_chunk_match", "incorrect": "rejected_low_alignment_confidence",
}


def cost(scored: DataFrame) -> DataFrame:
    """Pairs that a path may take at another cost than a wrong one: those of three words only where a boundary was clearly repaired."""
    s, sure = F.col("status"), F.col("confidence")
    price = F.when(s == "exact_correct", 0.01).when(s.startswith("accepted_by_"), F.greatest(F.lit(0.04), 0.35 - sure * 0.25)).when(s == "partial", F.greatest(F.lit(0.60), 1.0 - sure * 0.35)).otherwise(WRONG)
    repaired = (s == "accepted_by_split_merge") & ((F.col("boundary") >= 0.92) | (F.coalesce("sound", F.lit(0.0)) >= 0.90) | (sure >= 0.90))
    return scored.withColumn("price", price).where((s != "incorrect") & (((F.col("k") < 3) & (F.col("l") < 3)) | repaired))


def align_chunks(
    rows: DataFrame, key: list[str], lexicon: DataFrame | None = None, learned: DataFrame | None = None, expected: str = "expected", raw: str = "raw", kind: str | None = None, scores: str | None = None,
) -> DataFrame:
    """One row per expected word, and per inserted run, of each text: (key, place, chunk, operation, status, ...).

    key names each row once. Chunks of one to three words meet: one for one, or split or merged at their boundaries. A
    word that meets nothing is missing, one that was heard besides is inserted. kind: as in ``correct_words``, sentence by
    default; scores: map of words to the scores of their sounds. Null texts have no words; a text without words on either
    side gives no row. Equal costs: the path that takes the longest expected chunk first, then the longest heard one.
    """
    given = K.spread(rows).select(
        F.struct(*key).alias("__row"), F.coalesce(F.col(kind) if kind else F.lit(None).cast("string"), F.lit("sentence")).alias("kind"), T.for_scoring(expected).alias("own"), T.for_scoring(raw).alias("met"),
        F.map_entries(F.col(scores) if scores else F.lit(None).cast("map<string,double>")).alias("scores"),
    )
    # Readings repeat: each distinct one is aligned once, under the digest of all that its alignment reads.
    given = given.withColumn("__key", F.sha2(F.to_json(F.struct("kind", "own", "met", "scores")), 256))
    form = K.spread(given.drop("__row").distinct(), "__key").withColumns({"own": T.tokens("own"), "met": T.tokens("met"), "scores": F.map_from_entries("scores")})
    some = F.filter(F.transform(F.split("e", " "), lambda w: F.element_at("scores", w)), lambda x: x.isNotNull())
    gop = F.when(F.col("scores").isNotNull() & (F.size(some) > 0), F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))
    # Both sides' chunks are made once a text; what meets then is only forms of chunks. They are never empty: an inner explode
    # would say so by a filter, which Spark takes below the distinct texts, so that chunks were made for every row.
    full = form.where((F.size("own") > 0) & (F.size("met") > 0)).select("__key", "kind", "scores", _chunks(F.col("own"), "i", "k", "e").alias("__l"), _chunks(F.col("met"), "j", "l", "r").alias("__r"))
    left = full.select("__key", "kind", "scores", "__r", F.explode_outer("__l").alias("__c")).select("__key", "kind", "scores", "__r", "__c.*").withColumn("gop", gop).drop("scores")
    sizes = F.array(*[F.lit(10 * k + n) for k, n in SIZES])
    cells = left.withColumn("__c", F.explode_outer("__r")).drop("__r").select("*", "__c.*").drop("__c").where(F.array_contains(sizes, F.col("k") * 10 + F.col("l")))
    cells = _worth(cells)
    near = cells.where("worth")
    if learned is not None:
        pairs = learned.select(T.for_scoring("expected").alias("e"), T.for_scoring("raw").alias("r")).distinct()
        near = near.unionByName(cells.where("k = 1 and l = 1 and not worth").join(pairs, ["e", "r"], "left_semi").select(*near.columns))
    near = near.select("__key", "i", "j", *PAIR)
    priced = cost(score_chunks(near.select(*PAIR).distinct(), lexicon, learned)).select(*PAIR, "price")
    steps = _met(near, priced, PAIR).groupBy("__key").agg(F.collect_list(F.struct("i", "j", "k", "l", "price")).alias("steps"))
    walked = _met(form, steps, ["__key"], "left").withColumn("path", K.chunk_path(F.size("own"), F.size("met"), F.col("steps")))

    text = lambda words, at, size: F.array_join(F.slice(words, at + 1, size), " ")
    ops = walked.select("__key", "kind", "own", "met", "scores", F.posexplode("path").alias("nth", "p")).select("*", "p.*").drop("p")
    ops = ops.withColumns({"e": text("own", F.col("i"), F.col("k")), "r": text("met", F.col("j"), F.col("l")), "chunk": F.col("nth") + 1}).withColumn("gop", gop)
    meets = (F.col("k") > 0) & (F.col("l") > 0)
    kept = _met(ops, score_chunks(ops.where(meets).select(*PAIR).distinct(), lexicon, learned), PAIR, "left")
    k, n = F.col("k"), F.col("l")
    kept = kept.withColumns({
        "operation": F.when(n == 0, "deletion").when(k == 0, "insertion").when((k == 1) & (n == 1), "match").when(k == 1, "split_match").when(n == 1, "merge_match").otherwise("phrase_match"),
        "status": F.when(n == 0, "missing").when(k == 0, "inserted").otherwise(F.col("status")), "correct": F.coalesce("correct", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.0)),
    })
    words = F.when(k == 0, F.array(F.lit(None).cast("string"))).otherwise(F.slice("own", F.col("i") + 1, k))
    out = kept.join(given.select("__row", "__key"), "__key").select("*", F.posexplode(words).alias("within", "expected_word"))
    heard = F.when(k == n, F.get(F.slice("met", F.col("j") + 1, n), F.col("within"))).otherwise(F.col("r"))
    return out.select(
        *[F.col("__row").getField(c).alias(c) for c in key], "chunk", "within", "expected_word", heard.alias("recognized_word"), F.col("e").alias("expected_chunk"), F.col("r").alias("recognized_chunk"), "operation", "status", "correct",
        "confidence", "sub_strategy", "spelling", "boundary", "sound", F.round("gop", 6).alias("gop"), "skeleton", "vowels",
    )


def summary(words: DataFrame, key: list[str]) -> DataFrame:
    """Words by status, and expected words in all, for each text of an alignment."""
    count = lambda *names: F.sum(F.when(F.col("status").isin(*names), 1).otherwise(0)).cast("int")
    return words.groupBy(*key).agg(
        F.count("expected_word").cast("int").alias("expected_words"), count("exact_correct").alias("exact"), count("accepted_by_dynamic_expected_word_correction", "accepted_by_asr_spelling_variant").alias("corrected"),
        count("accepted_by_split_merge").alias("split_merge"), count("accepted_by_homophone").alias("homophone"), count("accepted_by_gop").alias("gop"), count("partial").alias("partial"),
        count("incorrect").alias("incorrect"), count("missing").alias("missing"), count("inserted").alias("inserted"),
    )


#: Statuses that repair a longer text.
REPAIRS = ("accepted_by_dynamic_expected_word_correction", "accepted_by_homophone", "accepted_by_phoneme_similarity", "accepted_by_gop", "accepted_by_asr_spelling_variant", "accepted_by_split_merge")


def correct_records(rows: DataFrame, key: list[str], lexicon: DataFrame | None = None, learned: DataFrame | None = None, contradicted: str | None = None, **columns: str) -> DataFrame:
    """(key, accepted, displayed, strategy, sub_strategy, confidence, need, homophone): one row per record, letters and words or longer texts.

    Short prompts are decided as words; a longer one is aligned, its words are repaired but what was heard is displayed.
    A record whose critical sound is contradicted is left alone. columns: as in ``correct_words``.
    """
    kind = F.col(columns["kind"]) if columns.get("kind") else F.lit(None).cast("string")
    e = T.for_scoring(columns.get("expected", "expected"))
    kinds = F.coalesce(kind, F.when(e == "", "unknown").when(e.rlike("^[a-z]$"), "letter").when(F.size(T.tokens(e)) == 1, "word").otherwise("sentence"))
    against = F.coalesce(F.col(contradicted), F.lit(False)) if contradicted else F.lit(False)
    form = rows.withColumns({"__kind": kinds, "__against": against})
    raw = F.col(columns.get("raw", "raw"))
    names = ["accepted", "displayed", "strategy", "sub_strategy", "confidence", "need", "homophone"]
    own = F.lit("dynamic_expected_word_correction")
    left = form.where("__against").select(*key, F.lit(False), raw, own, F.lit("skipped_critical_phoneme_contradiction"), F.lit(0.0), _by_kind(NEED, F.col("__kind")), F.lit(False)).toDF(*key, *names)
    go = form.where("not __against")
    word = correct_words(go.where(~F.col("__kind").isin(*LONG)), lexicon, learned, **{**columns, "kind": "__kind"})
    short = word.select(*key, "dynamic.accepted", F.col("corrected").alias("displayed"), "dynamic.strategy", "dynamic.sub_strategy", "dynamic.confidence", "dynamic.need", "dynamic.homophone")
    texts = go.where(F.col("__kind").isin(*LONG))
    aligned = align_chunks(texts, key, lexicon, learned, columns.get("expected", "expected"), columns.get("raw", "raw"), "__kind", columns.get("scores"))
    repaired = aligned.where(F.col("status").isin(*REPAIRS)).groupBy(*key).agg(
        F.max("confidence").alias("best"), F.max(F.col("status") == "accepted_by_split_merge").alias("merged"), F.max(F.col("status") == "accepted_by_homophone").alias("homophone"))
    met = _met(texts, repaired, key, "left")
    some = F.col("best").isNotNull()
    sub = F.when(F.col("merged"), "passage_aware_dynamic_alignment_repair").when(some, "word_alignment_dynamic_correction").otherwise("no_word_alignment_corrections")
    long = met.select(*key, some, raw, own, sub, F.coalesce("best", F.lit(0.0)), _by_kind(NEED, F.col("__kind")), F.coalesce("homophone", F.lit(False))).toDF(*key, *names)
    return short.unionByName(long).unionByName(left)
