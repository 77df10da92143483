"""Correction of what was heard against what was expected: an ordered cascade of rules over features computed once.

Rules are small tables joined by key; the decision is one expression, so the optimizer sees all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import phonemes as P
from lexmill.functions import text as T

#: How the letters' names are heard.
SPOKEN = {
    "a": ["a", "ay", "aye", "ai", "ey"],
    "b": ["b", "bee", "be", "bi", "by", "bii"],
    "c": ["c", "see", "sea", "si", "cy", "sii", "s"],
    "d": ["d", "dee", "de", "di", "dy", "dii"],
    "e": ["e", "ee", "i", "ii", "yi"],
    "f": ["f", "ef", "eff"],
    "g": ["g", "gee", "jee", "gi", "gy", "gii", "j"],
    "h": ["h", "aitch", "haitch", "age", "each"],
    "i": ["i", "eye", "ai", "ay"],
    "j": ["j", "jay", "jai", "jey"],
    "k": ["k", "kay", "kei", "key"],
    "l": ["l", "el", "ell", "elle"],
    "m": ["m", "em", "emm"],
    "n": ["n", "en", "enn"],
    "o": ["o", "oh", "owe"],
    "p": ["p", "pee", "pi", "py", "pii"],
    "q": ["q", "cue", "queue", "kyoo", "kyu"],
    "r": ["r", "are", "ar"],
    "s": ["s", "ess", "es"],
    "t": ["t", "tee", "tea", "ti", "ty", "tii"],
    "u": ["u", "you", "yu", "yoo"],
    "v": ["v", "vee", "vi", "vy", "vii"],
    "w": ["w", "doubleyou", "doubleu", "dubya"],
    "x": ["x", "ex", "axe", "eks"],
    "y": ["y", "why", "wai", "wy"],
    "z": ["z", "zee", "zed", "zi", "zii", "zih", "zy", "zey", "ze", "zhee", "they", "the", "see"],
}
#: Forms that are no names of a letter, but are heard for it; and the ends that sound as in "bee".
HEARD_AS = {"q": ["ku"]}
TAIL = "(?:ee|ii|ih|ey|e|i|y)$"
#: What is heard for a letter or word, by what was expected; and scores other than KNOWN.
CONFUSED = {
    "z": ["they", "the", "see", "c"], "c": ["see", "sea"], "d": ["they"], "g": ["gee", "jee"], "v": ["they"], "x": ["ex", "axe"], "y": ["why"], "u": ["you"], "q": ["cue", "queue"],
    "b": ["bee", "be"], "t": ["tea", "tee"], "ten": ["then"], "then": ["ten"], "thin": ["tin"], "tin": ["thin"], "red": ["read"], "read": ["red"], "tree": ["three"], "three": ["tree"],
    "to": ["two", "too"], "two": ["to", "too"], "too": ["to", "two"], "see": ["sea", "c"], "sea": ["see", "c"], "bee": ["be", "b"], "be": ["bee", "b"], "there": ["their", "theyre"],
    "their": ["there", "theyre"], "theyre": ["there", "their"], "they're": ["there", "their"], "right": ["write"], "write": ["right"], "hear": ["here"], "here": ["hear"],
    "one": ["won"], "won": ["one"], "four": ["for"], "for": ["four"], "ate": ["eight"], "eight": ["ate"], "sun": ["son"], "son": ["sun"], "blue": ["blew"], "blew": ["blue"],
    "i": ["eye"], "eye": ["i"], "you": ["u"], "why": ["y"],
}
CONFUSION_SCORES = {("d", "they"): 0.86, ("v", "they"): 0.86, ("z", "they"): 0.90, ("z", "the"): 0.86, ("z", "see"): 0.86, ("z", "c"): 0.85}
#: Words that tell nothing by their sound; one is never another.
FUNCTION_WORDS = ("a", "an", "the", "to", "of", "in", "on", "is", "it", "he", "she", "we")
#: The sound that tells a letter from its pair, and where it stands (0 first, -1 last).
CRITICAL = {"q": ("K", 0), "u": ("Y", 0), "c": ("S", 0), "z": ("Z", 0), "b": ("B", 0), "v": ("V", 0), "d": ("D", 0), "t": ("T", 0), "m": ("M", -1), "n": ("N", -1), "f": ("F", -1), "s": ("S", -1)}
#: Thresholds of acceptance.
WORD, STRICT_WORD, LETTER, CONFUSION, LATTICE, DOUBT, DOUBTFUL = 0.88, 0.90, 0.85, 0.82, 0.85, 0.50, 0.95
KNOWN = 0.95


def _lists(table: dict[str, list[str]], key: Column) -> Column:
    """The listed forms of a key, none for an unknown one."""
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    # One expression: a call for each literal would take longer than the query.
    m = F.expr("map(" + ", ".join(f"{quoted(k)}, array({', '.join(map(quoted, v))})" for k, v in table.items()) + ")")
    return F.coalesce(F.element_at(m, key), F.array().cast("array<string>"))


def _letter_code(compact: Column) -> Column:
    """A letter's name as it sounds: runs cut to two, the ends that sound alike written alike."""
    return F.regexp_replace(F.regexp_replace(compact, r"(.)\1{2,}", "$1$1"), TAIL, "#IY")


def lattice(letter: Column, compact: Column) -> Column:
    """How far what was heard may be a letter's name: 0.98 as one of its names, 0.93 as another listed form, 0.90 by an equal code, else likeness up to 0.80.

    The level for equal consonants with a similar vowel tail (0.88) is not apart: each onset that it allows with a tail
    is the code of a listed form already, so 0.90 decides first.
    """
    forms = F.concat(_lists(SPOKEN, letter), _lists(HEARD_AS, letter))
    nearest = F.array_max(F.transform(forms, lambda v: 1 - F.levenshtein(compact, v) / F.greatest(F.length(compact), F.length(v))))
    level = F.when(F.array_contains(_lists(SPOKEN, letter), compact), 0.98).when(F.array_contains(_lists(HEARD_AS, letter), compact), 0.93).when(F.array_contains(F.transform(forms, _letter_code), _letter_code(compact)), 0.90)
    return F.when(compact == "", 0.0).otherwise(F.coalesce(level, F.least(F.lit(0.80), nearest), F.lit(0.0)))


def features(rows: DataFrame) -> DataFrame:
    """expected, raw and, where there is one, observed (phones) as the features that the cascade reads."""
    if "observed" not in rows.columns:
        rows = rows.withColumn("observed", F.lit(None).cast("array<string>"))
    forms = rows.withColumns({"e": T.for_scoring("expected"), "r": T.for_scoring("raw")})
    e, r = F.col("e"), F.col("r")
    compact = F.regexp_replace(r, "[^a-z]", "")
    spot = F.create_map(*[F.lit(x) for k, (p, _) in CRITICAL.items() for x in (k, p)])
    place = F.create_map(*[F.lit(x) for k, (_, at) in CRITICAL.items() for x in (k, at)])
    heard = F.when(F.element_at(place, e) == 0, F.get("observed", F.lit(0))).otherwise(F.get("observed", F.size("observed") - 1))
    return forms.withColumns({
        "kind": T.prompt_kind("expected"),
        "exact": T.transcript("expected") == T.transcript("raw"),
        "alias": F.array_contains(_lists(SPOKEN, e), r) | F.array_contains(_lists(SPOKEN, e), compact),
        "lattice": lattice(e, compact),
        "confused": F.array_contains(_lists(CONFUSED, F.regexp_replace(e, "'", "")), F.regexp_replace(r, "'", "")),
        "critical": F.when(F.coalesce(F.size("observed"), F.lit(0)) > 0, heard == F.element_at(spot, e)),
        "sound": P.similarity(P.spelled(F.regexp_replace(e, "[^a-z]", "")), P.spelled(compact)),
        "heard": F.when(F.coalesce(F.size("observed"), F.lit(0)) > 0, P.similarity(P.spelled(F.regexp_replace(e, "[^a-z]", "")), F.col("observed"))),
    })


def corrected(rows: DataFrame, learned: DataFrame | None = None, confidence: str | None = None) -> DataFrame:
    """Adds strategy, accepted, score, threshold and corrected (the expected text if accepted, else what was heard).

    The first rule that applies decides: empty, exact, a critical sound that contradicts, a learned correction, texts
    beyond one word (left as they are), letter names, known confusions, likeness of sound. learned: expected, raw pairs in
    scoring form. Under a confidence of 0.5 likeness needs 0.95.
    """
    f = features(rows)
    if learned is not None:
        known = learned.select(F.col("expected").alias("e"), F.col("raw").alias("r"), F.lit(True).alias("learned")).distinct()
        f = f.join(known, ["e", "r"], "left").withColumn("learned", F.coalesce("learned", F.lit(False)))
    else:
        f = f.withColumn("learned", F.lit(False))
    letter, word = F.col("kind") == "letter", F.col("kind") == "word"
    need = F.when(letter, LETTER).when(F.left("e", F.lit(1)) != F.left("r", F.lit(1)), STRICT_WORD).otherwise(WORD)
    if confidence:
        need = F.when(F.col(confidence) < DOUBT, DOUBTFUL).otherwise(need)
    best = F.greatest(F.col("sound"), F.coalesce("heard", F.lit(0.0)))
    strategy = (
        F.when(F.col("e") == "", "none")
        .when(F.col("exact"), "exact")
        .when(~F.col("critical"), "critical_sound")
        .when(F.col("learned"), "learned")
        .when(~(letter | word), "left_as_heard")
        .when(letter & F.col("alias"), "letter_name")
        .when(F.col("confused"), "known_confusion")
        .when(letter & (F.col("lattice") >= LATTICE), "letter_lattice")
        .when((F.col("r") != "") & (best >= need), "sound")
        .otherwise("rejected")
    )
    s = F.col("strategy")
    told = F.create_map(*[F.lit(x) for (e, r), v in CONFUSION_SCORES.items() for x in (f"{e} {r}", v)])
    score = F.when(s.isin("exact", "learned", "letter_name"), 1.0).when(s == "known_confusion", F.coalesce(F.element_at(told, F.concat_ws(" ", "e", "r")), F.lit(KNOWN))).when(s == "critical_sound", F.least(best, F.lit(0.6))).when(s == "letter_lattice", F.col("lattice")).otherwise(best)
    threshold = F.when(s.isin("none", "left_as_heard"), 0.0).when(s == "known_confusion", F.when(letter, LETTER).otherwise(CONFUSION)).otherwise(need)
    accepted = s.isin("exact", "learned", "letter_name", "known_confusion", "letter_lattice", "sound")
    out = f.withColumn("strategy", strategy).withColumns({"accepted": accepted, "score": F.round(score, 6), "threshold": threshold})
    return out.withColumn("corrected", F.when(F.col("accepted"), F.col("expected")).otherwise(F.col("raw")))


def spelling_variant(expected: Column, raw: Column) -> Column:
    """How far a word may be a spelling of how the expected one sounds: consonants in order, vowels free."""
    a, b = T.skeleton(expected), T.skeleton(raw)
    x, y = D.letters(T.strict(expected)), D.letters(T.strict(raw))
    longest = F.greatest(F.size(x), F.size(y), F.lit(1))
    bones = F.when((a == "") & (b == ""), 1.0).otherwise(D.indel_ratio(a, b))
    return F.round((bones + (1 - D.lenient_edits(x, y) / longest)) / 2, 6)


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Mean of the evidence there is, weights renormalised over what is not null."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts.values()), F.lit(0.0))
    value = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in parts.values()), F.lit(0.0))
    return F.when(total > 0, F.round(value / total, 6)).otherwise(0.0)


def unsafe_pair(expected: Column, raw: Column) -> Column:
    """Two different function words, of scoring forms."""
    return (expected != raw) & expected.isin(*FUNCTION_WORDS) & raw.isin(*FUNCTION_WORDS)


def letter_code(token: Column) -> Column:
    """A letter's name as it sounds: onset and ``#IY`` for the ends that sound as in "bee"; runs are cut to two."""
    return _letter_code(F.regexp_replace(F.lower(token), "[^a-z]", ""))


def composite(text: Column, sound: Column, lattice: Column, exact: Column, alias: Column, confused: Column, critical: Column) -> Column:
    """The best of the scores, raised by what is known for certain; a critical sound adds 0.05, its absence holds at 0.60."""
    best = F.greatest(text, sound, lattice)
    raised = F.greatest(best, F.when(exact, 1.0).otherwise(0.0), F.when(alias, 0.98).otherwise(0.0), F.when(lattice >= LATTICE, 0.93).otherwise(0.0), F.when(confused, 0.90).otherwise(0.0))
    return F.round(F.when(critical, F.least(F.lit(1.0), F.greatest(raised, F.lit(0.90)) + 0.05)).when(~critical, F.least(raised, F.lit(0.60))).otherwise(raised), 6)


def support(expected: Column, raw: Column) -> Column:
    """How far the transcript alone supports the expected text: one less the character error rate, of scoring forms."""
    rate = F.when((expected == "") | (raw == ""), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - D.character_error_rate(expected, raw)))
    return F.when((expected == "") & (raw == ""), 1.0).otherwise(F.round(rate, 6))


#: How letters' names and words are heard where a comparison of models may correct; what it may never take.
PLAIN_NAMES = {
    "a": ["a", "ay", "aye"], "b": ["b", "be", "bee"], "c": ["c", "see", "sea"], "d": ["d", "dee"], "e": ["e", "ee"], "f": ["f", "ef", "eff"], "g": ["g", "gee", "jee"],
    "h": ["h", "aitch", "haitch"], "i": ["i", "eye"], "j": ["j", "jay"], "k": ["k", "kay"], "l": ["l", "el", "ell", "elle"], "m": ["m", "em", "emm"], "n": ["n", "en", "enn"],
    "o": ["o", "oh", "owe"], "p": ["p", "pee"], "q": ["q", "cue", "queue", "kyu", "kyoo"], "r": ["r", "are", "ar"], "s": ["s", "ess", "es"], "t": ["t", "tee", "tea"],
    "u": ["u", "you", "yu", "yoo"], "v": ["v", "vee"], "w": ["w", "doubleyou", "doubleu", "dubya"], "x": ["x", "ex", "axe", "eks"], "y": ["y", "why"],
    "z": ["z", "zee", "zed", "zi", "zii", "zih", "zy", "zey", "ze"],
}
PLAIN_CONFUSED = {
    "ten": ["then"], "red": ["read"], "read": ["red"], "tree": ["three"], "three": ["tree"], "see": ["sea", "c"], "sea": ["see", "c"], "right": ["write"], "write": ["right"],
    "hear": ["here"], "here": ["hear"], "be": ["bee", "b"], "bee": ["be", "b"],
}
AMBIGUOUS = {"q": ["you", "u", "yoo", "yu"]}


def plainly(expected: Column, raw: Column, kind: Column, sounds: bool = False) -> Column:
    """struct(accepted, reason, corrected) for a comparison of models, of evaluation forms: names and listed confusions only.

    Names that are heard for another letter as well are rejected unless sounds were looked at.
    """
    compact = F.regexp_replace(raw, "[ -]", "")
    one = lambda c: F.size(T.tokens(c)) == 1
    letter = F.when(F.array_contains(_lists(AMBIGUOUS, expected), compact) & F.lit(not sounds), "transcript_only_rejected_ambiguous_letter_alias").when(
        F.array_contains(_lists(PLAIN_NAMES, expected), compact), "expected_centric_letter_alias_match").otherwise("no_letter_alias_match")
    word = F.when(one(expected) & one(raw) & F.array_contains(_lists(PLAIN_CONFUSED, expected), raw), "expected_centric_known_word_confusion").otherwise("no_safe_word_correction")
    reason = (
        F.when(expected == "", "empty_expected_text").when(raw == "", "empty_raw_transcript").when(expected == raw, "exact_match_after_normalization")
        .when(kind == "letter", letter).when(kind == "word", word).otherwise("sentence_correction_not_applied")
    )
    accepted = reason.isin("exact_match_after_normalization", "expected_centric_letter_alias_match", "expected_centric_known_word_confusion")
    return F.struct(accepted.alias("accepted"), reason.alias("reason"), F.when(accepted, expected).otherwise(raw).alias("corrected"))


def ladder(
    expected: Column, raw: Column, final: Column, need: Column | float, spelling: Column, sound: Column, acoustic: Column, context: Column, confusion: Column, homophone: Column,
    least_acoustic: float = 0.75, least_sound: float = 0.90,
) -> Column:
    """struct(accepted, reason): which evidence decides about a word; the first rung that holds.

    sound and acoustic are null where there is no such evidence; final is the weighted score, need its threshold.
    """
    near, placed = (F.coalesce(sound, F.lit(0.0)) >= 0.70) | (spelling >= 0.50), context >= 0.95
    clear = F.coalesce(acoustic >= least_acoustic, F.lit(False))
    some = sound.isNotNull() | acoustic.isNotNull()
    reason = (
        F.when(unsafe_pair(expected, raw), "rejected_short_function_word_safety").when(homophone & placed, "homophone_match")
        .when((confusion >= 0.90) & placed & (near | (F.coalesce(acoustic, F.lit(0.0)) >= 0.75)), "known_asr_confusion_match").when(clear & placed & near, "gop_supported_expected_match")
        .when(F.coalesce(sound >= least_sound, F.lit(False)) & (final >= need), "phoneme_expected_match").when((spelling >= 0.90) & placed, "spelling_context_expected_match")
        .when(~some & (spelling < 0.90), "rejected_no_acoustic_evidence").when(some & (final >= need), "spelling_phoneme_expected_match").otherwise("rejected_low_similarity")
    )
    return F.struct((~reason.startswith("rejected")).alias("accepted"), reason.alias("reason"))
