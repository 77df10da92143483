"""Answers against what was expected: match, closeness, kind of error, and the whole analysis of a reading.

Rows hold expected and actual texts, and where there are any, accepted answers as an array. Null and blank are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import kernels
from lexmill.functions import phonemes as P
from lexmill.functions import text as T
from lexmill.operators import remediation as R

#: Least character similarity of each label, and that of texts of up to three letters.
LABELS = (("very_close", 0.80), ("close", 0.60), ("somewhat_close", 0.40))
SHORT, SHORT_CLOSE = 3, 0.66
#: Where in a word an error of sound stands.
PLACES = {"initial_sound_error": "initial", "final_sound_error": "final", "vowel_error": "medial"}


def closeness(e: Column, a: Column) -> Column:
    """Character similarity of scoring forms: 1 if both are blank, 0 if one is."""
    return F.when((e == "") & (a == ""), 1.0).when((e == "") | (a == ""), 0.0).otherwise(F.round(2.0 * kernels.common_letters(e, a) / (F.length(e) + F.length(a)), 6))


def label(e: Column, a: Column, near: Column) -> Column:
    out = F.when(a == "", "blank").when((e == a) | (near == 1), "exact")
    out = out.when((F.greatest(F.length(e), F.length(a)) <= SHORT) & (near >= SHORT_CLOSE), LABELS[0][0])
    for name, least in LABELS:
        out = out.when(near >= least, name)
    return out.otherwise("far")


def matched(rows: DataFrame, accepted: str | None = None) -> DataFrame:
    """Adds the scoring forms e and a, and exact, accepted, correct, closeness and label."""
    forms = kernels.spread(rows).withColumns({"e": T.for_scoring("expected"), "a": T.for_scoring("actual")})
    e, a = F.col("e"), F.col("a")
    listed = F.coalesce(F.exists(accepted, lambda x: T.for_scoring(x) == a), F.lit(False)) if accepted else F.lit(False)
    out = forms.withColumns({"exact": e == a, "listed": listed, "closeness": closeness(e, a)})
    return out.withColumns({"correct": F.col("exact") | F.col("listed"), "label": label(e, a, F.col("closeness"))})


def sentence_error(e: Column, a: Column) -> Column:
    """How a sentence's words differ, from token arrays: the first rule that holds, else null."""
    return (
        F.when(F.size(a) <= F.greatest(F.lit(1), F.floor(F.size(e) / 2)), "partial_sentence")
        .when((F.array_sort(e) == F.array_sort(a)) & (e != a), "word_order_error")
        .when(F.exists(e, lambda x: ~F.array_contains(a, x)), "skipped_word")
        .when(F.size(a) > F.size(e), "insertion")
    )


def sound_error(e: Column, a: Column, c: Column) -> Column:
    """How a word's phones differ, from phone arrays and their comparison: the first rule that holds, else null."""
    wrong = lambda side: F.coalesce(~c[side], F.lit(False))
    first, last, vowel = wrong("initial"), wrong("final"), wrong("vowel")
    return F.when(
        (F.size(e) > 0) & (F.size(a) > 0),
        F.when(first & ~last & ~vowel, "initial_sound_error").when(last & ~first & ~vowel, "final_sound_error").when(vowel & ~first & ~last, "vowel_error")
        .when(F.size(a) < F.size(e), "omission").when(F.size(a) > F.size(e), "insertion").when(c["similarity"] >= 0.5, "consonant_error"),
    )


def analysed(rows: DataFrame, accepted: str | None = None) -> DataFrame:
    """``matched`` with phones, their comparison, error kind and place, the focus of practice, and feedback, in one projection."""
    m = matched(rows, accepted)
    words = {"et": T.tokens("e"), "at": T.tokens("a")}
    phones = {f"{x}_phones": P.spelled(F.regexp_replace(x, "[^a-z]", "")) for x in ("e", "a")}
    m = m.withColumns(words | phones).withColumn("c", P.compared(F.col("e_phones"), F.col("a_phones")))
    single = (F.size("et") == 1) & (F.size("at") == 1)
    of_word = F.coalesce(sound_error(F.col("e_phones"), F.col("a_phones"), F.col("c")), F.when(F.col("label").isin("very_close", "close"), "substitution"))
    of_text = F.when(F.col("label") == "very_close", "very_close_text_error").when(F.col("label") == "far", "far_answer").otherwise("incorrect_general")
    kind = (
        F.when(F.col("a") == "", "blank").when(F.col("exact"), "correct").when(F.col("listed"), "accepted_variant")
        .otherwise(F.coalesce(F.when(single, of_word), F.when(F.size("et") > 1, sentence_error(F.col("et"), F.col("at"))), of_text))
    )
    out = m.withColumn("error", kind).withColumns({
        "place": F.element_at(F.create_map(*[F.lit(x) for p in PLACES.items() for x in p]), F.col("error")),
        "focus": R.focus(F.col("error"))["primary_focus"], "feedback": P.feedback(F.col("error")),
    })
    return out.drop("et", "at")


def token_scores(rows: DataFrame) -> DataFrame:
    """Adds token_similarity (twice the matching blocks over both lengths) and token_accuracy (over the expected words)."""
    both = rows.withColumns({"et": T.tokens(T.for_scoring("expected")), "at": T.tokens(T.for_scoring("actual"))})
    hits = both.withColumn("hits", kernels.block_matches("et", "at"))
    n, m = F.size("et"), F.size("at")
    share = lambda top, bottom: F.round(top / bottom, 6)
    return hits.withColumns({
        "token_similarity": F.when(n + m == 0, 1.0).otherwise(share(2 * F.col("hits"), n + m)),
        "token_accuracy": F.when(n == 0, F.when(m == 0, 1.0).otherwise(0.0)).otherwise(share(F.col("hits"), n)),
    }).drop("et", "at", "hits")
