"""Evaluation of (reference, hypothesis) pairs: per row, by group, over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import kernels
from lexmill.functions import text as T

#: The phones that are vowels.
VOWEL_SOUNDS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")


def scored(pairs: DataFrame, reference: str = "ref", hypothesis: str = "hyp") -> DataFrame:
    """Adds the scoring forms r and h, wer, cer, exact and similarity of each pair."""
    forms = pairs.withColumns({"r": T.for_scoring(reference), "h": T.for_scoring(hypothesis)})
    r, h = F.col("r"), F.col("h")
    return forms.withColumns({
        "wer": D.word_error_rate(r, h), "cer": D.character_error_rate(r, h), "exact": r == h,
        "percent": D.percent(r, h), "class": D.percent_class(r, h),
    })


def categorised(pairs: DataFrame, key: str) -> DataFrame:
    """``scored`` with category and ratio, that of the matching blocks of the scoring forms; key tells pairs apart."""
    rows = scored(pairs)
    found = kernels.over(rows.where("r <> '' and h <> ''"), key, kernels.block_ratio, "r", "h").withColumnRenamed("parts", "ratio")
    return rows.join(found, key, "left").withColumn("category", D.error_category(F.col("r"), F.col("h"), F.col("ratio")))


def macro_columns() -> list[Column]:
    """Means over pairs with a reference; pairs without one are counted and left out, blank hypotheses stay in."""
    real = F.col("r") != ""
    mean = lambda c: F.round(F.avg(F.when(real, F.col(c).cast("double"))), 6)
    return [
        F.count_if(real).alias("evaluated"), F.count_if(~real).alias("blank_reference"), F.count_if(F.col("h") == "").alias("blank_hypothesis"),
        mean("wer").alias("wer"), mean("cer").alias("cer"), mean("exact").alias("exact_rate"),
    ]


def macro(pairs: DataFrame, *by: str) -> DataFrame:
    """Macro means, over everything or by group; null groups are kept."""
    return scored(pairs).groupBy(*by).agg(*macro_columns())


def token_accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    """Mean share of a reference's tokens that lie in blocks which the hypothesis has too; blank references are left out.

    Equal pairs of a group are counted first, and met by the kernel once.
    """
    forms = pairs.select(*by, T.for_scoring("ref").alias("__r"), T.for_scoring("hyp").alias("__h")).where("__r <> ''")
    once = forms.groupBy(*by, "__r", "__h").agg(F.count("*").alias("__n"))
    apart = once.select(*by, "__n", F.size(T.tokens("__r")).alias("__m"), T.tokens("__r").alias("__a"), T.tokens("__h").alias("__b"))
    met = kernels.beside(apart, kernels.block_matches, "__same", "__a", "__b")
    share = F.sum(F.col("__n") * F.col("__same") / F.col("__m")) / F.sum("__n")
    return met.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("evaluated"), F.coalesce(F.round(share, 6), F.lit(0.0)).alias("token_accuracy"))


def ranking(rates: DataFrame, name: str, *errors: str) -> DataFrame:
    """Adds place, from 1, by the errors in turn, then the name: one small row a model. A null error goes last."""
    keys = [F.col(e).asc_nulls_last() for e in errors]
    return rates.withColumn("place", F.row_number().over(Window.orderBy(*keys, name)))


def micro(pairs: DataFrame, *by: str) -> DataFrame:
    """Corpus rates: edits over reference lengths, summed before they are divided. Sums combine before the shuffle."""
    s = scored(pairs).where("r <> ''").withColumns({"edits": D.edits(T.tokens("r"), T.tokens("h")), "n": F.size(T.tokens("r")), "letters": F.levenshtein("r", "h"), "m": F.length("r")})
    rate = lambda a, b: F.round(F.sum(a) / F.sum(b), 6)
    return s.groupBy(*by).agg(F.sum("edits").alias("word_edits"), F.sum("n").alias("words"), rate("edits", "n").alias("wer"), rate("letters", "m").alias("cer"))


def report(pairs: DataFrame, *keys: str) -> DataFrame:
    """One pass for the whole and for each key alone: grouping sets. A missing key counts as unknown."""
    named = scored(pairs)
    for k in keys:
        named = named.withColumn(k, F.when(T.blank(k), "unknown").otherwise(F.col(k)))
    sets = [[], *[[F.col(k)] for k in keys]]
    return named.groupingSets(sets, *[F.col(k) for k in keys]).agg(*macro_columns())


def short_words(pairs: DataFrame) -> DataFrame:
    """Single words of up to five letters: exact, blank and near-match rates and the mean character error rate."""
    s = scored(pairs).where(F.col("r").rlike("^[a-z0-9']{1,5}$"))
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("int")), 6), F.lit(0.0))
    return s.agg(
        F.count("*").alias("rows"), rate(F.col("exact")).alias("exact_rate"), rate(F.col("h") == "").alias("blank_rate"),
        rate((F.col("cer") <= 0.4) & ~F.col("exact")).alias("near_rate"), F.coalesce(F.round(F.avg("cer"), 6), F.lit(0.0)).alias("cer"),
    )


#: The short words that are watched unless others are named.
KEYWORDS = ("cat", "dog", "sun", "pen", "map", "cup", "hat", "pig", "run", "box")


def cvc_words(pairs: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``short_words`` of words of three letters that sound consonant, vowel, consonant.

    lexicon: word, variant, phones. A word's first pronunciation decides where there is one, its letters where there is none.
    """
    named = pairs.withColumn("__w", T.for_scoring("ref")).where(F.col("__w").rlike("^[a-z]{3}$"))
    by_letters = F.col("__w").rlike("^[^aeiou][aeiou][^aeiou]$")
    if lexicon is None:
        return short_words(named.where(by_letters).drop("__w"))
    first = lexicon.groupBy(F.col("word").alias("__w")).agg(F.min_by("phones", "variant").alias("__p"))
    kinds = F.transform("__p", lambda p: F.when(F.regexp_replace(p, "[0-9]", "").isin(*VOWEL_SOUNDS), "V").otherwise("C"))
    by_sound = F.when(F.size("__p") > 0, F.array_join(kinds, "") == "CVC")
    return short_words(named.join(first, "__w", "left").where(F.coalesce(by_sound, by_letters)).drop("__w", "__p"))


def keywords(pairs: DataFrame, words: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """``short_words`` of references that are one of the words in scoring form."""
    spark = pairs.sparkSession
    watched = spark.createDataFrame([(w,) for w in words], "w string").select(T.for_scoring("w").alias("__w")).distinct()
    return short_words(pairs.join(F.broadcast(watched), T.for_scoring("ref") == F.col("__w"), "left_semi"))


def confusions(pairs: DataFrame, n: int = 25) -> DataFrame:
    """The most frequent differing pairs of scoring forms; ties by reference, then hypothesis."""
    s = pairs.select(T.for_scoring("ref").alias("r"), T.for_scoring("hyp").alias("h")).where("r <> h and r <> ''")
    return s.groupBy("r", "h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r", "h").limit(n)


def substitutions(pairs: DataFrame, n: int = 25) -> DataFrame:
    """Differing tokens at equal places of pairs with as many tokens on both sides."""
    s = pairs.select(T.tokens(T.for_scoring("ref")).alias("r"), T.tokens(T.for_scoring("hyp")).alias("h")).where(F.size("r") == F.size("h"))
    at = s.select(F.inline(F.arrays_zip("r", "h"))).where("r <> h")
    return at.groupBy("r", "h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r", "h").limit(n)


BUCKETS = ("1", "2-5", "6+")


def by_length(pairs: DataFrame) -> DataFrame:
    """Exact rate by reference length; texts without a word fall in the middle bucket, empty buckets appear."""
    n = F.size(T.tokens("r"))
    s = scored(pairs).withColumn("bucket", F.when(n == 1, BUCKETS[0]).when(n <= 5, BUCKETS[1]).otherwise(BUCKETS[2]))
    got = s.groupBy("bucket").agg(F.count("*").alias("rows"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"))
    names = pairs.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return F.broadcast(names).join(got, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("exact_rate", F.lit(0.0)).alias("exact_rate"))


def winners(rows: DataFrame, a: str, b: str, lower_is_better: bool = True) -> Column:
    """Which of two scores wins, within 1e-12 a tie."""
    gap = F.col(a) - F.col(b) if lower_is_better else F.col(b) - F.col(a)
    return F.when(F.abs(gap) < 1e-12, "tie").when(gap < 0, a).otherwise(b)


def routing(rates: DataFrame, kind: str, a: str, b: str, kinds: tuple[str, str, str]) -> DataFrame:
    """One row: which of two models should take letters, words and sentences (``kinds``), by the rates of each kind."""
    won = rates.withColumn("x", F.when(F.abs(F.col(a) - F.col(b)) < 1e-12, "tie").when(F.col(a) < F.col(b), "a").otherwise("b"))
    of = lambda k: F.max(F.when(F.col(kind) == k, F.col("x")))
    one = won.agg(*[of(k).alias(n) for k, n in zip(kinds, ("letter", "word", "sentence"), strict=True)])
    short = (F.col("letter") == "a") & (F.col("word") == "a")
    return one.select(
        F.when(short & (F.col("sentence") == "b"), "short_a_long_b").when(short & (F.col("sentence") == "a"), "all_a").when(F.col("sentence") == "b", "long_b").otherwise("mixed").alias("routing")
    )


def deltas(rows: DataFrame, by: str, mode: str, rate: str, before: str, after: str) -> DataFrame:
    """(by, delta): how many percentage points a mean rate moves from one mode to another, in one aggregation."""
    mean = lambda m: F.avg(F.when(F.col(mode) == m, F.col(rate)))
    return rows.groupBy(by).agg(F.round(100 * (mean(after) - mean(before)), 6).alias("delta"))


def comparable(results: DataFrame, model: str, split: str, key: str) -> DataFrame:
    """One row: models, and whether they may be compared: all have the same splits with as many rows of each."""
    per = results.groupBy(model, split).agg(F.count(key).alias("n"))
    shape = per.groupBy(model).agg(F.sort_array(F.collect_list(F.struct(F.col(split), F.col("n")))).alias("shape"))
    return shape.agg(F.count("*").alias("models"), (F.count_distinct("shape") <= 1).alias("aligned"))


def disagreements(rows: DataFrame, winner: str, *errors: str) -> DataFrame:
    """Rows worth a look: a model failed, or one of them won."""
    failed = F.lit(False)
    for e in errors:
        failed = failed | ~T.blank(e)
    return rows.where(failed | ~F.col(winner).eqNullSafe("tie"))
