"""Queries: words and longer texts corrected with evidence made on the way, chunk alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import dynamic as Y
from lexmill.plans.common import Registry, table

R = Registry()


def readings(spark, d) -> DataFrame:
    """(id, expected, raw): the names of two parts in a row, and as they may be heard: vowels mistaken, words run together, split or cut short."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    after = part.select((F.col("id") - 1).alias("id"), F.col("name").alias("other"))
    own = F.concat_ws(" ", "name", "other")
    raw = own
    for heard, instead in (("ea", "ee"), (" b", "b"), ("iz", "i z"), ("ll", "l"), ("dg", "g"), ("hot ", "")):
        raw = F.replace(raw, F.lit(heard), F.lit(instead))
    return part.join(after, "id").select("id", own.alias("expected"), raw.alias("raw"))


def lexicon(spark, d) -> DataFrame:
    """(word, variant, phones): the consonants of each word of the parts' names stand for its sounds."""
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    bones = F.regexp_replace(F.upper("word"), "[AEIOUY]", "")
    return words.where(F.length(bones) > 0).select("word", F.lit(1).alias("variant"), F.filter(F.split(bones, ""), lambda x: x != "").alias("phones"))


@R.add()
def align_chunks(spark, d):
    out = Y.align_chunks(readings(spark, d), ["id"], lexicon(spark, d))
    return out.select("id", "chunk", "within", "expected_word", "recognized_word", "operation", "status", "correct", "confidence")


@R.add()
def align_chunk_summary(spark, d):
    return Y.summary(Y.align_chunks(readings(spark, d), ["id"], lexicon(spark, d)), ["id"])


def prompts(spark, d) -> DataFrame:
    """(id, expected, raw, kind, gop, bad): a part's first word, or its name, against the next part's, or its own with a vowel mistaken or an end lost."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), "p_size", "p_brand")
    after = part.select((F.col("id") - 1).alias("id"), F.col("name").alias("other"))
    both = part.join(after, "id")
    first = lambda c: F.get(F.split(c, " "), F.lit(0))
    whole = F.col("p_size") % 5 == 0
    own = F.when(whole, F.col("name")).otherwise(first("name"))
    bent = F.translate(own, "aeo", "eai")
    raw = F.when(F.col("p_size") % 4 == 0, own).when(F.col("p_size") % 4 == 1, bent).when(F.col("p_size") % 4 == 2, F.substr(own, F.lit(1), F.length(own) - 1)).otherwise(F.when(whole, F.col("other")).otherwise(first("other")))
    return both.select("id", own.alias("expected"), raw.alias("raw"), F.when(whole, "sentence").otherwise("word").alias("kind"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 50).alias("gop"), (F.col("p_size") == 7).alias("bad"))


@R.add()
def correct_dynamic(spark, d):
    out = Y.correct_words(prompts(spark, d), lexicon(spark, d), kind="kind", gop="gop", bad_audio="bad")
    return out.select("id", "expected", "raw", "corrected", "dynamic.accepted", "dynamic.strategy", "dynamic.sub_strategy", "dynamic.confidence", F.array_join("dynamic.fragments", "|").alias("fragments"))


@R.add()
def correct_records(spark, d):
    return Y.correct_records(prompts(spark, d), ["id"], lexicon(spark, d), kind="kind", gop="gop", bad_audio="bad")
