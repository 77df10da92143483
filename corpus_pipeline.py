"""A training corpus from raw documents in five stages, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents. The last
returns the packing: one row per piece of a document, with its sequence and its place there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import langid, mixing, packing, pii, simhash
from lexmill.llm.common import Cut, cut, table

#: Texts without a language, or whose best language has less than this mean probability, go. What rejects junk and other
#: languages is whether the text's trigrams are familiar (langid.familiar).
LEAST_SCORE = 0.26
#: The least share of the trigrams that a clean text is expected to have in common with the learned samples.
LEAST_MET = 0.75

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is in a language that the labels teach; null texts and texts without a letter go."""
    return langid.accept(docs, LEAST_SCORE, least_met=LEAST_MET)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that with the smallest id, null being the greatest.

    Rows are told apart by a key that is written first, so rows that share an id, or have none, are judged each by its own
    text, and an id stays as often as components choose one of its rows. Rows of one component and id are chosen by a hash
    of their values; only equal rows are left to the key.

    Near duplicates are those of op7's contract: fingerprints of three-word shingles that differ in two bits or fewer. One
    changed word turns three or four bits of a text of 200 words, so of near copies only those that differ little go. Texts
    meet the decision in one shuffle; everything before it works on fingerprints and keys.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*plain).alias("hash"), F.monotonically_increasing_id().alias("row"))
    keyed = cut(docs.withColumn("__order", order), "pipeline-rows")
    classes = simhash.near_duplicates(keyed, id_col="__order")
    stay = classes.where(F.col("__order") == F.col("component_id")).select(F.col("__order.row").alias("__stay"))
    return keyed.join(stay, F.col("__order.row") == F.col("__stay"), "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its personal data replaced by the kind in brackets and n_chars by the new length; null and empty texts stay."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; rows that are not taken go, as do those without a word."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in pieces of at most 1024 tokens; a null or empty text is one piece of the end id."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: SQL can't express the network, the pivots' chance or the tokenizer: the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = Cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = after.df, after
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # The packing has written its pieces; the documents are not read again.
    before.drop()
    return packed
