"""Joins and lookups: first match, missing keys, bands, wildcards, lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to the first right row of each key by order; row_status tells who found one."""
    packed = F.struct(*[c for c in right.columns if c != key])
    one = right.groupBy(key).agg(F.min_by(packed, order).alias("m"))
    met = left.join(one, key, "left")
    return met.select(*left.columns, "m.*", F.when(F.col("m").isNull(), "prompt_not_found").otherwise("ready").alias("row_status"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left that the right lacks; none if the right is empty."""
    gone = left.select(key).where(F.col(key).isNotNull()).distinct().join(right, key, "left_anti")
    return gone.join(right.select(F.lit(1).alias("__any")).limit(1), how="left_semi", on=F.lit(True))


#: Rules that are sent to every task; more of them are met by key.
RULES = 10_000


def _few(rules: DataFrame) -> bool:
    return rules.limit(RULES + 1).count() <= RULES


def band(rows: DataFrame, score: str, bands: DataFrame) -> DataFrame:
    """Adds the band whose inclusive limits hold the score; rows without one stay.

    Up to RULES bands go to every task. More are cut into steps of about a band's width, and rows meet them by their step,
    so the rows are never the side that is sent out.
    """
    if _few(bands):
        return rows.join(F.broadcast(bands), F.col(score).between(F.col("least"), F.col("most")), "left")
    wide = bands.agg(F.avg(F.col("most") - F.col("least"))).first()[0] or 0.0
    step = lambda c: F.floor(c / F.lit(wide if wide > 0 else 1.0))
    cut = bands.where("least <= most").withColumn("__step", F.explode(F.sequence(step(F.col("least")), step(F.col("most")))))
    met = rows.withColumn("__at", step(F.col(score))).join(cut, (F.col("__at") == F.col("__step")) & F.col(score).between(F.col("least"), F.col("most")), "left")
    return met.drop("__at", "__step")


def wildcard(rows: DataFrame, rules: DataFrame, exact: str, loose: str, any_: str = "ANY", key: str = "id") -> DataFrame:
    """The rule for (exact, loose), else the one for (exact, any). rules: exact, rule_<loose>, outcome. Up to RULES of them go to every task."""
    sent = F.broadcast if _few(rules) else lambda df: df
    specific = rules.select(exact, F.col(f"rule_{loose}").alias(loose), F.col("outcome").alias("own"))
    general = rules.where(F.col(f"rule_{loose}") == any_).select(exact, F.col("outcome").alias("fallback"))
    met = rows.join(sent(specific), [exact, loose], "left").join(sent(general), exact, "left")
    return met.withColumn("outcome", F.coalesce("own", "fallback")).drop("own", "fallback")


def pronounced(texts: DataFrame, words: str, lexicon: DataFrame, key: str) -> DataFrame:
    """(key, phones): the words' phones in order; a text with an unknown word has none. lexicon: word, phones."""
    each = texts.select(key, F.posexplode(words).alias("pos", "word"))
    met = each.join(lexicon, "word", "left")
    parts = met.groupBy(key).agg(F.count("*").alias("n"), F.count("phones").alias("known"), F.sort_array(F.collect_list(F.struct("pos", "phones"))).alias("parts"))
    phones = F.when(F.col("n") == F.col("known"), F.flatten(F.transform("parts", lambda p: p["phones"]))).otherwise(F.array().cast("array<string>"))
    return parts.select(key, phones.alias("phones"))


def last_rule(rules: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rules by composite key, the last writer wins."""
    packed = F.struct(*[c for c in rules.columns if c not in keys])
    return rules.groupBy(*keys).agg(F.max_by(packed, order).alias("x")).select(*keys, "x.*")


def ranked(rows: DataFrame, group: str, *order, top: int = 1) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= top)


def by_stem(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Inner join of files whose names agree but for folder and extension; the stem is kept."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    met = left.withColumn("stem", stem(left_path)).join(right.withColumn("stem", stem(right_path)), "stem")
    return met.where("stem <> ''")


def soft_filter(rows: DataFrame, group: str, wanted: Column) -> DataFrame:
    """Per group the rows that are wanted, or all of them where none is. The test is an aggregate that is joined back, so a hot group isn't sorted."""
    some = rows.groupBy(group).agg(F.max(F.coalesce(wanted, F.lit(False))).alias("some"))
    met = rows.withColumn("wanted", F.coalesce(wanted, F.lit(False))).join(some, group)
    return met.where("wanted or not some").drop("wanted", "some")


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """base with the columns it shares with top replaced where top has a value; top holds a key once."""
    shared = [c for c in base.columns if c in top.columns and c != key]
    met = base.join(top.select(key, *[F.col(c).alias(f"__{c}") for c in shared]), key, "left")
    return met.select(*[F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in base.columns])


def having(items: DataFrame, equal: dict[str, str], containing: dict[str, str]) -> DataFrame:
    """Items whose columns equal, and whose texts contain in any case, what is asked for."""
    for column, value in equal.items():
        items = items.where(F.col(column) == value)
    for column, part in containing.items():
        items = items.where(F.contains(F.lower(column), F.lower(F.lit(part))))
    return items


def by_text(asked: DataFrame, asked_text: str, items: DataFrame, text: str, key: str) -> DataFrame:
    """(form, the first item's columns) for every scoring form that is asked for and that an item has."""
    forms = asked.select(T.for_scoring(asked_text).alias("form")).distinct()
    first = items.withColumn("form", T.for_scoring(text)).groupBy("form").agg(F.min_by(F.struct(*items.columns), key).alias("x")).select("form", "x.*")
    return forms.join(first, "form")
