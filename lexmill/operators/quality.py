"""Row validation with reason codes, summaries of tables, contracts between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that holds, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, holds in rules:
        out = out.when(holds, code)
    return out


def all_reasons(*rules: tuple[str, Column]) -> Column:
    """The codes of all rules that hold, in the rules' order."""
    return F.array_compact(F.array(*[F.when(holds, code) for code, holds in rules]))


def flags(*rules: tuple[str, Column]) -> Column:
    """Codes joined by bars, ok if there is none."""
    return F.coalesce(F.nullif(F.array_join(all_reasons(*rules), "|"), F.lit("")), F.lit("ok"))


def within(value: Column | str, least: float, most: float) -> Column:
    """Null passes, what is no number fails, else the limits are inclusive."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNull() | F.coalesce(T.number(c).between(least, most), F.lit(False))


def reason_counts(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    return rows.groupBy(F.coalesce(first_reason(*rules), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def error_counts(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    each = rows.select(F.explode(all_reasons(*rules)).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(col, value, n) for several columns in one pass; null counts as ''."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    long = rows.select(*texts).unpivot([], list(columns), "col", "value")
    return long.groupBy("col", "value").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, columns: list[str], low: float, medium: float) -> DataFrame:
    """(col, band, n): missing, low, medium or high for each of several score columns."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "col", "value")
    band = F.when(F.col("value").isNull(), "missing").when(F.col("value") < low, "low").when(F.col("value") < medium, "medium").otherwise("high")
    return long.groupBy("col", band.alias("band")).agg(F.count("*").alias("n"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def invalid_values(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Values outside a closed domain."""
    return rows.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(domain)).distinct()


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def coverage(rows: DataFrame, text: str, key: str) -> DataFrame:
    """One row: counts, blanks, non-blank keys that repeat, mean words."""
    filled = F.when(~T.blank(F.col(key).cast("string")), F.col(key))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(T.blank(text)).alias("blank_texts"),
        (F.count(filled) - F.count_distinct(filled)).alias("repeated_keys"), F.round(F.avg(T.word_count(text)), 6).alias("mean_words"),
    )


def decision(rates: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Each rate against (poor, good) limits, and the verdict: the worst of them."""
    for name, (poor, good) in limits.items():
        rates = rates.withColumn(f"{name}_state", F.when(F.col(name) > poor, "poor").when(F.col(name) > good, "fair").otherwise("good"))
    states = [F.col(f"{n}_state") for n in limits]
    some = lambda s: reduce(lambda a, b: a | b, [c == s for c in states])
    return rates.withColumn("verdict", F.when(some("poor"), "train").when(some("fair"), "review").otherwise("keep"))


def children(parents: DataFrame, rows: DataFrame, key: str, parent: str, seq: str) -> DataFrame:
    """(id, state) of every parent and orphaned key: children must exist, without repeats, numbered from 1 without a gap."""
    g = rows.groupBy(parent).agg(F.count("*").alias("__n"), F.count_distinct(seq).alias("__k"), F.min(seq).alias("__low"), F.max(seq).alias("__high"))
    met = parents.select(key).join(g, F.col(key) == F.col(parent), "full")
    state = (
        F.when(F.col(key).isNull(), "no_parent").when(F.col(parent).isNull(), "no_children").when(F.col("__n") != F.col("__k"), "repeated")
        .when((F.col("__low") != 1) | (F.col("__high") != F.col("__n")), "gap").otherwise("ok")
    )
    return met.select(F.coalesce(key, parent).alias("id"), state.alias("state"))


def rolled_up(rows: DataFrame, keys: list[str], size: str, text: str) -> DataFrame:
    """Counts, sizes and blanks by the keys, by each prefix of them, and over everything."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.count_if(T.blank(text)).alias("blank"))


def errors_and_warnings(rows: DataFrame, errors: list[tuple[str, Column]], warnings: list[tuple[str, Column]]) -> DataFrame:
    """Adds errors and warnings, each the codes that hold in their order, and valid: no error."""
    out = rows.withColumns({"errors": all_reasons(*errors), "warnings": all_reasons(*warnings)})
    return out.withColumn("valid", F.size("errors") == 0)


def usable(text: str, path: str, duration: str, least: float = 0.3, most: float = 30.0) -> Column:
    """Whether a row can be trained on: a text and a path, and a duration within the limits where there is one."""
    return ~T.blank(text) & ~T.blank(path) & within(duration, least, most)


def normalisation_audit(rows: DataFrame, key: str, text: str, form: Column, examples: int = 5) -> DataFrame:
    """One row: how many texts a normal form empties or changes, and the first examples of changes by key."""
    made = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), form.alias("form"))
    changed = F.coalesce(F.col("form") != F.col("text"), F.lit(False))
    counts = made.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("form"), F.lit("")) == "").alias("emptied"), F.count_if(changed).alias("changed"))
    first = made.where(changed).orderBy("key").limit(examples).agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return counts.crossJoin(first)  # one row each


def with_reference(rows: DataFrame, preferred: str, other: str) -> DataFrame:
    """Adds reference and reference_column: the preferred column if any row of the table fills it, else the other."""
    any_ = rows.agg(F.coalesce(F.bool_or(~T.blank(preferred)), F.lit(False)).alias("__any"))
    met = rows.crossJoin(any_)  # one row
    name = F.when(F.col("__any"), preferred).otherwise(other)
    return met.withColumns({"reference": F.when(F.col("__any"), F.col(preferred)).otherwise(F.col(other)), "reference_column": name}).drop("__any")


def split_summary(rows: DataFrame, split: str, audio: str, text: str, seconds: str) -> DataFrame:
    """By split, and over all (split null): rows, hours, rows without audio, rows without text. Unknown splits train."""
    known = F.when(F.col(split).isin("train", "validation", "test"), F.col(split)).otherwise("train")
    length = F.coalesce(T.number(seconds), F.lit(0.0))
    return rows.select(known.alias("split"), audio, text, length.alias("__s")).rollup("split").agg(
        F.count("*").alias("rows"), F.round(F.sum("__s") / 3600, 6).alias("hours"), F.count_if(T.blank(audio)).alias("missing_audio"), F.count_if(T.blank(text)).alias("blank_text")
    )


def missing_rate(rows: DataFrame, path: str, existing: DataFrame) -> DataFrame:
    """One row: the share of paths that no listed file has; existing: one column, path."""
    have = existing.select(F.col(existing.columns[0]).alias(path), F.lit(True).alias("__there")).distinct()
    met = rows.select(path).join(have, path, "left")
    return met.agg(F.count("*").alias("rows"), F.count_if(F.col("__there").isNull()).alias("missing"), F.coalesce(F.round(F.avg(F.col("__there").isNull().cast("int")), 6), F.lit(0.0)).alias("rate"))
