"""Rows by their place in the input: tables side by side, samples that keep the order. No window orders all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.sampling import draw

_WITHIN = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a part


def numbered(rows: DataFrame, place: str = "place") -> DataFrame:
    """Adds each row's place in the input, from 0. The input is read twice and must come in the same order: files, not a shuffle.

    A part's rows are counted first; what lies before a part is added to a row's number within it. The driver holds one
    number a part.
    """
    counts = rows.groupBy(F.spark_partition_id().alias("part")).count()
    found = sorted((r["part"], r["count"]) for r in counts.toLocalIterator())
    before, total = [], 0
    for part, n in found:
        before.append((part, total))
        total += n
    marked = rows.withColumn("__id", F.monotonically_increasing_id())
    starts = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    met = marked.join(F.broadcast(starts), F.shiftright("__id", 33) == F.col("__part"))
    return met.select(*rows.columns, (F.col("__before") + F.col("__id").bitwiseAND(F.lit(_WITHIN))).alias(place))


def side_by_side(left: DataFrame, right: DataFrame, place: str = "place") -> DataFrame:
    """The n-th row of one beside the n-th of the other, with its place; the shorter one's columns are null beyond its end."""
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"columns of both sides: {sorted(both)}")
    return numbered(left, place).join(numbered(right, place), place, "full")


def sampled_in_order(rows: DataFrame, n: int, seed: int, place: str = "place") -> DataFrame:
    """n rows without replacement, drawn by the seed and their places, in input order; all rows if there are no more."""
    spot = numbered(rows, place)
    return spot.withColumn("__d", draw(seed, place)).orderBy("__d", place).limit(n).drop("__d").orderBy(place)
