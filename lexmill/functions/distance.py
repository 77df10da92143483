"""Distances and similarities of texts and sequences as Column expressions over JVM lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import text as T


def _fold_table(a: Column, b: Column, first: Column, step: Callable[[Column, Column, Column, Column, Column], Column], head: Callable[[Column], Column]) -> Column:
    """The last row of a dynamic-programming table over arrays a (rows) and b (columns), kept a row at a time.

    step(row, left, j, x, y): the next cell of the row from the row above, the cell to the left and the elements.
    """

    def next_row(row: Column, x: Column) -> Column:
        start = F.array(head(row))
        grow = lambda acc, j: F.concat(acc, F.array(step(row, F.element_at(acc, -1), j, x, F.element_at(b, j))))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, grow)

    return F.aggregate(a, first, next_row)


#: Different tokens of a pair that single characters stand for; each is one of Latin-1 that chr() gives.
CODES = 250


def edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays. Each different token becomes a character, so that the JVM's own distance serves; arrays of
    more than CODES different tokens take a table."""
    known = F.array_distinct(F.concat(a, b))
    coded = lambda tokens: F.array_join(F.transform(tokens, lambda x: F.chr(F.array_position(known, x))), "")
    return F.when(F.size(known) <= CODES, F.levenshtein(coded(a), coded(b))).otherwise(_table_edits(a, b))


def _table_edits(a: Column, b: Column) -> Column:
    def step(row, left, j, x, y):
        return F.least(left + 1, F.element_at(row, j + 1) + 1, F.element_at(row, j) + F.when(x == y, 0).otherwise(1))

    last = _fold_table(a, b, F.sequence(F.lit(0), F.size(b)), step, lambda row: F.element_at(row, 1) + 1)
    return F.when(F.size(b) == 0, F.size(a)).when(F.size(a) == 0, F.size(b)).otherwise(F.element_at(last, -1))


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""

    def step(row, left, j, x, y):
        return F.when(x == y, F.element_at(row, j) + 1).otherwise(F.greatest(left, F.element_at(row, j + 1)))

    last = _fold_table(a, b, F.array_repeat(F.lit(0), F.size(b) + 1), step, lambda row: F.element_at(row, 1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(last, -1))


VOWELS = ("a", "e", "i", "o", "u", "y")


def lenient_edits(a: Column, b: Column, vowel_cost: float = 0.25) -> Column:
    """Levenshtein distance of letter arrays in which a vowel replaces another at ``vowel_cost``."""

    def step(row, left, j, x, y):
        cost = F.when(x == y, 0.0).when(x.isin(*VOWELS) & y.isin(*VOWELS), vowel_cost).otherwise(1.0)
        return F.least(left + 1, F.element_at(row, j + 1) + 1, F.element_at(row, j) + cost)

    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: i.cast("double"))
    last = _fold_table(a, b, first, step, lambda row: F.element_at(row, 1) + 1)
    return F.when(F.size(b) == 0, F.size(a).cast("double")).when(F.size(a) == 0, F.size(b).cast("double")).otherwise(F.element_at(last, -1))


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (m + n) of two texts; 1 if both are empty."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common(letters(a), letters(b)) / total)


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the elements of ``needle`` stand in ``hay`` in order."""
    found = F.aggregate(hay, F.lit(0), lambda p, x: p + F.when(F.get(needle, p) == x, 1).otherwise(0))
    return found == F.size(needle)


def percent(a: Column, b: Column) -> Column:
    """Similarity in percent of two plain texts: 100 if both are blank, 0 if one is."""
    longest = F.greatest(F.length(a), F.length(b))
    near = F.greatest(F.lit(0.0), (1 - F.levenshtein(a, b) / longest) * 100)
    return F.when((a == "") & (b == ""), 100.0).when((a == "") | (b == ""), 0.0).otherwise(F.round(near, 2))


def percent_class(a: Column, b: Column) -> Column:
    p = percent(a, b)
    return F.when((a == "") | (b == ""), "blank").when(a == b, "exact").when(p >= 90, "very_close").when(p >= 75, "close").when(p >= 50, "partial").otherwise("far")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Token edits by reference tokens, of scoring forms; a blank reference gives 0 against blank, else 1."""
    r, h = T.tokens(reference), T.tokens(hypothesis)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(edits(r, h) / F.size(r))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)


def error_category(reference: Column, hypothesis: Column, ratio: Column) -> Column:
    """How a hypothesis differs from its reference, of scoring forms: the first rule that holds. ratio: of matching blocks."""
    r, h = T.tokens(reference), T.tokens(hypothesis)
    differing = F.size(F.filter(F.zip_with(r, h, lambda x, y: x != y), lambda d: d))
    return (
        F.when(reference == "", "blank_reference")
        .when(hypothesis == "", "blank_hypothesis")
        .when(reference == hypothesis, "exact")
        .when((F.size(h) > F.size(r)) & is_subsequence(r, h), "insertion")
        .when((F.size(h) < F.size(r)) & is_subsequence(h, r), "deletion")
        .when((F.size(h) == F.size(r)) & (differing == 1), "substitution")
        .when(ratio >= 0.45, "partial_match")
        .otherwise("unrelated")
    )
