"""Expressions in steps. Each step is bound once, so that what uses it refers to it: an expression that is put in place of
every reference, as projections are when filters pass them, would grow with every step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Get = Callable[[str], Column]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(start: dict[str, Column], *steps: Callable[[Get], dict[str, Column]]) -> Column:
    """A struct of all named values: those at the start and what each step makes of the values so far; a later name replaces an earlier one."""
    names = list(start)
    value = F.struct(*[c.alias(n) for n, c in start.items()])
    for step in steps:
        value, names = _after(value, names, step)
    return value


def _after(value: Column, names: list[str], step: Callable[[Get], dict[str, Column]]) -> tuple[Column, list[str]]:
    made: list[str] = []

    def body(x: Column) -> Column:
        new = step(lambda n: x[n])
        made[:] = new
        return F.struct(*[x[n].alias(n) for n in names if n not in new], *[c.alias(n) for n, c in new.items()])

    return bound(value, body), [n for n in names if n not in made] + made
