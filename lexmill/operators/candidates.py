"""Ranking of candidate items for learners by an additive score with reasons.

Candidates meet learners on a shared key (a level, a module), never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import kernels as K
from lexmill.functions import text as T

#: What each agreement adds, and what its absence takes.
WEIGHTS = {
    "focus": (4, 0), "skill": (3, 0), "phoneme": (2, 0), "position": (1, 0), "difficulty": (2, 0), "active": (3, -10), "review": (-5, 0), "fresh": (2, -4),
    "module": (1, 0), "activity": (1, 0), "mastery": (-3, 0),
}


def score(terms: dict[str, Column], weights: dict[str, tuple[int, int]] = WEIGHTS) -> Column:
    total = F.lit(0)
    for name, holds in terms.items():
        yes, no = weights[name]
        total = total + F.when(holds, yes).otherwise(no)
    return total


def with_defaults(items: DataFrame) -> DataFrame:
    """Items with what they leave open: active, without review, easy, and the skill as the focus."""
    have = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    return items.withColumns({
        "is_active": T.truthy(have("is_active", "string"), True), "needs_manual_review": T.truthy(have("needs_manual_review", "string"), False),
        "difficulty_level": F.coalesce(F.nullif(have("difficulty_level", "string"), F.lit("")), F.lit("easy")),
        "error_focus": F.coalesce(F.nullif(have("error_focus", "string"), F.lit("")), have("skill_signal", "string")),
    })


def reasons(terms: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in terms.items()]))


def leading(items: DataFrame, alike: list[str], item: str, top: int) -> DataFrame:
    """The first ``top`` items, by item, of each group that agrees in the columns ``alike``.

    Where the terms read nothing else of an item, all of a group score the same for any learner and ties go by item, so the
    rest can never be among a learner's top: learners meet groups, whose number their values bound, and not all items.
    """
    place = F.row_number().over(Window.partitionBy(*alike).orderBy(item))
    return items.withColumn("__nth", place).where(F.col("__nth") <= top).drop("__nth")


def recommended(learners: DataFrame, items: DataFrame, on: list[str], learner: str, item: str, terms: dict[str, Column], top: int, alike: list[str] | None = None) -> DataFrame:
    """The top items of each learner, highest score first, ties by item, with the reasons of those that are left.

    The join multiplies rows, so learners are spread over all tasks before it, however few files they come from. The
    rank's bound is applied before the next shuffle, and what only survivors need is made after it.

    alike: the learners' columns that the terms read, where these are few values. Learners that agree in them and in the
    shared key have the same top, which is found once for all of them; only these items meet the learners themselves.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), item))
    ranked = lambda rows, *by: rows.withColumn("place", first(*by)).where(F.col("place") <= top)
    if alike is None:
        met = K.spread(learners, learner).join(items, on).withColumn("score", score(terms))
        return ranked(met, learner).withColumn("reasons", reasons(terms))
    kinds = [*on, *alike]
    met = K.spread(learners.select(*kinds).distinct(), *kinds).join(K.spread(items), on).withColumn("score", score(terms))
    best = ranked(met, *kinds).withColumn("reasons", reasons(terms)).drop("place").withColumnsRenamed({c: f"__{c}" for c in kinds})
    own = learners.join(best, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in kinds]).drop(*[f"__{c}" for c in kinds])
    return ranked(own, learner)
