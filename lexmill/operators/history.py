"""Ordered attempts of learners: streaks, recent frames, focus, difficulty. Columns: learner, at, seq, correct, skill.

correct is true, false or null (not assessed). The order is (at, seq). Recent frames rank rows by a window with a bound on
its rank, which Spark applies before the shuffle; streaks compare with the last break, an aggregate; gaps and runs are found
within parts of the time and joined at their edges. So a learner with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

LEVELS = ("easy", "medium", "hard")


def streaks(attempts: DataFrame) -> DataFrame:
    """(learner, correct_streak, wrong_streak): rows after the last one that is not true, or not false; null breaks both."""
    at = F.struct("at", "seq")
    right, wrong = F.col("correct").eqNullSafe(F.lit(True)), F.col("correct").eqNullSafe(F.lit(False))
    breaks = attempts.groupBy("learner").agg(F.max(F.when(~right, at)).alias("not_right"), F.max(F.when(~wrong, at)).alias("not_wrong"))
    after = lambda c: F.count_if(F.col(c).isNull() | (at > F.col(c)))
    return attempts.join(breaks, "learner").groupBy("learner").agg(after("not_right").alias("correct_streak"), after("not_wrong").alias("wrong_streak"))


def recent(attempts: DataFrame, n: int) -> DataFrame:
    """The last n rows of each learner, numbered from the latest in column rn."""
    w = Window.partitionBy("learner").orderBy(F.desc("at"), F.desc("seq"))
    return attempts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def recent_accuracy(attempts: DataFrame, n: int = 5) -> DataFrame:
    """Share of correct among the assessed of the last n; 0 if none is assessed."""
    rate = F.coalesce(F.round(F.avg(F.col("correct").cast("int")), 3), F.lit(0.0))
    return recent(attempts, n).groupBy("learner").agg(rate.alias("recent_accuracy"), F.count("correct").alias("assessed"))


def summary(attempts: DataFrame) -> DataFrame:
    """Totals over all rows, accuracy over all (unassessed included), recent accuracy over assessed, streaks."""
    total = attempts.groupBy("learner").agg(
        F.count("*").alias("attempts"), F.count_if("correct").alias("right"), F.count_if(~F.col("correct")).alias("wrong"),
        F.round(F.count_if("correct") / F.count("*"), 3).alias("accuracy"), F.max_by("skill", F.struct("at", "seq")).alias("latest_skill"),
    )
    return total.join(recent_accuracy(attempts), "learner").join(streaks(attempts), "learner")


def weak_skills(attempts: DataFrame, frame: int = 10) -> DataFrame:
    """(learner, skill, misses, place): skills of wrong attempts in the frame, most misses first, ties by skill."""
    wrong = recent(attempts, frame).where("not correct and trim(skill) <> ''").groupBy("learner", "skill").agg(F.count("*").alias("misses"))
    place = F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("misses"), "skill"))
    return wrong.withColumn("place", place)


def strong_skills(attempts: DataFrame, frame: int = 10, least: int = 2) -> DataFrame:
    """Skills correct at least twice in the frame and not weak."""
    good = recent(attempts, frame).where("correct and trim(skill) <> ''").groupBy("learner", "skill").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    return good.join(weak_skills(attempts, frame), ["learner", "skill"], "left_anti")


def focus(attempts: DataFrame, frame: int = 5, top: int = 3) -> DataFrame:
    """Up to three skills to work on, from the wrong attempts of the last five."""
    return weak_skills(attempts, frame).where(F.col("place") <= top)


def difficulty(summaries: DataFrame, level: str = "level") -> DataFrame:
    """The next level: up after 3 in a row at 0.8 or better, down after 2 misses in a row or below 0.5, else the same."""
    levels = F.array(*map(F.lit, LEVELS))
    up = (F.col("correct_streak") >= 3) & (F.col("recent_accuracy") >= 0.8)
    down = (F.col("wrong_streak") >= 2) | (F.col("recent_accuracy") < 0.5)
    shift = F.when(up, 1).when(down, -1).otherwise(0)
    at = F.greatest(F.lit(1), F.least(F.lit(len(LEVELS)), F.array_position(levels, F.col(level)).cast("int") + shift))
    hint = F.when(F.col("attempts") == 0, "baseline").when(up, "increase").when(down, "decrease").otherwise("same")
    return summaries.withColumns({"next_level": F.element_at(levels, at), "hint": hint})


#: Parts that all instants are cut into at most; a learner has one small row of edges for each.
PARTS = 4096


def _parted(rows: DataFrame) -> DataFrame:
    """Adds __part: how many of the cuts, at even shares of all instants, are no later than the row's.

    A part holds about its share of all rows, so no learner has more than that in one, however many rows are theirs; only
    rows of one instant stay together. The cuts are constants of the plan: a task that is run again cuts as before.
    """
    numeric = isinstance(rows.schema["at"].dataType, NumericType)
    instant = F.col("at").cast("long") if numeric else F.unix_micros(F.col("at").cast("timestamp"))
    n = max(2, min(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(rows.agg(F.percentile_approx(instant, [i / n for i in range(1, n)], 4 * PARTS)).first()[0] or []))
    bounds = F.expr(f"array({', '.join(f'{c}L' for c in cuts)})")
    # A binary search: each step goes ahead where the cut before it is passed.
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    return rows.withColumn("__part", F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= instant, at + step).otherwise(at)))


def pauses(segments: DataFrame, least: float = 1.0) -> DataFrame:
    """(learner, gaps, long_gaps, longest, total) of seconds between consecutive rows; learners of one row have none.

    Gaps within a part are taken there, those between parts from the edges.
    """
    at = F.struct("at", "seq")
    rows = _parted(segments.select("learner", "at", "seq")).withColumn("__us", F.unix_micros(F.col("at").cast("timestamp")))
    gap = F.col("__us") - F.lag("__us").over(Window.partitionBy("learner", "__part").orderBy("at", "seq"))
    is_long = lambda c: F.count_if(F.col(c) / 1e6 >= least)
    ends = rows.withColumn("gap", gap).groupBy("learner", "__part").agg(
        F.count("gap").alias("n"), is_long("gap").alias("long"), F.max("gap").alias("longest"), F.sum("gap").alias("total"),
        F.min_by("__us", at).alias("first"), F.max_by("__us", at).alias("last"),
    )
    edges = ends.withColumn("edge", F.col("first") - F.lag("last").over(Window.partitionBy("learner").orderBy("__part")))
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return edges.groupBy("learner").agg(
        (F.sum("n") + F.count("edge")).alias("gaps"), (F.sum("long") + is_long("edge")).alias("long_gaps"),
        F.round(F.greatest(F.max("longest"), F.max("edge")) / 1e6, 3).alias("longest"), F.round((summed("total") + summed("edge")) / 1e6, 3).alias("total"),
    ).where(F.col("gaps") > 0)


def islands(rows: DataFrame, least: int = 2) -> DataFrame:
    """(learner, island, correct, length): runs of equal outcomes of at least ``least`` rows; null is an outcome too.

    Runs are found within parts and numbered on from the parts before; the ends of a run that crosses parts get one number.
    """
    w = Window.partitionBy("learner", "__part").orderBy("at", "seq")
    change = F.when(F.col("correct").eqNullSafe(F.lag("correct").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = _parted(rows.select("learner", "at", "seq", "correct")).withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("learner", "__part", "run").agg(F.first("correct").alias("correct"), F.count("*").alias("rows"))
    at = F.struct("at", "seq")
    ends = marked.groupBy("learner", "__part").agg(F.max("run").alias("n"), F.min_by("correct", at).alias("first"), F.max_by("correct", at).alias("last"))
    by = Window.partitionBy("learner").orderBy("__part")
    fresh = F.when(F.col("first").eqNullSafe(F.lag("last").over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    before = F.coalesce(F.sum(F.col("n") - 1 + F.col("fresh")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ends.withColumn("fresh", fresh).select(F.col("learner").alias("__learner"), F.col("__part").alias("__at"), (before + F.col("fresh") - 1).alias("shift"))
    met = runs.join(shifts, F.col("learner").eqNullSafe(F.col("__learner")) & (F.col("__part") == F.col("__at")))
    whole = met.groupBy("learner", (F.col("run") + F.col("shift")).alias("island")).agg(F.first("correct").alias("correct"), F.sum("rows").alias("length"))
    return whole.where(F.col("length") >= least)


def appended(history: DataFrame, current: DataFrame) -> DataFrame:
    """The summary, after their current attempts, of the learners who made one; others are left out before anything is shuffled."""
    columns = ["learner", "at", "seq", "correct", "skill"]
    earlier = history.select(*columns).join(current.select("learner").distinct(), "learner", "left_semi")
    return summary(earlier.unionByName(current.select(*columns)))


#: All levels of difficulty, easiest first.
SCALE = ("very_easy", "easy", "medium", "hard", "very_hard")


def target_levels(summaries: DataFrame, level: str = "level", latest_error: str | None = None) -> DataFrame:
    """Adds adjustment, targets (levels to draw from, the first one preferred, then its neighbours) and reason.

    Up after three right in a row or at 0.8 of the recent ones, else down after two wrong in a row or below 0.5. Without
    attempts, the two easiest. After a transcript that was unclear (``latest_error``, a column) the level stays. An unknown
    level counts as easy.
    """
    scale = F.array(*map(F.lit, SCALE))
    at = F.when(F.col(level).isin(*SCALE), F.array_position(scale, F.col(level)).cast("int") - 1).otherwise(SCALE.index("easy"))
    unclear = F.col(latest_error).eqNullSafe("unclear_asr") if latest_error else F.lit(False)
    right, wrong, share = F.coalesce("correct_streak", F.lit(0)), F.coalesce("wrong_streak", F.lit(0)), F.coalesce("recent_accuracy", F.lit(0.0))
    none = F.coalesce("attempts", F.lit(0)) == 0
    up = ~none & ~unclear & ((right >= 3) | (share >= 0.8))
    down = ~none & ~unclear & ~up & ((wrong >= 2) | (share < 0.5))
    there = F.greatest(F.lit(0), F.least(F.lit(len(SCALE) - 1), at + F.when(up, 1).when(down, -1).otherwise(0)))
    near = lambda i: F.array_compact(F.array(*[F.get(scale, i + d) for d in (0, -1, 1)]))
    # A level that was moved to stands first, and again at the head of its neighbours.
    targets = F.when(none, F.array(*map(F.lit, SCALE[:2]))).when(up | down, F.concat(F.array(F.get(scale, there)), near(there))).otherwise(near(there))
    reason = (
        F.when(none, "no_history_baseline").when(unclear, "unclear_asr_retry_before_level_change")
        .when(up, F.when(right >= 3, F.concat(F.lit("correct_streak_"), right)).otherwise("high_recent_accuracy"))
        .when(down, F.when(wrong >= 2, F.concat(F.lit("incorrect_streak_"), wrong)).otherwise("low_recent_accuracy")).otherwise("steady_recent_accuracy")
    )
    return summaries.withColumns({"adjustment": F.when(up, "increase").when(down, "decrease").otherwise("same"), "targets": targets, "reason": reason})
