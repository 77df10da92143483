"""Streams of attempts and corrections: an append-only correction log, windows with late data, streaks kept as state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["expected", "heard"]


def outcomes(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Each incoming correction with what becomes of it: saved, duplicate (of the log or an earlier row), skipped (blank)."""
    norm = batch.withColumns({k: F.lower(F.trim(F.coalesce(F.col(k), F.lit("")))) for k in KEYS})
    filled = (F.col("expected") != "") & (F.col("heard") != "") & (F.col("expected") != F.col("heard"))
    first = norm.where(filled).groupBy(*KEYS).agg(F.min("seq").alias("first"))
    old = known.select(*KEYS).distinct().withColumn("old", F.lit(True))
    met = norm.join(first, KEYS, "left").join(old, KEYS, "left")
    state = F.when(~filled, "skipped").when(F.col("old") | (F.col("seq") > F.col("first")), "duplicate").otherwise("saved")
    return met.select("seq", *KEYS, state.alias("status"))


def append_log(stream: DataFrame, log: str, audit: str, checkpoint: str) -> StreamingQuery:
    """Runs the log over what is there: new corrections append to ``log``, every row's outcome to ``audit``.

    A batch that is run again after a failure overwrites its own part, so nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "seq long, expected string, heard string, status string, batch long"
        known = spark.read.schema(schema).parquet(log) if number else spark.createDataFrame([], schema)
        done = outcomes(batch, known.where(F.col("batch") < number)).withColumn("batch", F.lit(number).cast("long"))
        done.write.mode("overwrite").parquet(f"{audit}/batch={number}")
        written = spark.read.schema("seq long, expected string, heard string, status string").parquet(f"{audit}/batch={number}")
        written.where("status = 'saved'").write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and values by event time and type; rows later than the delay are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    grouped = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def running_streaks(attempts: DataFrame) -> DataFrame:
    """(learner, streak, attempts) after each batch: the trailing run of correct answers, kept as state by learner."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, seen = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        for correct in rows["correct"].tolist():
            streak = streak + 1 if correct is True else 0
        seen += len(rows)
        state.update((streak, seen))
        yield pd.DataFrame({"learner": [key[0]], "streak": [streak], "attempts": [seen]})

    return attempts.groupBy("learner").applyInPandasWithState(
        step, "learner long, streak long, attempts long", "streak long, attempts long", "update", GroupStateTimeout.NoTimeout
    )


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed batch still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def in_steps(todo: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], output: str, steps: int = 8) -> int:
    """Works through rows in steps, each written whole to its folder; returns how many of them this call did.

    A row's step is a hash of its key, so a call after a failure meets the same steps: those that were finished are skipped,
    a half one is done again from its start. ``steps`` has to stay the same for one output.
    """
    spark = todo.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = 0
    for step in range(steps):
        folder = f"{output}/step={step}"
        mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not mark.getFileSystem(conf).exists(mark):
            work(todo.where(F.pmod(F.xxhash64(key), F.lit(steps)) == step)).write.mode("overwrite").parquet(folder)
            done += 1
    return done


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


#: What a learner's summary is made of: counts, the last rows with (at in microseconds, seq, outcome, skill), both streaks.
RECENT = 5
SUMMARY = "learner long, attempts long, right long, wrong long, late long, latest_skill string, recent_right long, assessed long, correct_streak long, wrong_streak long"


def _folded(told: dict, rows: list) -> dict:
    """A learner's figures after some rows in order, each [at, seq, outcome, skill]; the given ones stay as they are."""
    out = {**told, "last": list(told["last"])}
    for row in rows:
        outcome = row[2]
        out["attempts"] += 1
        out["right"] += outcome is True
        out["wrong"] += outcome is False
        out["correct_streak"] = out["correct_streak"] + 1 if outcome is True else 0
        out["wrong_streak"] = out["wrong_streak"] + 1 if outcome is False else 0
        out["last"] = [*out["last"], row][-RECENT:]
    return out


def running_summary(attempts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each learner's history summed up again after each batch that brings an attempt of theirs; columns as ``summary`` has.

    attempts: learner long, at timestamp, seq long, correct boolean, skill string. Rows may come out of order within the
    delay: those the watermark has not passed are held and put in order, earlier ones are folded into counts, streaks and
    the last five. A row later than that still counts in the totals and in ``late``, but moves neither streaks nor recents,
    since what came after it is no longer held. A learner's state is thus bounded by what they do within the delay.
    """
    empty = {"attempts": 0, "right": 0, "wrong": 0, "correct_streak": 0, "wrong_streak": 0, "last": []}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, held, late = json.loads(state.get[0]) if state.exists else (empty, [], 0)
        passed = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            # A column with nulls is of objects, one without of booleans; None stays None either way.
            for at, seq, outcome, skill in zip(frame["us"].tolist(), frame["seq"].tolist(), frame["correct"].astype(object).tolist(), frame["skill"].tolist(), strict=True):
                if at < passed:
                    late += 1
                    told = {**told, "attempts": told["attempts"] + 1, "right": told["right"] + (outcome is True), "wrong": told["wrong"] + (outcome is False)}
                else:
                    held.append([at, seq, outcome, skill])
        held.sort(key=lambda row: row[:2])
        told = _folded(told, [row for row in held if row[0] < passed])
        held = [row for row in held if row[0] >= passed]
        state.update((json.dumps((told, held, late)),))
        now = _folded(told, held)
        last = now["last"]
        yield pd.DataFrame({
            "learner": [key[0]], "attempts": [now["attempts"]], "right": [now["right"]], "wrong": [now["wrong"]], "late": [late], "latest_skill": [last[-1][3] if last else None],
            "recent_right": [sum(row[2] is True for row in last)], "assessed": [sum(row[2] is not None for row in last)], "correct_streak": [now["correct_streak"]], "wrong_streak": [now["wrong_streak"]],
        })

    timed = attempts.select("learner", "at", F.unix_micros("at").alias("us"), "seq", "correct", "skill").withWatermark("at", delay)
    figures = timed.groupBy("learner").applyInPandasWithState(step, SUMMARY, "told string", "update", GroupStateTimeout.NoTimeout)
    recent = F.when(F.col("assessed") > 0, F.round(F.col("recent_right") / F.col("assessed"), 3)).otherwise(0.0)
    return figures.select(
        "learner", "attempts", "right", "wrong", F.round(F.col("right") / F.col("attempts"), 3).alias("accuracy"), "latest_skill", recent.alias("recent_accuracy"), "assessed", "correct_streak", "wrong_streak", "late"
    )
