"""Splits of a manifest for training, written in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.functions import text as T

SPLITS = ("train", "validation", "test")
#: Why a row is left out, in the order in which reasons are looked for.
REASONS = ("missing_audio_path", "audio_file_not_found", "blank_transcript", "duration_too_short", "duration_too_long")


def skip_reason(audio: Column, exists: Column, transcript: Column, duration: Column, least: float = 0.3, most: float = 30.0) -> Column:
    """The first reason to leave a row out, null for none; a null duration passes."""
    tests = (T.blank(audio), ~F.coalesce(exists, F.lit(False)), T.blank(transcript), duration < least, duration > most)
    out = F
    for name, holds in zip(REASONS, tests, strict=True):
        out = out.when(holds, name)
    return out


def split_rows(rows: DataFrame, files: DataFrame | None = None, audio: str = "audio_path", transcript: str = "manual_transcript", split: str = "split", least: float = 0.3, most: float = 30.0) -> DataFrame:
    """Every row as (split, audio, sentence, dataset_source, recording_id, duration_seconds, skipped).

    files: table of the paths that there are (path); without it every path counts as there. A split that is not known is
    train. Columns that the manifest lacks are empty.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    # Built by names of its own, so that columns of the manifest can't clash.
    form = rows.select(
        F.coalesce(has(split, "string"), F.lit("train")).alias("split"), F.coalesce(has(audio, "string"), F.lit("")).alias("audio"), F.coalesce(has(transcript, "string"), F.lit("")).alias("sentence"),
        F.coalesce(has("dataset_source", "string"), F.lit("")).alias("dataset_source"), F.coalesce(has("recording_id", "string"), F.lit("")).alias("recording_id"),
        F.when(~F.isnan(has("duration_seconds", "double")), has("duration_seconds", "double")).alias("duration_seconds"),
    )
    if files is not None:
        there = files.select(F.trim("path").alias("__path")).distinct().withColumn("__there", F.lit(True))
        form = form.join(there, F.trim("audio") == F.col("__path"), "left").drop("__path")
    else:
        form = form.withColumn("__there", F.lit(True))
    why = skip_reason(F.col("audio"), F.col("__there"), F.col("sentence"), F.col("duration_seconds"), least, most)
    known = F.when(F.col("split").isin(*SPLITS), F.col("split")).otherwise("train")
    return form.withColumns({"skipped": why, "split": known, "sentence": T.squeeze("sentence")}).drop("__there")


def write_splits(rows: DataFrame, path: str, **options) -> dict:
    """Writes what ``split_rows`` keeps as JSON lines, a folder a split, and returns counts, hours and reasons, all from the one pass."""
    made = split_rows(rows, **options)
    seen = Observation()
    number = lambda holds: F.sum(F.when(holds, 1).otherwise(0))
    kept = F.col("skipped").isNull()
    observed = made.observe(
        seen, *[number(kept & (F.col("split") == s)).alias(s) for s in SPLITS], *[number(F.col("skipped") == r).alias(r) for r in REASONS],
        (F.sum(F.when(kept, F.coalesce("duration_seconds", F.lit(0.0)))) / 3600).alias("hours"),
    )
    observed.where(kept).drop("skipped").write.mode("overwrite").partitionBy("split").json(path)
    got = {k: v or 0 for k, v in seen.get.items()}
    return {
        "counts": {s: got[s] for s in SPLITS}, "total_rows": sum(got[s] for s in SPLITS), "total_hours": round(got["hours"], 6), "skipped": {r: got[r] for r in REASONS if got[r]},
    }
