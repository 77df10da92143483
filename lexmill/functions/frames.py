"""Frames of scores and waveforms held in arrays: levels, decoding, margins, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def rms(wave: Column) -> Column:
    return F.when(F.size(wave) > 0, F.sqrt(total(F.transform(wave, lambda x: x * x)) / F.size(wave))).otherwise(0.0)


def dbfs(wave: Column) -> Column:
    """Level in decibels of full scale, -120 at silence."""
    return F.greatest(F.lit(-120.0), 20 * F.log10(F.greatest(rms(wave), F.lit(1e-9))))


def clipped(wave: Column, limit: float) -> Column:
    return F.when(F.size(wave) > 0, F.size(F.filter(wave, lambda x: F.abs(x) >= limit)) / F.size(wave)).otherwise(0.0)


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_softmax(values: Column) -> Column:
    top = F.array_max(values)
    norm = F.log(total(F.transform(values, lambda x: F.exp(x - top)))) + top
    return F.transform(values, lambda x: x - norm)


def margin(values: Column) -> Column:
    """How far the best value is ahead of the next."""
    order = F.sort_array(values, asc=False)
    return F.element_at(order, 1) - F.element_at(order, 2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def collapsed(labels: Column, blank: Column) -> Column:
    """Repeats of the label before are dropped, then blanks."""
    kept = F.filter(labels, lambda x, i: (i == 0) | (x != F.element_at(labels, F.greatest(i, F.lit(1)))))
    return F.filter(kept, lambda x: x != blank)


def top(scores: Column, n: int) -> Column:
    """Places, from 0, of the n highest scores; ties to the lower place."""
    placed = F.transform(scores, lambda x, i: F.struct((-x).alias("x"), i.alias("at")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda p: p["at"])


def peak(wave: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(wave, lambda x: F.abs(x))), F.lit(0.0))


def speech(voiced: Column, least: int) -> Column:
    """struct(segments, frames, ratio) of an array of flags: runs of at least ``least`` voiced frames, and their share."""
    marks = F.array_join(F.transform(voiced, lambda v: F.when(v, "1").otherwise("0")), "")
    runs = F.regexp_extract_all(marks, F.lit(f"1{{{least},}}"), F.lit(0))
    frames = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r))
    ratio = F.when(F.size(voiced) > 0, F.round(F.least(F.lit(1.0), frames / F.size(voiced)), 3)).otherwise(0.0)
    return F.struct(F.size(runs).alias("segments"), frames.alias("frames"), ratio.alias("ratio"))


def quality_flags(seconds: Column, level: Column, clipped_share: Column, segments: Column, ratio: Column, limits: dict[str, float]) -> Column:
    """Warnings about a recording, in order; limits: shortest, longest, quiet, clipped, silent, spoken."""
    rules = [
        ("audio_too_short", seconds < limits["shortest"]), ("audio_too_long", seconds > limits["longest"]), ("no_speech_detected", segments == 0),
        ("mostly_silent", (1 - ratio >= limits["silent"]) | (ratio < limits["spoken"])), ("low_volume", level < limits["quiet"]), ("clipped", clipped_share > limits["clipped"]),
    ]
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in rules]))


def bad_for_fragments(warnings: Column, quality: Column, speech_seconds: Column) -> Column:
    """Whether a recording is too poor to judge a fragment of a word by."""
    flagged = F.exists(warnings, lambda w: w.isin("mostly_silent", "audio_too_short", "clipped"))
    named = F.coalesce(F.lower(quality).isin("bad", "unusable", "mostly_silent", "too_short"), F.lit(False))
    return flagged | named | F.coalesce(speech_seconds < 0.35, F.lit(False))


def mean_of(values: Column) -> Column:
    """Mean of those texts that are numbers, to three places; null if none is."""
    found = F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.round(total(found) / F.size(found), 3))


def masked(scores: Column, suppressed: list[int]) -> Column:
    """Scores of a frame, those of the suppressed labels at minus infinity; labels beyond the frame are ignored."""
    return F.transform(scores, lambda x, i: F.when(i.isin(*suppressed), float("-inf")).otherwise(x)) if suppressed else scores


def vocabulary_faults(vocabulary: dict[str, int], width: int, blank: str, separator: str) -> list[str]:
    """What keeps a decoder's vocabulary from naming frames of a width: labels missing, repeated or beyond it, blank or separator absent."""
    places = list(vocabulary.values())
    faults = [f"no_{name}" for name, label in (("blank", blank), ("separator", separator)) if label not in vocabulary]
    if len(set(places)) < len(places):
        faults.append("repeated_place")
    if any(not 0 <= at < width for at in places):
        faults.append("place_beyond_frame")
    if set(range(width)) - set(places):
        faults.append("place_without_label")
    return faults
