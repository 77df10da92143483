"""What a recording's header tells, read from the bytes of WAV files in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.binding import bound

CHUNKS = 64  # a header has a handful of chunks before its samples


def _number(content: Column, at: Column, size: int) -> Column:
    """An unsigned little-endian number at a place, from 1; null beyond the end."""
    digits = F.concat(*[F.hex(F.substring(content, at + i, F.lit(1))) for i in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("long"))


def wav_header(content: Column) -> Column:
    """struct(channels, sample_rate, bits, frames, duration_seconds) of a WAV file's bytes; null for anything else.

    The chunks are walked by their sizes, padded to even ones. A file without format or samples, or cut off before the end
    of its samples, has none.
    """
    name = lambda at: F.decode(F.substring(content, at, F.lit(4)), "ISO-8859-1")
    start = F.struct(F.lit(13).cast("long").alias("at"), F.lit(0).cast("long").alias("format"), F.lit(None).cast("long").alias("data"), F.lit(False).alias("over"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"].cast("int")
        size = _number(content, at + 4, 4)
        kind = name(at)
        found = F.struct(
            (s["at"] + 8 + size + size % 2).alias("at"), F.when(kind == "fmt ", s["at"] + 8).otherwise(s["format"]).alias("format"),
            F.when((kind == "data") & (s["at"] + 7 + size <= F.length(content)), size).alias("data"), (kind == "data").alias("over"),
        )
        return F.when(s["over"] | size.isNull() | (s["at"] + 8 > F.length(content)), s).otherwise(found)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(CHUNKS)), start, step)

    def told(s: Column) -> Column:
        at = s["format"].cast("int")
        rate, block = _number(content, at + 4, 4), _number(content, at + 12, 2)
        whole = (s["format"] > 0) & s["data"].isNotNull() & (rate > 0) & (block > 0)
        frames = F.floor(s["data"] / block)
        return F.when(whole, F.struct(
            _number(content, at + 2, 2).alias("channels"), rate.alias("sample_rate"), _number(content, at + 14, 2).alias("bits"), frames.alias("frames"), F.round(frames / rate, 3).alias("duration_seconds")))

    riff = (F.length(content) >= 12) & (name(F.lit(1)) == "RIFF") & (name(F.lit(9)) == "WAVE")
    return F.when(riff, bound(walked, told))


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, channels, sample_rate, bits, frames, duration_seconds) of every .wav file below a folder, null where unreadable."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", wav_header(F.col("content")).alias("h")).select("path", "length", "h.*")
