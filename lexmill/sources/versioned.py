"""A correction log in versions: written beside, committed by one small file, read by the version that was current.

``<log>/data/<number>-<token>`` holds a version's rows as Parquet, ``<log>/commits/<number>`` the name of that folder. A
commit file gets its name by a rename, which fails where the name is taken (on HDFS in one step; elsewhere the name is
looked up first), so of two writers one fails and tries again on what the other wrote. Rows of a writer that died lie in
a folder that no commit names, and no reader sees them. Versions are never changed, so a reader goes on with the one it
began with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: The log's columns, and the names under which older logs hold the pair.
COLUMNS = ["expected_text", "raw_transcript", "normalized_expected", "normalized_raw", "prompt_type", "source", "created_at", "created_by", "notes"]
EXPECTED = ["expected_text", "letter", "expected", "word"]
RAW = ["raw_transcript", "transcript_error"]
NOTE = "migrated from older reinforcement CSV schema"


class Taken(Exception):
    """Another writer committed this version first."""


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, log: str) -> int:
    """The number of the newest version, 0 without any."""
    at, system = _file(spark, f"{log}/commits")
    if not system.exists(at):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def read(spark: SparkSession, log: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the newest one if none is named. Of a log without versions, none in the log's columns."""
    number = current(spark, log) if version is None else version
    if number == 0:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
    folder = spark.read.text(f"{log}/commits/{number}").first()[0]
    return spark.read.parquet(f"{log}/data/{folder}")


def commit(spark: SparkSession, log: str, number: int, rows: DataFrame) -> int:
    """Writes rows beside what there is, then makes them version ``number``; raises Taken if there is one."""
    folder = f"{number}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{log}/data/{folder}")
    at, system = _file(spark, f"{log}/commits/{number}")
    # Written under another name first: a commit file is there whole or not at all.
    draft, _ = _file(spark, f"{log}/commits/_{folder}")
    out = system.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    if system.exists(at) or not system.rename(draft, at):
        system.delete(draft, False)
        raise Taken(f"version {number} of {log}")
    return number


def updated(spark: SparkSession, log: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Commits what ``change`` makes of the newest version; where another writer was first, of theirs. Returns the number."""
    for _ in range(tries):
        number = current(spark, log)
        try:
            return commit(spark, log, number + 1, change(read(spark, log, number)))
        except Taken:
            continue
    raise Taken(f"{tries} times, of {log}")


def migrated(rows: DataFrame, rule_type: str) -> DataFrame:
    """Rows of any older log in the log's columns.

    Columns are found by name without case, blanks or hyphens. A row whose expected text or transcript is blank or null
    tells nothing and is left out. What is blank or null elsewhere gets its default; other columns are left behind.
    """
    named: dict[str, str] = {}
    for c in rows.columns:
        named.setdefault(c.strip().lower().replace("-", "_").replace(" ", "_"), c)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`").cast("string")
    first = lambda names: next((quoted(named[n]) for n in names if n in named), F.lit(None).cast("string"))
    expected, raw = (F.trim(F.coalesce(first(n), F.lit(""))) for n in (EXPECTED, RAW))

    def kept(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(first([name]), F.lit("")), default).alias(name)

    pairs = rows.where((expected != "") & (raw != ""))
    return pairs.select(
        expected.alias("expected_text"), raw.alias("raw_transcript"), kept("normalized_expected", T.for_scoring(expected)), kept("normalized_raw", T.for_scoring(raw)),
        kept("prompt_type", F.lit(rule_type)), kept("source", F.lit("curated")), kept("created_at", F.lit("")), kept("created_by", F.lit("")), kept("notes", F.lit(NOTE)),
    )


def migrate(spark: SparkSession, log: str, rule_type: str, older: DataFrame | None = None) -> int:
    """Brings the log to its columns and returns the version that has them; one that has them already stays as it is.

    older: rows of a log from before versions, taken in if there is no version yet.
    """
    number = current(spark, log)
    if number == 0:
        return commit(spark, log, 1, migrated(older, rule_type) if older is not None else read(spark, log, 0))
    rows = read(spark, log, number)
    return number if rows.columns == COLUMNS else commit(spark, log, number + 1, migrated(rows, rule_type))
