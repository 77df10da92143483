"""How the queries name their inputs: tables, and the tables that stand in for pairs, attempts and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ref, hyp, brand, kind): each part's name against that of the next key, an equi-join."""
    part = table(spark, sf_dir, "part")
    nxt = part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("hyp"))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("ref"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).join(nxt, "id")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(learner, at, seq, correct, skill, prompt): events as attempts; a view is not assessed."""
    e = table(spark, sf_dir, "events")
    right = F.when(F.col("event_type").isin("purchase", "signup"), True).when(F.col("event_type").isin("error", "click"), False)
    return e.select(F.col("user_id").alias("learner"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), right.alias("correct"), F.col("event_type").alias("skill"), F.get_json_object("props", "$.k").cast("long").alias("prompt"))


#: The same in SQL, as the first of a statement's common table expressions.
FORM = r"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^A-Za-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('um', 'uh', 'ah', 'hmm')), ' ')"
PAIRS = "pairs AS (SELECT a.p_partkey AS id, a.p_name AS ref, b.p_name AS hyp, a.p_brand AS brand, a.p_type AS kind FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
FORMS = f"{PAIRS}, forms AS (SELECT *, {FORM.format('ref')} AS r, {FORM.format('hyp')} AS h FROM pairs)"
#: Token edits by way of character edits: each distinct word stands for one character.
SCORED = f"""{FORMS},
words AS (SELECT DISTINCT unnest(string_split(r || ' ' || h, ' ')) AS w FROM forms),
codes AS (SELECT map_from_entries(list((w, chr(CAST(33 + n AS INTEGER))))) AS m FROM (SELECT w, row_number() OVER (ORDER BY w) AS n FROM words WHERE w <> '')),
coded AS (
    SELECT forms.*, array_to_string(list_transform(string_split(r, ' '), lambda x: m[x]), '') AS rc, array_to_string(list_transform(string_split(h, ' '), lambda x: m[x]), '') AS hc
    FROM forms, codes
),
scored AS (
    SELECT *, levenshtein(rc, hc) AS word_edits, length(rc) AS n, levenshtein(r, h) AS letter_edits, length(r) AS m,
           levenshtein(rc, hc) / length(rc) AS wer, levenshtein(r, h) / length(r) AS cer, r = h AS exact
    FROM coded
)"""
ATTEMPTS = """attempts AS (
    SELECT user_id AS learner, ts AS tm, event_id AS seq, event_type AS skill, CAST(props ->> '$.k' AS BIGINT) AS prompt,
           CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type IN ('error', 'click') THEN false END AS correct
    FROM events
),
latest AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY tm DESC, seq DESC) AS rn FROM attempts)"""


class Registry:
    """Queries and their SQL, under one name each."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put
