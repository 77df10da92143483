"""Queries of streams, run as batches over whole tables: what a stream would have written once it has caught up."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.common import Registry, table
from lexmill.streaming import corrections as S

R = Registry()


@R.add("""WITH p AS (SELECT a.p_partkey AS seq, a.p_name AS expected, b.p_name AS heard FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    o AS (SELECT DISTINCT 'red widget' AS expected, p_name AS heard FROM part),
    f AS (SELECT *, min(seq) OVER (PARTITION BY expected, heard) AS first FROM p)
    SELECT seq, f.expected, f.heard, CASE WHEN f.expected = f.heard THEN 'skipped' WHEN o.heard IS NOT NULL OR seq > first THEN 'duplicate' ELSE 'saved' END AS status
    FROM f LEFT JOIN o ON o.expected = f.expected AND o.heard = f.heard""")
def stream_correction_outcomes(spark, d):
    part = table(spark, d, "part")
    nxt = part.select((F.col("p_partkey") - 1).alias("seq"), F.col("p_name").alias("heard"))
    batch = part.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("expected")).join(nxt, "seq")
    known = part.select(F.lit("red widget").alias("expected"), F.col("p_name").alias("heard")).distinct()
    return S.outcomes(batch, known)


@R.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    w = S.windowed(table(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


@R.add("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stream_remaining(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.remaining(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")
