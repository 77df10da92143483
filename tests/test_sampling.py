import hashlib

from pyspark.sql import functions as F

from lexmill.operators import sampling as S


def test_places_are_ranks_by_draw_over_all_and_within_groups(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g long").repartition(5)
    order = lambda k: (hashlib.sha256(f"4:{k}".encode()).hexdigest(), k)
    got = {r.k: r.place for r in S.placed(df, S.draw(4, "k"), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted((k for k, _ in rows), key=order), 1)}
    within = {r.k: r.place for r in S.placed(df, S.draw(4, "k"), "k", "g").collect()}
    for g in (None, 0, 1, 2):
        keys = sorted((k for k, x in rows if x == g), key=order)
        assert [within[k] for k in keys] == list(range(1, len(keys) + 1))


def test_places_are_ranked_in_parts(spark):
    """Rows are ranked within parts of the draw; the one ordered sum is over the parts' counts."""
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = S.placed(df, S.draw(4, "k"), "k")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and any("row_number" in w and "__part" in w for w in windows) and any("sum(" in w for w in windows)


def test_planned_mixes(spark):
    rows = [(i, "a" if i < 10 else "b", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, source string, keep int")
    plan = {r.source: (r.raw, r.filtered, r.effective) for r in S.mix_plan(df, "source", F.col("keep") == 1, {"a": 0.5, "b": 0.25, "c": 0.25}, 21).collect()}
    assert plan == {"a": (10, 5, 10), "b": (30, 15, 5), "c": (0, 0, 6)}
    built = S.mix_build(df, "source", "k", F.col("keep") == 1, {"a": 0.5, "b": 0.5}, 20, 3).collect()
    assert sorted(r.place for r in built) == list(range(1, 21)) and sum(r.source == "a" for r in built) == 10
