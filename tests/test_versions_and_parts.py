"""Snapshots of shards, versions of the correction log, histories in parts and in a stream."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import candidates as C
from lexmill.operators import history as H
from lexmill.sources import snapshots as N
from lexmill.sources import versioned as V
from lexmill.streaming import corrections as S

ATTEMPTS = "learner long, at timestamp, seq long, correct boolean, skill string"


def _shard(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    table = pa.table({"segment_id": [f"s{i}" for i in rows], "speaker": ["p"] * len(rows), "text": [f"t{i}" if i % 3 else None for i in rows], "begin_time": [1.0] * len(rows), "end_time": [float(i) for i in rows], "extra": [b"x" * 100] * len(rows)})
    with pa.ipc.new_stream(str(path), table.schema) as out:
        out.write_table(table, max_chunksize=2)


def test_the_newest_snapshot_is_read_whole(spark, tmp_path):
    old, new = tmp_path / "xs" / "0.0.0" / "aa", tmp_path / "xs" / "0.1.0" / "bb"
    with pytest.raises(FileNotFoundError):
        N.newest_snapshot(str(tmp_path), 3)
    for folder, base in ((old, 100), (new, 0)):
        for n in range(2):
            _shard(folder / f"giga-train-0000{n}-of-00002.arrow", range(base + 5 * n, base + 5 * n + 5))
        (folder / "dataset_info.json").write_text("{}")
    _shard(tmp_path / "xs" / "0.2.0" / "cc" / "giga-train-00000-of-00001.arrow", [7])  # not written whole: no mark
    assert N.newest_snapshot(str(tmp_path), 3) == str(new)
    rows = N.cached_split(spark, str(tmp_path), "train", ["segment_id", "text", "speaker", "end_time", "begin_time"], 3)
    assert rows.columns == ["segment_id", "text", "speaker", "end_time", "begin_time"] and rows.rdd.getNumPartitions() == 2
    got = {r.source_id: r for r in N.standard(rows, "giga", "train").collect()}
    assert sorted(got) == [f"s{i}" for i in range(10)]
    assert (got["s0"].duration_seconds, got["s9"].duration_seconds, got["s9"].text, got["s4"].text) == (0.0, 8.0, None, "t4")
    assert N.cached_split(spark, str(tmp_path), "train", depth=3).count() == 10
    (new / "giga-train-00000-of-00002.arrow").unlink()
    with pytest.raises(Exception, match="lacks shards"):
        N.cached_split(spark, str(tmp_path), "train", depth=3).count()
    with pytest.raises(Exception, match="no shards"):
        N.cached_split(spark, str(tmp_path), "test", depth=3).count()
    _shard(new / "giga-train-00000-of-00002.arrow", range(5))
    whole = (new / "giga-train-00000-of-00002.arrow").read_bytes()
    (new / "giga-train-00000-of-00002.arrow").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):  # noqa: B017
        N.cached_split(spark, str(tmp_path), "train", depth=3).collect()


def test_a_log_is_migrated_once_and_readers_keep_their_version(spark, tmp_path):
    log = str(tmp_path / "log")
    assert V.current(spark, log) == 0 and V.read(spark, log).count() == 0 and V.read(spark, log).columns == V.COLUMNS
    older = spark.createDataFrame([(" b ", "Bee!", None, "x"), ("", "no", None, "x"), ("c", None, "me", "x"), ("d", "dee", "me", None)], "`Letter` string, `Transcript-Error` string, `created by` string, other string")
    V.commit(spark, log, 1, older.withColumnsRenamed({"Transcript-Error": "transcript_error", "created by": "created_by"}))
    before = V.read(spark, log)
    (tmp_path / "log" / "data" / "2-died").mkdir()  # a writer that died before its commit
    assert V.migrate(spark, log, "letter") == 2 and V.migrate(spark, log, "letter") == 2
    got = sorted(tuple(r) for r in V.read(spark, log).collect())
    assert got == [("b", "Bee!", "b", "bee", "letter", "curated", "", "", V.NOTE), ("d", "dee", "d", "dee", "letter", "curated", "", "me", V.NOTE)]
    assert before.count() == 4 and V.read(spark, log, 1).columns != V.COLUMNS
    with pytest.raises(V.Taken):
        V.commit(spark, log, 2, V.read(spark, log))
    assert V.current(spark, log) == 2 and V.read(spark, log).count() == 2
    assert V.updated(spark, log, lambda rows: rows.where("expected_text = 'b'")) == 3 and V.read(spark, log).count() == 1
    assert sorted(r.expected_text for r in V.migrated(older, "letter").collect()) == ["b", "d"]
    fresh = str(tmp_path / "fresh")
    assert V.migrate(spark, fresh, "letter", older) == 1 and V.read(spark, fresh).count() == 2
    assert V.migrate(spark, str(tmp_path / "none"), "word") == 1 and V.read(spark, str(tmp_path / "none")).count() == 0


def _plain_runs(seq):
    runs = []
    for x in seq:
        if runs and runs[-1][0] is x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    return runs


def test_gaps_and_runs_across_parts(spark):
    rng = random.Random(7)
    begin = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        u = 1 if i % 3 else rng.choice([None, 2, 3])  # one learner with two thirds of all
        rows.append((u, begin + dt.timedelta(seconds=rng.randrange(3000), microseconds=rng.randrange(10**6)) if i % 50 else begin, i, rng.choice([True, True, True, False, None]), "s"))
    df = spark.createDataFrame(rows, ATTEMPTS)
    want_gaps, want_runs = {}, set()
    for u in (None, 1, 2, 3):
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == u) if u else sorted(((r[1], r[2], r[3]) for r in rows if r[0] is None), key=lambda r: r[:2])
        gaps = [(b[0] - a[0]).total_seconds() for a, b in zip(mine, mine[1:], strict=False)]
        want_gaps[u] = (len(gaps), sum(g >= 10 for g in gaps), round(max(gaps), 3), round(sum(gaps), 3))
        want_runs |= {(u, n + 1, c, k) for n, (c, k) in enumerate(_plain_runs([r[2] for r in mine])) if k >= 2}
    assert {r.learner: (r.gaps, r.long_gaps, r.longest, r.total) for r in H.pauses(df, 10.0).collect()} == want_gaps
    assert {(r.learner, r.island, r.correct, r.length) for r in H.islands(df).collect()} == want_runs
    assert len({r[0] for r in H._parted(df).where("learner = 1").select("__part").distinct().collect()}) == 8
    none = df.limit(0)
    assert H.pauses(none).count() == 0 and H.islands(none).count() == 0
    same = spark.createDataFrame([(1, None, i, True, "s") for i in range(5)] + [(1, begin, 9, True, "s")], ATTEMPTS)
    assert [(r.island, r.length) for r in H.islands(same).collect()] == [(1, 6)] and H.pauses(same).count() == 0


def test_leading_items_give_the_same_top(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, rng.randrange(2), rng.randrange(3)) for i in range(300)], "item int, module int, size int")
    learners = spark.createDataFrame([(u, u % 2) for u in range(20)], "learner int, module int")
    terms = {"focus": (F.col("size") + F.col("learner")) % 3 == 0, "active": F.col("size") > 0}
    top = lambda some: {(r.learner, r.item, r.score, r.place) for r in C.recommended(learners, some, ["module"], "learner", "item", terms, 4).collect()}
    few = C.leading(items, ["module", "size"], "item", 4)
    assert few.count() == 24 and top(few) == top(items)


def test_learners_alike_share_their_candidates(spark):
    """The same top as when each learner meets all items, with what is unknown, learners met twice and keys below zero."""
    rng = random.Random(5)
    items = spark.createDataFrame([(i, rng.randrange(3), rng.randrange(7)) for i in range(200)], "item int, module int, size int")
    rows = [(u, abs(u) % 4, rng.choice([True, False, None])) for u in range(-30, 60)] + [(7, 1, True), (None, 2, None)]
    learners = spark.createDataFrame(rows, "learner int, module int, low boolean").withColumn("lap", F.col("learner") % 3)
    terms = {"focus": (F.col("size") + F.col("lap")) % 3 == 0, "difficulty": (F.col("size") < 4) == F.col("low"), "active": F.col("size") > 0}
    top = lambda *alike: sorted(((r.learner, r.item, r.score, r.place, r.reasons) for r in C.recommended(learners, items, ["module"], "learner", "item", terms, 4, *alike).collect()), key=str)
    assert top(["lap", "low"]) == top() and len(top()) > 200


def test_a_stream_sums_up_as_a_batch_does(spark, tmp_path):
    rng = random.Random(11)
    begin, rows, batches = dt.datetime(2024, 1, 1), [], []
    for n in range(3):
        # Out of order within the delay of ten minutes.
        part = [(rng.randrange(4), begin + dt.timedelta(minutes=6 * n, seconds=rng.randrange(600)), 1000 * n + i, rng.choice([True, False, None]), rng.choice(["a", "b", None])) for i in range(40)]
        batches.append(part)
    source = str(tmp_path / "in")
    spark.createDataFrame([], ATTEMPTS).write.parquet(source)
    out = S.running_summary(S.stream_of(spark, source, spark.createDataFrame([], ATTEMPTS).schema), "10 minutes")
    columns = ["learner", "attempts", "right", "wrong", "accuracy", "latest_skill", "recent_accuracy", "assessed", "correct_streak", "wrong_streak"]
    q = out.writeStream.format("memory").queryName("summed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for part in batches:
            rows += part
            spark.createDataFrame(part, ATTEMPTS).coalesce(1).write.mode("append").parquet(source)
            q.processAllAvailable()
            seen = {r.learner: r for r in sorted(spark.table("summed").collect(), key=lambda r: r.attempts)}
            want = {r.learner: tuple(r[c] for c in columns) for r in H.summary(spark.createDataFrame(rows, ATTEMPTS)).collect()}
            assert {u: tuple(r[c] for c in columns) for u, r in seen.items()} == want and all(r.late == 0 for r in seen.values())
        spark.createDataFrame([(0, begin - dt.timedelta(days=1), 9999, True, "z")], ATTEMPTS).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
        last = max((r for r in spark.table("summed").collect() if r.learner == 0), key=lambda r: r.attempts)
        assert (last.late, last.attempts, last.right, last.latest_skill, last.correct_streak) == (1, want[0][1] + 1, want[0][2] + 1, want[0][5], want[0][8])
    finally:
        q.stop()
