import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import history as H
from lexmill.operators import lookup as L
from lexmill.operators import sampling as S
from lexmill.sources import readers as R
from lexmill.streaming import corrections as C


def test_text_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.trans.txt").write_text("id-1 HELLO THERE\n\nid-2 YES\n")
    got = R.transcripts(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.text, r.file) for r in got] == [("id-1", "HELLO THERE", "x.trans.txt"), ("id-2", "YES", "x.trans.txt")]
    (tmp_path / "lex").write_text(";;; note\nREAD  R EH1 D\nREAD(2)  R IY1 D\n")
    assert [tuple(r) for r in R.lexicon(spark, str(tmp_path / "lex")).orderBy("variant").collect()] == [("read", 1, ["R", "EH", "D"]), ("read", 2, ["R", "IY", "D"])]
    (tmp_path / "index.csv").write_text("f_1, a.wav, hello, world\n")
    assert tuple(R.headerless(spark, str(tmp_path / "index.csv"), ["id", "path", "text"]).first()) == ("f_1", "a.wav", "hello, world")
    (tmp_path / "o.json").write_text('{"u1": {"score": 3.5, "text": "a"}, "u2": {"score": null, "text": "b"}}')
    assert sorted(map(tuple, R.objects(spark, str(tmp_path / "o.json"), "struct<score:double,text:string>").collect())) == [("u1", 3.5, "a"), ("u2", None, "b")]
    assert R.listing(spark, str(tmp_path), "json").select("stem").first()[0] == "o"


def test_csv_and_unified(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'say "hi",\nthere', None)], "id string, prompt_text string, answer string")
    R.write_csv(rows, str(tmp_path / "c"))
    back = R.csv(spark, str(tmp_path / "c"), rows.schema)
    assert back.count() == 1
    other = spark.createDataFrame([("p2", "word", " ")], "prompt_id string, sentence_text string, target string")
    got = R.unified([rows, other], {"id": ("id", "prompt_id"), "text": ("prompt_text", "sentence_text"), "expected": ("answer", "target")}).orderBy("id").collect()
    assert [r.id for r in got] == ["1", "p2"] and got[1].text == "word" and got[1].expected is None and "sentence_text" in got[1].metadata
    R.write_partitioned(other, str(tmp_path / "p"), "prompt_id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_correction_log_stream(spark, tmp_path):
    schema = "seq long, expected string, heard string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "Cat", "cut"), (2, "cat", "cut"), (3, "", "x"), (4, "dog", "dug")], schema).coalesce(1).write.parquet(source)
    args = [str(tmp_path / x) for x in ("log", "audit", "state")]
    C.append_log(C.stream_of(spark, source, schema), *args).awaitTermination()
    spark.createDataFrame([(5, "dog", "dug"), (6, "sun", "son")], schema).coalesce(1).write.mode("append").parquet(source)
    C.append_log(C.stream_of(spark, source, schema), *args).awaitTermination()
    got = {r.seq: r.status for r in spark.read.parquet(args[1]).collect()}
    assert got == {1: "saved", 2: "duplicate", 3: "skipped", 4: "saved", 5: "duplicate", 6: "saved"}
    assert spark.read.parquet(args[0]).count() == 3


def test_windowed_and_stateful_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    q = C.windowed(C.stream_of(spark, str(tmp_path / "e"), events.schema)).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("windows").select("start", "event_type", "n").collect()} == {tuple(r) for r in C.windowed(events).select("start", "event_type", "n").collect()}
    attempts = events.select(F.col("user_id").alias("learner"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("correct"))
    attempts.write.parquet(str(tmp_path / "a"))
    q = C.running_streaks(C.stream_of(spark, str(tmp_path / "a"), attempts.schema)).writeStream.format("memory").queryName("streaks").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.learner, r.streak) for r in spark.table("streaks").collect()} == {(r.learner, r.correct_streak) for r in H.streaks(attempts).collect()}


def test_history_edges(spark):
    rng = random.Random(4)
    rows = [(u, i, i, rng.choice([True, False, None]), "s") for u in range(5) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "learner long, at long, seq long, correct boolean, skill string")
    got = {r.learner: (r.correct_streak, r.wrong_streak) for r in H.streaks(df).collect()}
    for u in got:
        seq = [r[3] for r in rows if r[0] == u][::-1]
        run = lambda v, seq=seq: next((i for i, x in enumerate(seq) if x is not v), len(seq))
        assert got[u] == (run(True), run(False))
    assert H.summary(df.limit(0)).count() == 0


def test_splits_keep_groups_whole(spark):
    rows = spark.createDataFrame([(f"g{i % 7}", i) for i in range(70)], "g string, i int")
    split = S.group_split(rows, "g", 1)
    sides = {r.g: r.split for r in split.collect()}
    assert len(sides) == 7 and {"train", "valid", "test"} == set(sides.values())
    assert S.leaks(split.where("split = 'train'"), split.where("split = 'test'"), "g").count() == 0
    assert S.virtual_epoch(rows, "i", 150, 2).count() == 150 and S.virtual_epoch(rows.limit(0), "i", 5, 2).count() == 0


def test_missing_is_skipped_for_an_empty_right_side(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert L.missing(left, left.where("k = 1"), "k").count() == 1
    assert L.missing(left, left.limit(0), "k").count() == 0


def test_manifests_and_artifacts(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.jsonl").write_text('{"id": "x"}\n\n{"id": "y"}\n')
    got = R.numbered_jsonl(spark, str(tmp_path / "m"), "id string").collect()
    assert sorted((r.id, r.file, r.line) for r in got) == [("x", "a.jsonl", 1), ("y", "a.jsonl", 3)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.jsonl").write_text('{"id": "x"}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.numbered_jsonl(spark, str(tmp_path / "bad"), "id string").collect()
    assert R.write_jsonl(spark.createDataFrame([(1, "p"), (2, "q")], "z int, a string"), str(tmp_path / "out")) == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"p","z":1}', '{"a":"q","z":2}']
    R.write_union_csv([spark.createDataFrame([(1, "p")], "z int, a string"), spark.createDataFrame([(True,)], "m boolean")], str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["a", "m", "z"] and back.count() == 2
    artifact = tmp_path / "artifact.json"
    artifact.write_text('{"rate": 1, "predictions": [{"dataset": "s", "reference": "a", "prediction": "b"},\n {"dataset": "t", "reference": "c"}]}')
    rows = R.predictions(spark, str(artifact), "struct<dataset:string, reference:string, prediction:string>").collect()
    assert sorted((r.dataset, r.reference, r.prediction) for r in rows) == [("s", "a", "b"), ("t", "c", None)]


def test_paths_groups_and_sounds(spark, tmp_path):
    (tmp_path / "items.csv").write_text('id,text\n1,"a ""b"""\n2,\n')
    assert R.first_existing(spark, str(tmp_path / "none.csv"), str(tmp_path / "items.csv")) == str(tmp_path / "items.csv")
    assert R.first_existing(spark, str(tmp_path / "none.csv")) is None
    got = R.group(spark, str(tmp_path), {"items.csv": "id int, text string", "rules.csv": "id int"})
    assert list(got) == ["items.csv"] and sorted((r.id, r.text) for r in got["items.csv"].collect()) == [(1, 'a "b"'), (2, None)]
    (tmp_path / "phones.txt").write_text("# comment\nAA\tvowel\nAA1\tvowel\nB stop\n")
    assert sorted((r.phone, r.kind) for r in R.phone_kinds(spark, str(tmp_path / "phones.txt")).collect()) == [("AA", "vowel"), ("B", "stop")]
    assert R.empty(spark, "id int, text string").columns == ["id", "text"]
