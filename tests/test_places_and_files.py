"""Rows by place, rule joins that never send the rows out, exports in one pass, headers of recordings."""

import json
import struct

from pyspark.sql import functions as F

from lexmill.operators import lookup as L
from lexmill.operators import positions as N
from lexmill.sources import audio, exports


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_by_place(spark, tmp_path):
    spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    got = N.numbered(a)
    assert "Window" not in plan(got)
    rows = got.collect()
    assert sorted(r.place for r in rows) == list(range(1000)) and [r.x for r in sorted(rows, key=lambda r: r.place)] == [r.x for r in a.collect()]
    both = N.side_by_side(a, spark.range(3).select(F.col("id").alias("y")))
    assert "Window" not in plan(both) and both.count() == 1000 and {r.place: r.y for r in both.where("y is not null").collect()} == {0: 0, 1: 1, 2: 2}
    few = N.sampled_in_order(a, 50, 3).collect()
    assert [r.place for r in few] == sorted(r.place for r in few) and len({r.place for r in few}) == 50
    assert N.sampled_in_order(a, 5000, 3).count() == 1000 and N.numbered(a.limit(0)).count() == 0


def test_rule_joins_send_out_the_rules(spark, monkeypatch):
    rows = spark.range(200).select("id", (F.col("id") / 7).alias("score"))
    bands = spark.createDataFrame([("a", 0.0, 5.0), ("b", 5.01, 9.0), ("c", 8.0, 20.0)], "band string, least double, most double")
    few = L.band(rows, "score", bands)
    assert "BuildRight" in plan(few) and "BuildLeft" not in plan(few)
    monkeypatch.setattr(L, "RULES", 1)
    many = L.band(rows, "score", bands)
    assert "NestedLoop" not in plan(many) and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    rules = spark.createDataFrame([("1", "ANY", "x"), ("1", "2", "y")], "k string, rule_n string, outcome string")
    keys = spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "2")], "k string, n string")
    want = {("1", "2", "y"), ("1", "3", "x"), ("2", "2", None)}
    assert {tuple(r) for r in L.wildcard(keys, rules, "k", "n").select("k", "n", "outcome").collect()} == want
    monkeypatch.setattr(L, "RULES", 10)
    sent = L.wildcard(keys, rules, "k", "n")
    assert {tuple(r) for r in sent.select("k", "n", "outcome").collect()} == want and "BuildLeft" not in plan(sent)


def test_export_of_splits(spark, tmp_path):
    rows = [("a.wav", " one  two ", "train", 1.0, "s", "r1"), ("b.wav", "x", "odd", None, "s", "r2"), ("c.wav", "y", "test", 1800.0, None, None), ("", "y", "test", 1.0, "s", "r"), ("gone.wav", "y", "test", 1.0, "s", "r"),
            ("a.wav", " ", "test", 1.0, "s", "r"), ("a.wav", "y", None, 0.1, "s", "r"), ("b.wav", "z", "validation", float("nan"), "s", "r3"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "audio_path string, manual_transcript string, split string, duration_seconds double, dataset_source string, recording_id string")
    files = spark.createDataFrame([("a.wav",), ("b.wav",), ("c.wav",), ("a.wav",)], "path string")
    got = exports.write_splits(df, str(tmp_path / "out"), files=files)
    assert got["counts"] == {"train": 2, "validation": 1, "test": 0} and got["total_rows"] == 3 and got["total_hours"] == round(1 / 3600, 6)
    assert got["skipped"] == {"missing_audio_path": 2, "audio_file_not_found": 1, "blank_transcript": 1, "duration_too_short": 1, "duration_too_long": 1}
    lines = [json.loads(x) for p in (tmp_path / "out" / "split=train").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["audio"], x["sentence"]) for x in lines) == [("a.wav", "one two"), ("b.wav", "x")]


def wav(rate=16000, frames=24000, channels=1, bits=16, extra=b"", cut=0):
    block = channels * bits // 8
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * block, block, bits) + extra + b"data" + struct.pack("<I", frames * block) + bytes(frames * block)
    return (b"RIFF" + struct.pack("<I", len(body)) + body)[: -cut or None]


def test_headers_of_recordings(spark, tmp_path):
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    files = {"a.wav": wav(), "b.wav": wav(44100, 1000, 2, 8, odd), "cut.wav": wav(cut=10), "text.wav": b"no sound at all", "head.wav": b"RIFF\0\0\0\0WAVE", "still.wav": wav(rate=0), "other.mp3": wav()}
    (tmp_path / "deep").mkdir()
    for name, content in files.items():
        (tmp_path / "deep" / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.recordings(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"other.mp3"}
    assert tuple(got["a.wav"])[2:] == (1, 16000, 16, 24000, 1.5) and tuple(got["b.wav"])[2:] == (2, 44100, 8, 1000, 0.023)
    assert all(tuple(got[n])[2:] == (None,) * 5 for n in ("cut.wav", "text.wav", "head.wav", "still.wav"))
