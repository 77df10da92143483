"""Answers: the analysis on cases worked out by hand, and token scores and closeness against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import lookup as L
from lexmill.operators import quality as Q
from lexmill.operators import responses as N
from lexmill.operators import sampling as S

CASES = [
    ("cat", "", None, "blank", None), ("cat", None, None, "blank", None), ("Cat!", "cat", None, "correct", None), ("cat", "kitty", ["kitty"], "accepted_variant", None),
    ("cat", "cap", None, "final_sound_error", "final"), ("cat", "bat", None, "initial_sound_error", "initial"), ("cat", "cut", None, "vowel_error", "medial"),
    ("cats", "cat", None, "final_sound_error", "final"), ("stop", "sop", None, "omission", None), ("sop", "stop", None, "insertion", None),
    ("the cat ran home", "the cat", None, "partial_sentence", None), ("the cat ran", "ran cat the", None, "word_order_error", None),
    ("the cat ran", "the cat sat", None, "skipped_word", None), ("the cat ran", "the big cat ran", None, "insertion", None), ("a b b", "a a b", None, "very_close_text_error", None),
]


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "id int, expected string, actual string, accepted array<string>")


def test_analysis(answers):
    got = {r["id"]: r for r in N.analysed(answers, "accepted").collect()}
    assert [(got[i]["error"], got[i]["place"]) for i in range(len(CASES))] == [c[3:] for c in CASES]
    assert got[3]["correct"] and not got[4]["correct"] and not got[0]["correct"]


def test_closeness_and_token_scores(answers):
    for r in N.token_scores(N.matched(answers)).collect():
        e, a = r["e"], r["a"]
        near = 1.0 if not e and not a else 0.0 if not e or not a else round(2 * lcs(e, a) / (len(e) + len(a)), 6)
        assert r["closeness"] == pytest.approx(near, abs=1e-6)
        m = SequenceMatcher(None, e.split(), a.split(), autojunk=False)
        hits = sum(b.size for b in m.get_matching_blocks())
        assert r["token_similarity"] == pytest.approx(m.ratio(), abs=1e-6)
        assert r["token_accuracy"] == pytest.approx(hits / len(e.split()), abs=1e-6)


def test_closeness_of_long_texts(spark):
    """Letters are compared by a kernel, and not by tables of arrays, whose work grew with the square of the length and was the whole query's."""
    rng = random.Random(9)
    rows = [("".join(rng.choice("abc d") for _ in range(rng.randrange(200))), "".join(rng.choice("abc d") for _ in range(rng.randrange(200)))) for _ in range(60)]
    got = N.matched(spark.createDataFrame(rows, "expected string, actual string"))
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        near = 1.0 if not r.e and not r.a else 0.0 if not r.e or not r.a else round(2 * lcs(r.e, r.a) / (len(r.e) + len(r.a)), 6)
        assert r.closeness == pytest.approx(near, abs=1e-6)


def test_empty_answers(spark, answers):
    none = answers.where("false")
    assert N.analysed(none, "accepted").collect() == [] and N.token_scores(none).collect() == []


def test_prefix_steps(spark):
    rows = spark.createDataFrame([(1, "A  b!c"), (2, ""), (3, None), (4, "um a")], "id int, t string")
    got = {r["id"]: r["s"] for r in rows.select("id", T.prefix_steps("t").alias("s")).collect()}
    assert got == {1: ["a", "a b", "a b c"], 2: [], 3: [], 4: ["u", "a"]}


def test_stems_need_a_name(spark):
    left = spark.createDataFrame([("x/a.wav",), ("x/.wav",), ("plain",)], "audio string")
    right = spark.createDataFrame([("y.z/a.txt",), ("y/.txt",), ("other",)], "path string")
    assert [r["stem"] for r in L.by_stem(left, right, "audio", "path").collect()] == ["a"]


def test_soft_filter_with_nulls(spark):
    rows = spark.createDataFrame([(1, "m", "x"), (2, "m", None), (3, "n", None), (4, "n", "y")], "id int, g string, k string")
    assert sorted(r["id"] for r in L.soft_filter(rows, "g", F.col("k") == "x").collect()) == [1, 3, 4]


def test_oversampling_keeps_all_rows_first(spark):
    rows = spark.range(7)
    got = S.oversampled(rows, "id", 24, 3).groupBy("id").agg(F.count("*").alias("n"), F.count_if(~F.col("oversampled")).alias("first")).collect()
    assert len(got) == 7 and sum(r["n"] for r in got) == 24 and {r["first"] for r in got} == {1} and max(r["n"] for r in got) - min(r["n"] for r in got) <= 1
    assert S.oversampled(rows.limit(0), "id", 5, 3).count() == 0


def test_children_states(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (3, 1), (3, 3), (9, 1)], "p int, s int")
    got = {r["id"]: r["state"] for r in Q.children(parents, rows, "k", "p", "s").collect()}
    assert got == {1: "ok", 2: "repeated", 3: "gap", 4: "no_children", 9: "no_parent"}
