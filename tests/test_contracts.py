"""Contracts of content: small tables with one fault each."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import frames as N
from lexmill.operators import contracts as C
from lexmill.operators import evaluation as E
from lexmill.operators import history as H
from lexmill.sources import readers as R
from lexmill.streaming import corrections as S

TEXTS = "id string, passage_text string, word_count string, part string"
ASKED = "id string, passage_id string, sequence string, question_text string, correct_answer string, accepted_answers string, choice_a string, choice_b string, choice_c string, choice_d string"


def _questions(of, n=5):
    return [(f"{of}-{i}", of, str(i), "why?", "Yes", "no| YES ", "yes", "no", "maybe", None) for i in range(1, n + 1)]


def test_passages_and_questions(spark):
    texts = [("a", "It's a cat.", "3", "x"), ("b", " ", "0", None), ("c", None, "many", None), (None, "one", "2", None), ("d", "one", "1", None), ("d", "one", "1", None)]
    asked = [*_questions("a"), *_questions("b", 4), *_questions("c", 4), ("c-9", "c", "4", "", None, None, "x", "x", "x", "x"), *_questions("d"), ("z", None, None, "q", "x", "x", "x", "X", "", ""), ("a-1", "gone", "1", "q", "x", "x", "x", "", "", "")]
    got = sorted(tuple(r) for r in C.passages(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(asked, ASKED)).collect())
    assert got == sorted([
        ("passage", "b", "blank_passage"), ("passage", "c", "blank_passage"), ("passage", "c", "word_count_not_a_number"), ("passage", "", "blank_id"), ("passage", "", "word_count_differs"), ("passage", "d", "duplicate_id"),
        ("passage", "b", "not_five_questions"), ("passage", "b", "sequences_differ"), ("passage", "c", "sequences_differ"),
        ("question", "c-9", "blank_question"), ("question", "c-9", "blank_answer"), ("question", "c-9", "answer_not_one_choice"),
        ("question", "z", "answer_not_one_choice"), ("question", "z", "no_such_passage"), ("question", "a-1", "no_such_passage"), ("question", "a-1", "duplicate_id"),
    ])
    none = C.passages(spark.createDataFrame([], TEXTS), spark.createDataFrame([], ASKED))
    assert none.count() == 0


def test_a_bank_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "items.csv").write_text('id,"te ""x"" t"\n1,a\n')
    (tmp_path / "sub" / "rules.csv").write_text("id,kind\n")
    (tmp_path / "other.csv").write_text("x\n")
    got = C.bank(spark, str(tmp_path), {"items.csv": ["id", 'te "x" t'], "rules.csv": ["id", "text"]}, ["items.csv", "sub/rules.csv", "need.csv"], ["may.csv", "other.csv"])
    assert got == {"missing_required": ["need.csv"], "missing_optional": ["may.csv"], "column_errors": [{"file": "rules.csv", "missing_columns": ["text"]}], "without_schema": ["other.csv"], "ok": False}


def test_rows_of_training(spark):
    rows = spark.createDataFrame([("", "b", "letters", "train", "1"), ("bb", None, "letters", "train", "x"), (None, None, "speech", "train", None), ("a b", None, "speech", "train", "0.1"), ("a", None, "speech", "train", "99"), ("a", None, None, "test", "99")], "text string, letter string, dataset string, split string, duration_seconds string")
    got = [(r.text, r.prompt_type, r.reason) for r in C.training_rows(rows, ("letters",)).collect()]
    assert got == [("B", "letter", None), ("BB", "word", "invalid_letter"), ("", "sentence", "missing_text"), ("a b", "sentence", "shorter"), ("a", "word", "longer"), ("a", "word", None)]
    taken = spark.createDataFrame([("p", "t", "s", None), ("p", "t", "s", "0.1"), ("", "t", "s", "1"), ("p", None, "s", "1"), ("p", "t", "u", "15")], "audio_path string, text string, dataset string, duration_seconds string")
    assert C.for_stage(taken, "s").count() == 1 and C.for_stage(taken, "mixed").count() == 2


def test_levels_to_draw_from(spark):
    rows = [(0, 0, 0, 0.0, "hard"), (5, 3, 0, 0.2, "very_hard"), (5, 0, 0, 0.8, "easy"), (5, 0, 2, 0.7, "very_easy"), (5, 0, 1, 0.4, None), (5, 1, 0, 0.6, "odd")]
    s = spark.createDataFrame(rows, "attempts int, correct_streak int, wrong_streak int, recent_accuracy double, level string")
    got = [(r.adjustment, r.targets, r.reason) for r in H.target_levels(s).collect()]
    assert got == [
        ("same", ["very_easy", "easy"], "no_history_baseline"), ("increase", ["very_hard", "very_hard", "hard"], "correct_streak_3"), ("increase", ["medium", "medium", "easy", "hard"], "high_recent_accuracy"),
        ("decrease", ["very_easy", "very_easy", "easy"], "incorrect_streak_2"), ("decrease", ["very_easy", "very_easy", "easy"], "low_recent_accuracy"), ("same", ["easy", "very_easy", "medium"], "steady_recent_accuracy"),
    ]


def test_short_words_by_sound_and_by_name(spark):
    rows = spark.createDataFrame([("Cat", "cat"), ("she", "see"), ("box", ""), ("knee", "nee"), ("eat", "eat"), (None, "x"), ("mat", "map")], "ref string, hyp string")
    lexicon = spark.createDataFrame([("box", 1, ["B", "AA1", "K", "S"]), ("mat", 2, ["M"]), ("mat", 1, ["M", "AE", "T"]), ("eat", 1, ["IY", "T"])], "word string, variant int, phones array<string>")
    got = E.cvc_words(rows).first()
    assert (got.rows, got.exact_rate, got.blank_rate, got.near_rate) == (3, 0.333333, 0.333333, 0.333333)
    got = E.cvc_words(rows, lexicon).first()
    assert (got.rows, got.exact_rate, got.blank_rate, got.near_rate) == (2, 0.5, 0.0, 0.5)
    assert E.keywords(rows).first().rows == 2 and E.keywords(rows.limit(0)).first().exact_rate == 0.0


def test_scores_of_utterances(spark, tmp_path):
    said = {
        "u1": {"text": " HI YOU ", "speaker": "1", "age": 9, "total": 8, "words": [{"text": "HI", "total": 10, "phones": ["HH", "AY"], "phones-accuracy": [2.0, 1.0]}, {"text": "YOU", "total": 7, "phones": ["Y"], "phones-accuracy": [1.7], "mispronunciations": ["x"]}]},
        "u2": {"text": "", "words": []}, "u3": {"text": "A", "words": None},
    }
    (tmp_path / "train.json").write_text(json.dumps(said))
    rows = R.objects(spark, str(tmp_path / "train.json"), R.UTTERANCE)
    audio = spark.createDataFrame([("u1", "b/u1.wav"), ("u1", "a/u1.wav"), ("u3", "u3.wav")], "stem string, path string")
    got = {r.id: r for r in R.scored_utterances(rows, audio, spark.createDataFrame([("u1",), ("u1",)], "id string")).collect()}
    one = got["u1"]
    assert (one.word_score, one.phoneme_score, one.row_status, one.audio_path, one.notes) == (8.5, 1.567, "ok", "a/u1.wav", "score_detail_available")
    assert [w["mispronunciations"] for w in json.loads(one.phoneme_labels)] == [[], ["x"]] and json.loads(one.word_labels)[0]["total"] == 10
    assert (got["u2"].row_status, got["u2"].word_score) == ("missing_audio|missing_transcript|missing_scores", None) and got["u3"].row_status == "missing_scores"
    assert len(got) == 3 and R.scored_utterances(rows, audio).where("notes <> ''").count() == 0


def test_token_accuracy_and_ranking(spark):
    rows = [(1, "a b c d", "a x c d"), (1, "a b c d", "a x c d"), (2, "a b", "b a"), (3, "", "x"), (4, "one", None), (5, "a a b", "a a b"), (6, None, None)]
    got = E.token_accuracy(spark.createDataFrame(rows, "id int, ref string, hyp string")).first()
    want = [sum(m.size for m in difflib.SequenceMatcher(a=r.split(), b=(h or "").split()).get_matching_blocks()) / len(r.split()) for _, r, h in rows if r]
    assert (got.evaluated, got.token_accuracy) == (5, round(sum(want) / 5, 6))
    rates = spark.createDataFrame([("b", 0.2, 0.1), ("a", 0.2, 0.1), ("c", 0.2, 0.05), ("d", None, 0.0), ("e", 0.1, 0.9)], "m string, wer double, cer double")
    assert [r.m for r in E.ranking(rates, "m", "wer", "cer").orderBy("place").collect()] == ["e", "c", "a", "b", "d"]


def test_vocabularies_of_decoders(spark):
    assert N.vocabulary_faults({"_": 0, "|": 1, "a": 2}, 3, "_", "|") == []
    assert N.vocabulary_faults({"_": 0, "a": 5, "b": 5}, 3, "_", "|") == ["no_separator", "repeated_place", "place_beyond_frame", "place_without_label"]
    row = spark.createDataFrame([([0.5, 0.4, 0.1],), (None,), ([],)], "v array<double>").select(N.masked(F.col("v"), [0, 9]).alias("m")).collect()
    assert [r.m for r in row] == [[float("-inf"), 0.4, 0.1], None, []]


def test_indexes_rows_and_counts(spark, tmp_path):
    one = spark.createDataFrame([("k", 1.5, None), (None, float("nan"), [1])], "id string, x double, l array<int>")
    assert [tuple(r) for r in R.cleaned(one).collect()] == [("k", "1.5", ""), ("", "", "[1]")]
    index = R.unified([one.select("id", "x")], {"key": ("id",)})
    told = R.parsed_index(index.unionByName(spark.createDataFrame([("z", "{cut"), ("y", " "), ("w", None)], "key string, metadata string"))).collect()
    assert [r.metadata for r in told if r.key == "k"] == [{"id": "k", "x": "1.5"}]
    assert {r.key: r.metadata for r in told if r.key in ("w", "y", "z")} == {"z": {"raw": "{cut"}, "y": {}, "w": {}}
    for name, n in (("a", 3), ("b", 5)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "p" / name))
    assert sorted(r["rows"] for r in R.parquet_counts(spark, str(tmp_path / "p")).collect()) == [3, 5]


def test_steps_go_on_where_they_stopped(spark, tmp_path):
    todo, out, seen = spark.range(100).withColumnRenamed("id", "k"), str(tmp_path / "out"), []

    def work(rows):
        if len(seen) == 3:
            raise RuntimeError("lost")
        seen.append(1)
        return rows.withColumn("twice", F.col("k") * 2)

    with pytest.raises(RuntimeError):
        S.in_steps(todo, "k", work, out)
    seen.append(1)
    assert S.in_steps(todo, "k", work, out) == 5 and S.in_steps(todo, "k", work, out) == 0
    assert sorted((r.k, r.twice) for r in spark.read.parquet(out).collect()) == [(i, 2 * i) for i in range(100)]
