"""What tables of content must keep to: modules, passages with their questions, training rows, tags. Errors are rows.

Every check is a condition of a row or a count by key that combines before the shuffle; no group is collected. Null counts
as blank, and texts are compared without case. Columns that a contract does not name are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.quality import all_reasons

CHOICES = ("choice_a", "choice_b", "choice_c", "choice_d")
QUESTIONS = 5


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _among(value: Column, barred: Column) -> Column:
    """Whether a lower-cased value is one of those between bars."""
    return F.array_contains(F.transform(F.split(barred, r"\|"), lambda x: F.lower(F.trim(x))), value)


def _said(rows: DataFrame, key: Column, *rules: tuple[str, Column]) -> DataFrame:
    return rows.select(key.alias("id"), F.explode(all_reasons(*rules)).alias("error"))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """(id, error) once for each id that several rows have."""
    return rows.where(_text(key) != "").groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("error"))


def passages(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """(part, id, error) of passages and their questions.

    texts: id, passage_text, word_count. questions: id, passage_id, sequence, question_text, correct_answer,
    accepted_answers (between bars), choice_a to choice_d. Every passage has five questions, 1 to 5 in sequence; the correct
    answer is one choice and no more, and accepted. A row that breaks several rules has a row for each. An id that several
    passages have counts its questions once.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    declared = F.col("word_count").cast("string").try_cast("int")
    blank = _text("passage_text") == ""
    of_texts = _said(
        texts, key, ("blank_id", T.blank("id")), ("blank_passage", blank), ("word_count_not_a_number", declared.isNull()),
        ("word_count_differs", F.size(F.regexp_extract_all(_text("passage_text"), F.lit(f"({T.WORD})"), 1)) != declared),
    )
    answer = F.lower(_text("correct_answer"))
    hits = reduce(lambda a, b: a + b, [(F.lower(_text(c)) == answer).cast("int") for c in CHOICES])
    of_questions = _said(
        questions, key, ("blank_id", T.blank("id")), ("blank_question", _text("question_text") == ""), ("blank_answer", answer == ""), ("answer_not_one_choice", hits != 1),
        ("answer_not_accepted", ~_among(answer, F.coalesce("accepted_answers", F.lit("")))),
    )
    ids = texts.select(F.col("id").cast("string").alias("__id")).where("__id is not null").distinct()
    linked = questions.withColumn("__of", F.col("passage_id").cast("string"))
    astray = linked.join(ids, F.col("__of") == F.col("__id"), "left_anti").select(key.alias("id"), F.lit("no_such_passage").alias("error"))
    once = [(F.count_if(F.trim(F.col("sequence").cast("string")) == str(i)) == 1).alias(f"__{i}") for i in range(1, QUESTIONS + 1)]
    met = ids.join(linked.groupBy("__of").agg(F.count("*").alias("__n"), *once), F.col("__id") == F.col("__of"), "left")
    n = F.coalesce("__n", F.lit(0))
    in_order = reduce(lambda a, b: a & b, [F.coalesce(f"__{i}", F.lit(False)) for i in range(1, QUESTIONS + 1)])
    of_links = _said(met, F.col("__id"), ("not_five_questions", n != QUESTIONS), ("sequences_differ", ~in_order | (n != QUESTIONS)))
    both = of_texts.unionByName(_repeated(texts, "id")).unionByName(of_links).withColumn("part", F.lit("passage"))
    return both.unionByName(of_questions.unionByName(_repeated(questions, "id")).unionByName(astray).withColumn("part", F.lit("question"))).select("part", "id", "error")


def module(rows: DataFrame, counts: dict[str, int], module_key: str | None = None) -> DataFrame:
    """(id, error) of a module's items; an activity's wrong number of rows is an error under the activity's name.

    rows: prompt_id, module_key, activity_type, prompt_text, expected_text, accepted_answers (between bars), is_mastery_item.
    """
    activity, expected = F.coalesce("activity_type", F.lit("")), F.lower(_text("expected_text"))
    of_rows = _said(
        rows, F.coalesce(F.col("prompt_id").cast("string"), F.lit("")), ("wrong_module", ~F.col("module_key").eqNullSafe(module_key) if module_key else F.lit(False)),
        ("unknown_activity", ~activity.isin(*counts)), ("blank_activity", activity == ""), ("blank_prompt", _text("prompt_text") == ""), ("blank_expected", expected == ""),
        ("expected_not_accepted", (expected == "") | ~_among(expected, F.coalesce("accepted_answers", F.lit("")))),
        ("wrong_mastery_flag", T.truthy(F.col("is_mastery_item").cast("string")) != (activity == "mastery_check")),
    )
    due = rows.sparkSession.createDataFrame(list(counts.items()), "activity string, due long")
    there = rows.groupBy(activity.alias("activity")).agg(F.count("*").alias("n"))
    wrong = F.broadcast(due).join(there, "activity", "left").where(F.coalesce("n", F.lit(0)) != F.col("due"))
    return of_rows.unionByName(_repeated(rows, "prompt_id")).unionByName(wrong.select(F.col("activity").alias("id"), F.lit("wrong_count").alias("error")))


def bank(spark, path: str, schemas: dict[str, list[str]], required: list[str], optional: list[str]) -> dict:
    """Which files of a content bank are missing, which lack columns, which have no schema. Of tables only the header is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    there = lambda name: system.exists(jvm.org.apache.hadoop.fs.Path(root, name))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path).select("path")
    errors, unknown = [], []
    for at in sorted(r["path"] for r in files.toLocalIterator()):
        name = at.rsplit("/", 1)[1]
        if name not in schemas:
            unknown.append(name)
        elif gone := [c for c in schemas[name] if c not in spark.read.csv(at, header=True, escape='"').columns]:
            errors.append({"file": name, "missing_columns": gone})
    missing = [n for n in required if not there(n)]
    return {"missing_required": missing, "missing_optional": [n for n in optional if not there(n)], "column_errors": errors, "without_schema": unknown, "ok": not missing and not errors}


def training_rows(rows: DataFrame, letters: tuple[str, ...] = (), least: float = 0.2, most: float = 15.0) -> DataFrame:
    """Adds text in its dataset's form, prompt_type and reason (null: the row is kept).

    rows: text, dataset, split, duration_seconds and, where there is one, letter (read where text is blank) and found
    (whether the audio is there). A text of the ``letters`` datasets is one letter, written large; elsewhere it is not
    blank. Durations bind in training only; null or no number passes.
    """
    spare = F.col("letter") if "letter" in rows.columns else F.lit(None).cast("string")
    plain = F.trim(F.coalesce(F.when(F.coalesce("text", F.lit("")) != "", F.col("text")), spare, F.lit("")))
    is_letters = F.coalesce(F.col("dataset").isin(*letters), F.lit(False)) if letters else F.lit(False)
    form = F.when(is_letters, F.upper(plain)).otherwise(plain)
    seconds, binds = T.number(F.col("duration_seconds").cast("string")), F.col("split").eqNullSafe("train")
    found = F.coalesce("found", F.lit(False)) if "found" in rows.columns else F.lit(True)
    kind = F.when(form.rlike("^[A-Z]$"), "letter").when(F.size(F.regexp_extract_all(form, F.lit(r"(\S+)"), 1)) == 1, "word").otherwise("sentence")
    reason = (
        F.when(is_letters & ~form.rlike("^[A-Z]$"), "invalid_letter").when(form == "", "missing_text").when(binds & (seconds < least), "shorter")
        .when(binds & (seconds > most), "longer").when(~found, "missing_audio")
    )
    return rows.withColumns({"__form": form, "__kind": kind, "__why": reason}).drop("text", "prompt_type", "reason").withColumnsRenamed({"__form": "text", "__kind": "prompt_type", "__why": "reason"})


def for_stage(rows: DataFrame, stage: str, least: float = 0.2, most: float = 15.0) -> DataFrame:
    """Rows that a stage of training takes: its dataset's (all for ``mixed``), with audio and text, and a duration within the limits or none."""
    seconds = T.number(F.col("duration_seconds").cast("string"))
    mine = F.lit(True) if stage == "mixed" else F.col("dataset").eqNullSafe(stage)
    return rows.where(mine & (_text("audio_path") != "") & (_text("text") != "") & (seconds.isNull() | seconds.between(least, most)))


#: The error that practice of a focus is for, and what is practised before the rest.
ERROR_BY_FOCUS = {
    "final_consonant": "final_sound_error", "initial_consonant": "initial_sound_error", "vowel_sound": "vowel_error", "sentence_tracking": "skipped_word", "fluency_pacing": "partial_sentence",
    "comprehension_detail": "comprehension_detail_error", "comprehension_inference": "comprehension_inference_error", "word_family": "word_family_error",
}
FOCUSED = ("final_consonant", "initial_consonant", "vowel_sound", "sentence_tracking", "fluency_pacing")


def adaptive_tags(rows: DataFrame) -> DataFrame:
    """Adds how an item is offered. rows: error_focus, difficulty_level, activity_type, source_group, is_mastery_item, needs_manual_review, target_phoneme, word_family."""
    or_else = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    focus, level = or_else("error_focus", F.lit("unknown")), or_else("difficulty_level", F.lit("medium"))
    review = T.truthy(F.coalesce(F.col("needs_manual_review").cast("string"), F.lit("")))
    mastery = T.truthy(F.coalesce(F.col("is_mastery_item").cast("string"), F.lit(""))) | F.coalesce(F.lower("activity_type").contains("mastery"), F.lit(False))
    role = F.when(mastery, "mastery_check").when(F.lower("source_group").eqNullSafe("assessment"), "assessment").when(focus != "unknown", "practice").otherwise("unknown")
    meant = F.create_map(*[F.lit(x) for pair in ERROR_BY_FOCUS.items() for x in pair])
    focused = focus.isin(*FOCUSED)
    return rows.withColumns({
        "adaptive_bucket": F.concat_ws("_", focus, level), "recommended_for_error_type": F.coalesce(F.element_at(meant, focus), F.lit("incorrect_general")),
        "remediation_priority": F.when(focused, "high").when(focus != "unknown", "medium").otherwise("low"), "practice_role": role,
        "mastery_candidate": (role == "mastery_check") & ~review & ~level.isin("hard", "very_hard"), "review_candidate": level.isin("very_easy", "easy", "medium") & ~review,
        "min_required_attempts": F.when(focused, 3).otherwise(1), "cooldown_group": F.concat_ws(":", focus, or_else("target_phoneme", or_else("word_family", F.lit("general")))),
    })
