"""Queries: contracts of content, training rows and tags, with the tables' own columns in their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import frames as N
from lexmill.operators import contracts as C
from lexmill.operators import evaluation as E
from lexmill.operators import history as H
from lexmill.plans.common import ATTEMPTS, SCORED, Registry, attempts, pairs, table
from lexmill.plans.learning import STREAKS

R = Registry()


@R.add("""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 97 = 0 THEN ' ' ELSE o_orderpriority END AS txt, CASE o_orderstatus WHEN 'P' THEN 'two' WHEN 'O' THEN '3' ELSE '2' END AS declared FROM orders),
    q AS (SELECT concat(l_orderkey, '-', l_linenumber) AS id, CAST(l_orderkey AS VARCHAR) AS passage_id, l_linenumber AS seq, lower(l_returnflag) AS answer, lower(l_linestatus) AS other FROM lineitem),
    links AS (SELECT p.id, count(q.id) AS n, count(DISTINCT CASE WHEN q.seq BETWEEN 1 AND 5 THEN q.seq END) AS k FROM (SELECT DISTINCT id FROM p) p LEFT JOIN q ON q.passage_id = p.id GROUP BY p.id),
    dup AS (SELECT id FROM q GROUP BY id HAVING count(*) > 1)
    SELECT 'passage' AS part, id, 'blank_passage' AS error FROM p WHERE trim(txt) = ''
    UNION ALL SELECT 'passage', id, 'word_count_not_a_number' FROM p WHERE TRY_CAST(declared AS INTEGER) IS NULL
    UNION ALL SELECT 'passage', id, 'word_count_differs' FROM p WHERE len(regexp_extract_all(txt, '[A-Za-z0-9]+')) <> TRY_CAST(declared AS INTEGER)
    UNION ALL SELECT 'passage', id, 'not_five_questions' FROM links WHERE n <> 5
    UNION ALL SELECT 'passage', id, 'sequences_differ' FROM links WHERE n <> 5 OR k <> 5
    UNION ALL SELECT 'question', id, 'answer_not_one_choice' FROM q WHERE CAST(answer = other AS INTEGER) + CAST(answer = 'n' AS INTEGER) + CAST(answer = 'o' AS INTEGER) + CAST(answer = 'f' AS INTEGER) <> 1
    UNION ALL SELECT 'question', id, 'answer_not_accepted' FROM q WHERE answer NOT IN (other, 'n')
    UNION ALL SELECT 'question', id, 'no_such_passage' FROM q WHERE passage_id NOT IN (SELECT id FROM p)
    UNION ALL SELECT 'question', id, 'duplicate_id' FROM dup""")
def contract_passages(spark, d):
    """Orders as passages, their lines as questions."""
    status = F.col("o_orderstatus")
    text = F.when(F.col("o_custkey") % 97 == 0, " ").otherwise(F.col("o_orderpriority"))
    passages = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("passage_text"), F.when(status == "P", "two").when(status == "O", "3").otherwise("2").alias("word_count"))
    questions = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("passage_id"), F.col("l_linenumber").alias("sequence"), F.col("l_returnflag").alias("question_text"),
        F.col("l_returnflag").alias("correct_answer"), F.concat_ws("|", "l_linestatus", F.lit("n")).alias("accepted_answers"),
        F.col("l_linestatus").alias("choice_a"), F.lit("N").alias("choice_b"), F.lit("O").alias("choice_c"), F.lit("F").alias("choice_d"),
    )
    return C.passages(passages, questions)


@R.add("""WITH m AS (SELECT CAST(p_partkey // 2 * 2 + CASE WHEN p_size > 45 THEN 0 ELSE p_partkey % 2 END AS VARCHAR) AS id, p_brand, p_type AS activity, CASE WHEN p_size = 7 THEN '' ELSE split_part(p_name, ' ', 1) END AS expected, p_name, p_size > 40 AS mastery FROM part)
    SELECT id, 'wrong_module' AS error FROM m WHERE p_brand <> 'Brand#13' UNION ALL SELECT id, 'unknown_activity' FROM m WHERE activity NOT IN ('PROMO', 'ECONOMY', 'mastery_check') UNION ALL SELECT id, 'blank_expected' FROM m WHERE expected = ''
    UNION ALL SELECT id, 'expected_not_accepted' FROM m WHERE expected = '' OR NOT list_contains(string_split(p_name, ' '), expected) UNION ALL SELECT id, 'wrong_mastery_flag' FROM m WHERE mastery
    UNION ALL SELECT id, 'duplicate_id' FROM m GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT a, 'wrong_count' FROM (VALUES ('PROMO', 10), ('ECONOMY', 20), ('mastery_check', 5)) v(a, due) WHERE due <> (SELECT count(*) FROM m WHERE activity = a)""")
def contract_module(spark, d):
    """Parts as a module's items."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        (F.floor(k / 2) * 2 + F.when(F.col("p_size") > 45, 0).otherwise(k % 2)).alias("prompt_id"), F.col("p_brand").alias("module_key"), F.col("p_type").alias("activity_type"), F.col("p_name").alias("prompt_text"),
        F.when(F.col("p_size") == 7, "").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("expected_text"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("accepted_answers"), (F.col("p_size") > 40).alias("is_mastery_item"),
    )
    return C.module(rows, {"PROMO": 10, "ECONOMY": 20, "mastery_check": 5}, "Brand#13")


@R.add("""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'letters' ELSE 'speech' END AS dataset, CASE WHEN l_linenumber <= 5 THEN 'train' ELSE 'test' END AS split,
        trim(CASE l_linenumber WHEN 1 THEN ' ' WHEN 2 THEN concat(l_returnflag, ' x') ELSE concat(' ', lower(l_returnflag)) END) AS raw, CASE WHEN l_tax > 0 THEN l_quantity / 3 END AS seconds, l_discount > 0 AS found FROM lineitem),
    f AS (SELECT *, CASE WHEN dataset = 'letters' THEN upper(raw) ELSE raw END AS text FROM l)
    SELECT l_orderkey, l_partkey, l_linenumber, text, CASE WHEN regexp_matches(text, '^[A-Z]$') THEN 'letter' WHEN text <> '' AND text NOT LIKE '% %' THEN 'word' ELSE 'sentence' END AS prompt_type,
        CASE WHEN dataset = 'letters' AND NOT regexp_matches(text, '^[A-Z]$') THEN 'invalid_letter' WHEN text = '' THEN 'missing_text' WHEN split = 'train' AND seconds < 1 THEN 'shorter' WHEN split = 'train' AND seconds > 15 THEN 'longer' WHEN NOT found THEN 'missing_audio' END AS reason FROM f""")
def quality_training_rows(spark, d):
    """Lines as recordings of letters and of speech."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", n, F.when(F.col("l_linestatus") == "O", "letters").otherwise("speech").alias("dataset"), F.when(n <= 5, "train").otherwise("test").alias("split"),
        F.when(n == 1, " ").when(n == 2, F.concat(flag, F.lit(" x"))).otherwise(F.concat(F.lit(" "), F.lower(flag))).alias("text"), F.when(F.col("l_tax") > 0, F.col("l_quantity") / 3).alias("duration_seconds"), (F.col("l_discount") > 0).alias("found"),
    )
    return C.training_rows(rows, ("letters",), 1.0, 15.0).select("l_orderkey", "l_partkey", "l_linenumber", "text", "prompt_type", "reason")


@R.add(f"""WITH {ATTEMPTS}, {STREAKS}, s AS (SELECT learner, skill = 'error' AS unclear, correct_streak AS r, wrong_streak AS w, recent_accuracy AS a, list_position(['very_easy', 'easy', 'medium', 'hard', 'very_hard'], (['easy', 'medium', 'none', 'very_hard'])[CAST(learner % 4 AS INTEGER) + 1]) AS p FROM streaks JOIN frame USING (learner) JOIN latest USING (learner) WHERE rn = 1),
    u AS (SELECT *, NOT unclear AND (r >= 3 OR a >= 0.8) AS up, NOT unclear AND NOT (r >= 3 OR a >= 0.8) AND (w >= 2 OR a < 0.5) AS down, CAST(coalesce(p, 2) AS INTEGER) AS pos FROM s),
    t AS (SELECT *, greatest(1, least(5, pos + CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END)) AS there FROM u),
    n AS (SELECT *, ['very_easy', 'easy', 'medium', 'hard', 'very_hard'] AS names FROM t)
    SELECT learner, CASE WHEN up THEN 'increase' WHEN down THEN 'decrease' ELSE 'same' END AS adjustment,
        array_to_string(list_filter([CASE WHEN up OR down THEN names[there] END, names[there], CASE WHEN there > 1 THEN names[there - 1] END, CASE WHEN there < 5 THEN names[there + 1] END], lambda x: x IS NOT NULL), ',') AS targets,
        CASE WHEN unclear THEN 'unclear_asr_retry_before_level_change' WHEN up AND r >= 3 THEN concat('correct_streak_', r) WHEN up THEN 'high_recent_accuracy' WHEN down AND w >= 2 THEN concat('incorrect_streak_', w) WHEN down THEN 'low_recent_accuracy' ELSE 'steady_recent_accuracy' END AS reason FROM n""")
def history_target_levels(spark, d):
    s = H.summary(attempts(spark, d))
    levels = F.array(*map(F.lit, ("easy", "medium", "none", "very_hard")))
    s = s.withColumns({"level": F.get(levels, (F.col("learner") % 4).cast("int")), "latest_error": F.when(F.col("latest_skill") == "error", "unclear_asr")})
    return H.target_levels(s, latest_error="latest_error").select("learner", "adjustment", F.array_join("targets", ",").alias("targets"), "reason")


@R.add("""WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS family, p_size, p_type, p_brand, CASE p_partkey % 5 WHEN 0 THEN 'vowel_sound' WHEN 1 THEN 'word_family' WHEN 2 THEN 'comprehension' WHEN 3 THEN '' END AS f, CASE WHEN p_size < 10 THEN 'easy' WHEN p_size < 30 THEN 'hard' WHEN p_size < 40 THEN '' END AS l FROM part),
    q AS (SELECT *, coalesce(nullif(f, ''), 'unknown') AS focus, coalesce(nullif(l, ''), 'medium') AS level, CASE WHEN p_type = 'PROMO' OR p_size = 50 THEN 'mastery_check' WHEN p_brand = 'Brand#13' THEN 'assessment' WHEN coalesce(f, '') <> '' THEN 'practice' ELSE 'unknown' END AS practice_role FROM p)
    SELECT p_partkey, concat(focus, '_', level) AS adaptive_bucket, CASE focus WHEN 'vowel_sound' THEN 'vowel_error' WHEN 'word_family' THEN 'word_family_error' ELSE 'incorrect_general' END AS recommended_for_error_type,
        CASE focus WHEN 'vowel_sound' THEN 'high' WHEN 'unknown' THEN 'low' ELSE 'medium' END AS remediation_priority, practice_role, practice_role = 'mastery_check' AND p_size % 7 <> 0 AND level <> 'hard' AS mastery_candidate,
        level <> 'hard' AND p_size % 7 <> 0 AS review_candidate, CASE WHEN focus = 'vowel_sound' THEN 3 ELSE 1 END AS min_required_attempts, concat(focus, ':', CASE WHEN p_size > 25 THEN family ELSE 'general' END) AS cooldown_group FROM q""")
def content_adaptive_tags(spark, d):
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    items = table(spark, d, "part").select(
        "p_partkey", F.when(k == 0, "vowel_sound").when(k == 1, "word_family").when(k == 2, "comprehension").when(k == 3, "").alias("error_focus"),
        F.when(size < 10, "easy").when(size < 30, "hard").when(size < 40, "").alias("difficulty_level"), F.when(F.col("p_type") == "PROMO", "Mastery_Check").alias("activity_type"),
        F.when(F.col("p_brand") == "Brand#13", "assessment").alias("source_group"), (size == 50).alias("is_mastery_item"), (size % 7 == 0).alias("needs_manual_review"),
        F.lit(None).cast("string").alias("target_phoneme"), F.when(size > 25, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("word_family"),
    )
    return C.adaptive_tags(items).drop("error_focus", "difficulty_level", "activity_type", "source_group", "is_mastery_item", "needs_manual_review", "target_phoneme", "word_family")


@R.add("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN i IN (1, 3, 6) THEN CAST('-inf' AS DOUBLE) ELSE x END) AS v FROM e)
    SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS label FROM m""")
def frames_masked(spark, d):
    """The best label of vectors taken as frames, without three that are suppressed."""
    e = table(spark, d, "embeddings").select("vec_id", N.masked(N.doubles(F.col("embedding")), [0, 2, 5]).alias("v"))
    return e.select("vec_id", N.argmax(F.col("v")).alias("label"))


@R.add()
def report_token_accuracy(spark, d):
    return E.token_accuracy(pairs(spark, d), "brand")


@R.add(f"""WITH {SCORED}, g AS (SELECT brand, round(avg(wer), 6) AS wer, round(avg(cer), 6) AS cer FROM scored GROUP BY brand)
    SELECT brand, wer, cer, CAST(row_number() OVER (ORDER BY wer, cer, brand) AS INTEGER) AS place FROM g""")
def report_ranking(spark, d):
    """Brands as models, by word and then letter error rate."""
    return E.ranking(E.macro(pairs(spark, d), "brand").select("brand", "wer", "cer"), "brand", "wer", "cer")
