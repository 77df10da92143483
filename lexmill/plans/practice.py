"""Queries: feedback and focus, content lookups, checks of manifests, recordings, mixes of training rows. SQL states values anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import frames as A
from lexmill.functions import phonemes as P
from lexmill.functions import text as T
from lexmill.operators import candidates as C
from lexmill.operators import content as N
from lexmill.operators import correction as K
from lexmill.operators import lookup as L
from lexmill.operators import quality as Q
from lexmill.operators import remediation as M
from lexmill.operators import sampling as S
from lexmill.plans.common import FORM, Registry, table

R = Registry()


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


KINDS = ["correct", "accepted_variant", "blank", "initial_sound_error", "final_sound_error", "vowel_error", "consonant_error", "skipped_word", "partial_sentence", "word_order_error", "far_answer", "unclear_asr", "incorrect_general", "unheard_of", ""]
SKILLS = ["final_consonant", "vowel_sound", "fluency_completion", "other", ""]


@R.add(f"""WITH f(error, hint, coach, summary, action) AS (VALUES
    ('correct', 'praise_continue', 'praise_continue', 'Good reading. Keep going.', 'continue'), ('accepted_variant', 'praise_continue', 'praise_continue', 'Good reading. Keep going.', 'continue'),
    ('blank', 'try_answer_first', 'try_answer_first', 'Try saying the answer first.', 'retry'), ('initial_sound_error', 'beginning_sound', 'listen_to_first_sound', 'Listen to the first sound and try again.', 'retry'),
    ('final_sound_error', 'ending_sound', 'listen_to_final_sound', 'Listen to the ending sound and try again.', 'retry'), ('vowel_error', 'middle_sound', 'listen_to_middle_sound', 'Listen to the middle sound and try again.', 'retry'),
    ('consonant_error', 'consonant_sound', 'listen_to_consonant_sound', 'Listen to the consonant sounds and try again.', 'retry'), ('skipped_word', 'read_each_word', 'read_each_word', 'Read each word carefully.', 'retry'),
    ('partial_sentence', 'read_whole_sentence', 'read_whole_sentence', 'Try reading the whole sentence.', 'retry'), ('word_order_error', 'word_order', 'read_in_order', 'Read the words in order.', 'retry'),
    ('far_answer', 'listen_again', 'listen_again', 'Listen again and try once more.', 'retry'), ('unclear_asr', 'try_recording_again', 'try_recording_again', 'Try recording again clearly.', 'retry')),
    c AS (SELECT c_custkey AS id, ({KINDS})[c_custkey % 15 + 1] AS error FROM customer)
    SELECT id, c.error, coalesce(hint, 'try_again_slowly') AS hint, coalesce(coach, 'try_again_slowly') AS coach, coalesce(summary, 'Try again slowly.') AS summary, coalesce(action, 'retry') AS action FROM c LEFT JOIN f ON f.error = c.error""")
def practice_feedback(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _pick(KINDS, F.col("c_custkey") % 15).alias("error"))
    return c.withColumn("f", P.feedback(F.col("error"))).select("id", "error", "f.*")


@R.add(f"""WITH f(kind, primary_focus, target_position, preferred, activities, action, reason) AS (VALUES
    ('final_sound_error', 'final_consonant', 'final', ['final_consonant'], 'display_word_reading|highlighted_sentence_word', 'remediate', 'target_final_sound_error'),
    ('initial_sound_error', 'initial_consonant', 'initial', ['initial_consonant'], 'display_word_reading|first_letter_identification|missing_first_letter', 'remediate', 'target_initial_sound_error'),
    ('vowel_error', 'vowel_sound', 'vowel', ['vowel_sound'], 'display_word_reading|split_word_reading|highlighted_rhyme_word', 'remediate', 'target_vowel_error'),
    ('consonant_error', 'consonant_accuracy', 'consonant', ['initial_consonant', 'final_consonant', 'consonant_blend'], 'display_word_reading|split_word_reading', 'remediate', 'target_consonant_error'),
    ('skipped_word', 'sentence_tracking', 'sentence', ['sentence_tracking'], 'simple_sentence_reading|full_stop_pause_reading', 'practice', 'target_skipped_word'),
    ('partial_sentence', 'fluency_completion', 'sentence', ['fluency_pacing', 'sentence_tracking'], 'comma_pause_reading|mixed_punctuation_fluency', 'practice', 'target_partial_sentence'),
    ('word_order_error', 'sentence_order', 'sentence', ['sentence_tracking'], 'simple_sentence_reading|full_stop_pause_reading', 'practice', 'target_word_order'),
    ('blank', 'retry_or_easier', '', ['initial_consonant', 'vowel_sound'], 'display_word_reading|letter_pair_identification', 'retry_or_easier', 'blank_response'),
    ('unclear_asr', 'retry_recording', '', [], '', 'retry_recording', 'unclear_asr_retry'), ('correct', 'continue_or_increase', '', [], '', 'continue', 'correct_continue'),
    ('accepted_variant', 'continue', '', [], '', 'continue', 'accepted_variant_continue'),
    ('far_answer', 'easier_review', '', ['word_reading', 'sentence_tracking'], 'display_word_reading|simple_sentence_reading|review', 'easier_review', 'far_answer_review'),
    ('general', 'general_review', '', ['word_reading'], 'display_word_reading|review', 'practice', 'general_review')),
    c AS (SELECT c_custkey AS id, ({KINDS})[c_custkey % 15 + 1] AS error, ({SKILLS})[c_nationkey % 5 + 1] AS skill FROM customer),
    k AS (SELECT *, CASE WHEN error IN ('', 'incorrect_general', 'unheard_of') THEN CASE skill WHEN 'final_consonant' THEN 'final_sound_error' WHEN 'vowel_sound' THEN 'vowel_error' WHEN 'fluency_completion' THEN 'partial_sentence' ELSE 'general' END ELSE error END AS kind FROM c)
    SELECT id, error, skill, primary_focus, target_position, array_to_string(CASE WHEN skill <> '' AND NOT list_contains(preferred, skill) THEN list_prepend(skill, preferred) ELSE preferred END, '|') AS preferred, activities, action, reason FROM k JOIN f USING (kind)""")
def practice_focus(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _pick(KINDS, F.col("c_custkey") % 15).alias("error"), _pick(SKILLS, F.col("c_nationkey") % 5).alias("skill"))
    f = c.withColumn("f", M.focus(F.col("error"), F.col("skill")))
    return f.select("id", "error", "skill", "f.primary_focus", "f.target_position", F.array_join("f.preferred_focus", "|").alias("preferred"), F.array_join("f.preferred_activities", "|").alias("activities"), "f.action", "f.reason")


@R.add("""WITH c AS (SELECT c_custkey AS id, (['final_consonant', 'sentence_order', 'easier_review', 'unknown', ''])[c_custkey % 5 + 1] AS f, (['same', 'increase', ''])[c_custkey % 3 + 1] AS a, c_nationkey % 4 AS seen FROM customer)
    SELECT id, 'The learner has ' || CASE WHEN seen >= 2 THEN 'repeated ' ELSE '' END || replace(CASE WHEN f = '' THEN 'general_review' ELSE f END, '_', ' ') || ' needs, so the next item targets that focus at ' || CASE WHEN a = '' THEN 'same' ELSE a END || ' difficulty.' AS teacher,
        CASE f WHEN 'final_consonant' THEN 'Let''s practice the ending sound again.' WHEN 'sentence_order' THEN 'Let''s practice the word order.' WHEN 'easier_review' THEN 'Let''s review with an easier item.' ELSE 'Let''s practice another item.' END AS learner,
        'general_review|' || CASE WHEN a = '' THEN 'same' ELSE a END || '_difficulty' AS reasons FROM c""")
def practice_explained(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _pick(["final_consonant", "sentence_order", "easier_review", "unknown", ""], F.col("c_custkey") % 5).alias("f"), _pick(["same", "increase", ""], F.col("c_custkey") % 3).alias("a"), (F.col("c_nationkey") % 4).alias("seen"))
    e = c.withColumn("e", M.explained(F.col("f"), F.col("a"), F.lit(None).cast("string"), F.col("seen")))
    return e.select("id", "e.teacher", "e.learner", F.array_join("e.reasons", "|").alias("reasons"))


@R.add("""WITH i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'Yes ' WHEN 2 THEN NULL ELSE '' END AS active, CASE WHEN p_partkey % 5 = 0 THEN 'TRUE' END AS review, CASE WHEN p_partkey % 3 > 0 THEN 'hard' END AS level, CASE WHEN p_partkey % 2 = 0 THEN 'vowel_sound' ELSE '' END AS focus, p_type AS skill FROM part)
    SELECT p_partkey, active IS NULL OR active <> 'no' AS is_active, review IS NOT NULL AS needs_manual_review, coalesce(level, 'easy') AS difficulty_level, CASE WHEN focus = '' THEN skill ELSE focus END AS error_focus FROM i""")
def recommend_defaults(spark, d):
    k = F.col("p_partkey")
    items = table(spark, d, "part").select(
        k, F.when(k % 4 == 0, "no").when(k % 4 == 1, "Yes ").when(k % 4 == 3, "").alias("is_active"), F.when(k % 5 == 0, "TRUE").alias("needs_manual_review"),
        F.when(k % 3 > 0, "hard").alias("difficulty_level"), F.when(k % 2 == 0, "vowel_sound").otherwise("").alias("error_focus"), F.col("p_type").alias("skill_signal"),
    )
    return C.with_defaults(items).drop("skill_signal")


@R.add("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_size < 20 AND contains(lower(p_name), lower('RED'))")
def content_found(spark, d):
    found = L.having(table(spark, d, "part"), {"p_type": "PROMO"}, {"p_name": "RED"})
    return found.where("p_size < 20").select("p_partkey", "p_name")


@R.add(f"""WITH q AS (SELECT DISTINCT {FORM.format("upper(p_name) || '!'")} AS f FROM part WHERE p_partkey % 10 = 0), i AS (SELECT {FORM.format('p_name')} AS f, min(p_partkey) AS item FROM part GROUP BY 1) SELECT f, item FROM q JOIN i USING (f)""")
def content_by_text(spark, d):
    part = table(spark, d, "part")
    asked = part.where("p_partkey % 10 = 0").select(F.concat(F.upper("p_name"), F.lit("!")).alias("asked"))
    return L.by_text(asked, "asked", part, "p_name", "p_partkey").select(F.col("form").alias("f"), F.col("p_partkey").alias("item"))


@R.add("""WITH i AS (SELECT p_partkey, (['module_1', 'module_2', 'module_3', ''])[p_partkey % 4 + 1] AS m, (['words.csv', 'comprehension_questions.csv', 'reading_passages.csv'])[p_size % 3 + 1] AS s,
        (['letter_pairs', 'sentence_reading', 'comma_pause_reading', 'rhyme'])[p_size % 4 + 1] AS a, (['', 'multiple_choice', 'rhyme_pick'])[p_partkey % 3 + 1] AS t, (['Why?', 'What comes next?', 'Who?'])[p_size % 3 + 1] AS q FROM part)
    SELECT p_partkey, CASE WHEN s LIKE '%comprehension%' OR t = 'multiple_choice' THEN 'comprehension' WHEN s LIKE '%reading_passages%' THEN 'fluency' WHEN m = 'module_1' OR a LIKE '%letter%' THEN 'letter_sound' WHEN t LIKE '%rhyme%' THEN 'phonemic_awareness' WHEN m = 'module_2' THEN 'word_reading' ELSE 'sentence_reading' END AS skill_group,
        CASE WHEN s LIKE '%comprehension_questions%' OR t = 'multiple_choice' THEN CASE q WHEN 'Why?' THEN 'comprehension_inference' WHEN 'What comes next?' THEN 'sequencing' ELSE 'comprehension_detail' END
        WHEN a = 'sentence_reading' THEN 'sentence_tracking' WHEN a = 'comma_pause_reading' THEN 'fluency_pacing' ELSE 'unknown' END AS focus FROM i""")
def content_skills(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    items = table(spark, d, "part").select(
        k, _pick(["module_1", "module_2", "module_3", ""], k % 4).alias("module_key"), _pick(["words.csv", "comprehension_questions.csv", "reading_passages.csv"], z % 3).alias("source_file"),
        _pick(["letter_pairs", "sentence_reading", "comma_pause_reading", "rhyme"], z % 4).alias("activity_type"), _pick(["", "multiple_choice", "rhyme_pick"], k % 3).alias("task_type"),
        _pick(["Why?", "What comes next?", "Who?"], z % 3).alias("prompt_text"), F.lit("phrase").alias("kind"), F.lit("").alias("pattern"), F.array().cast("array<string>").alias("phones"),
    )
    return items.select("p_partkey", N.skill_group().alias("skill_group"), N.item_focus().alias("focus"))


@R.add("""WITH c AS (SELECT c_custkey, (['true', 'No', ' ACTIVE', '', 'maybe', NULL, '0'])[c_custkey % 7 + 1] AS v, (['1.5', 'x', '', ' 2', NULL])[c_custkey % 5 + 1] AS n FROM customer)
    SELECT c_custkey, coalesce(lower(trim(v)) IN ('1', 'true', 'yes', 'y', 'active'), false) AS yes, CASE WHEN v IS NULL OR v = '' THEN true ELSE lower(trim(v)) NOT IN ('0', 'false', 'no', 'inactive') END AS not_no, TRY_CAST(trim(n) AS DOUBLE) AS number FROM c""")
def text_said(spark, d):
    k = F.col("c_custkey")
    v = F.when(k % 7 != 5, _pick(["true", "No", " ACTIVE", "", "maybe", "", "0"], k % 7))
    n = F.when(k % 5 != 4, _pick(["1.5", "x", "", " 2", ""], k % 5))
    return table(spark, d, "customer").select(k, T.truthy(v).alias("yes"), T.not_denied(v).alias("not_no"), T.number(n).alias("number"))


@R.add(f"""SELECT c_custkey, {FORM.format("c_mktsegment || ' - Um, Row'")} AS cell, replace(replace(lower(trim(' ' || c_mktsegment || '-No Of ')), '-', '_'), ' ', '_') AS header FROM customer""")
def text_cells(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.for_scoring(F.concat("c_mktsegment", F.lit(" - Um, Row"))).alias("cell"), T.header(F.concat(F.lit(" "), "c_mktsegment", F.lit("-No Of "))).alias("header"))


@R.add("""WITH w AS (SELECT c_custkey, (['bee', 'beeee', 'b', 'zih', 'kyy', 'A-y', 'doubleyou', 'seee', ''])[c_custkey % 9 + 1] AS w FROM customer), x AS (SELECT c_custkey, w, (['b#IY', 'b#IY', 'b', 'z#IY', 'ky#IY', 'a#IY', 'doubleyou', 's#IY', ''])[c_custkey % 9 + 1] AS code FROM w) SELECT * FROM x""")
def correct_letter_codes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _pick(["bee", "beeee", "b", "zih", "kyy", "A-y", "doubleyou", "seee", ""], F.col("c_custkey") % 9).alias("w"))
    return c.withColumn("code", K.letter_code(F.col("w")))


@R.add("""WITH p AS (SELECT c_custkey, (['the', 'cat', 'to', 'is', 'of'])[c_custkey % 5 + 1] AS e, (['a', 'the', 'cat', 'to'])[c_nationkey % 4 + 1] AS r FROM customer),
    s AS (SELECT *, e <> r AND e <> 'cat' AND r <> 'cat' AS unsafe, round(greatest(0.0, 1 - levenshtein(e, r) / length(e)), 6) AS support FROM p) SELECT * FROM s""")
def correct_unsafe_pairs(spark, d):
    p = table(spark, d, "customer").select("c_custkey", _pick(["the", "cat", "to", "is", "of"], F.col("c_custkey") % 5).alias("e"), _pick(["a", "the", "cat", "to"], F.col("c_nationkey") % 4).alias("r"))
    return p.withColumns({"unsafe": K.unsafe_pair(F.col("e"), F.col("r")), "support": K.support(F.col("e"), F.col("r"))})


@R.add("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS t, l_tax * 8 AS p, CASE WHEN l_linenumber % 3 = 0 THEN 0.85 ELSE 0.5 END AS lattice, l_quantity > 48 AS exact, l_quantity < 3 AS alias, l_returnflag = 'R' AS confused, CASE WHEN l_linestatus = 'F' THEN l_linenumber % 2 = 0 END AS critical FROM lineitem),
    b AS (SELECT *, greatest(t, p, lattice, CASE WHEN exact THEN 1.0 ELSE 0 END, CASE WHEN alias THEN 0.98 ELSE 0 END, CASE WHEN lattice >= 0.85 THEN 0.93 ELSE 0 END, CASE WHEN confused THEN 0.9 ELSE 0 END) AS x FROM s)
    SELECT l_orderkey, l_linenumber, round(CAST(CASE WHEN critical THEN least(1.0, greatest(x, 0.9) + 0.05) WHEN NOT critical THEN least(x, 0.6) ELSE x END AS DOUBLE), 6) AS score FROM b""")
def correct_composite(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem")
    critical = F.when(c("l_linestatus") == "F", c("l_linenumber") % 2 == 0)
    lattice = F.when(c("l_linenumber") % 3 == 0, 0.85).otherwise(0.5)
    score = K.composite((c("l_discount") * 5).cast("double"), (c("l_tax") * 8).cast("double"), lattice, c("l_quantity") > 48, c("l_quantity") < 3, c("l_returnflag") == "R", critical)
    return rows.select("l_orderkey", "l_linenumber", score.alias("score"))


@R.add("""WITH w(word, n, phones) AS (VALUES ('cat', 1, ['K', 'AE', 'T']), ('at', 1, ['AE', 'T']), ('go', 1, ['G', 'AA']), ('i', 1, ['IH']), ('a cat', 2, ['AE', 'K', 'AE', 'T']), ('-', 0, []))
    SELECT c_custkey, word, CASE word WHEN 'cat' THEN 'vowel_sound' WHEN 'at' THEN 'final_consonant' WHEN 'go' THEN 'initial_consonant' WHEN 'i' THEN 'vowel_sound' WHEN 'a cat' THEN 'word_sequence' END AS focus
    FROM (SELECT c_custkey, (['cat', 'at', 'go', 'i', 'a cat', '-'])[c_custkey % 6 + 1] AS word FROM customer)""")
def phones_focus(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _pick(["cat", "at", "go", "i", "a cat", "-"], F.col("c_custkey") % 6).alias("word"))
    return c.withColumn("focus", P.error_focus(T.word_count("word"), P.spelled(F.regexp_replace("word", "[^a-z]", ""))))


@R.add(f"""WITH t AS (SELECT conv_id * 1000 + turn AS k, text, {FORM.format('text')} AS f FROM conversations), c AS (SELECT * FROM t WHERE f <> text ORDER BY k LIMIT 5)
    SELECT count(*) AS rows, CAST(count_if(coalesce(f, '') = '') AS BIGINT) AS emptied, CAST(count_if(f <> text) AS BIGINT) AS changed, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM c) AS examples FROM t""")
def quality_normalisation_audit(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    out = Q.normalisation_audit(rows, "k", "text", T.for_scoring("text"))
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


DOC_ERRORS = """e AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' END AS a, CASE WHEN n_chars > 5000 THEN 'long' END AS b, CASE WHEN lang IS NULL THEN 'no_lang' END AS c, CASE WHEN n_chars < 100 THEN 'short' END AS w FROM documents)"""


def _doc_rules():
    errors = [("blank", T.blank("text")), ("long", F.col("n_chars") > 5000), ("no_lang", F.col("lang").isNull())]
    return errors, [("short", F.col("n_chars") < 100)]


@R.add(f"""WITH {DOC_ERRORS} SELECT doc_id, concat_ws('|', a, b, c) AS errors, coalesce(w, '') AS warnings, a IS NULL AND b IS NULL AND c IS NULL AS valid FROM e""")
def quality_errors_warnings(spark, d):
    out = Q.errors_and_warnings(table(spark, d, "documents"), *_doc_rules())
    return out.select("doc_id", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "valid")


@R.add(f"""WITH {DOC_ERRORS}, u AS (SELECT unnest([a, b, c]) AS reason FROM e) SELECT reason, count(*) AS n FROM u WHERE reason IS NOT NULL GROUP BY reason""")
def quality_error_counts(spark, d):
    return Q.error_counts(table(spark, d, "documents"), *_doc_rules()[0])


@R.add("""SELECT c_custkey, c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND (c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 50 BETWEEN 1 AND 30)) AS usable FROM customer""")
def quality_usable(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k, F.when(k % 5 > 0, "text").otherwise(" ").alias("text"), F.when(k % 7 > 0, "a.wav").alias("path"), F.when(k % 3 == 1, (k % 50).cast("string")).when(k % 3 == 2, "long").alias("seconds")
    )
    return rows.select("c_custkey", Q.usable("text", "path", "seconds").alias("usable"))


@R.add("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'manual' || s_suppkey END AS manual, 'expected' || s_nationkey AS expected FROM supplier) SELECT s_suppkey, CASE WHEN (SELECT count(manual) FROM s) > 0 THEN manual ELSE expected END AS reference, CASE WHEN (SELECT count(manual) FROM s) > 0 THEN 'manual' ELSE 'expected' END AS reference_column FROM s""")
def quality_reference_column(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k, F.when(k % 4 == 0, F.concat(F.lit("manual"), k)).alias("manual"), F.concat(F.lit("expected"), "s_nationkey").alias("expected"))
    return Q.with_reference(rows, "manual", "expected").select("s_suppkey", "reference", "reference_column")


@R.add("""WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'test' WHEN o_orderstatus = 'O' THEN 'validation' ELSE 'train' END AS split, o_orderkey % 11 = 0 AS gone, o_orderkey % 13 = 0 AS blank, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 30 ELSE 0 END AS s FROM orders)
    SELECT split, count(*) AS rows, round(sum(s) / 3600::DOUBLE, 6) AS hours, CAST(count_if(gone) AS BIGINT) AS missing_audio, CAST(count_if(blank) AS BIGINT) AS blank_text FROM r GROUP BY ROLLUP (split)""")
def quality_split_summary(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "test").when(F.col("o_orderstatus") == "O", "validation").otherwise("elsewhere").alias("part"),
        F.when(k % 11 > 0, "a.wav").alias("audio"), F.when(k % 13 > 0, "x").otherwise(" ").alias("text"), F.when(k % 4 > 0, (k % 30).cast("string")).otherwise("none").alias("seconds"),
    )
    return Q.split_summary(rows, "part", "audio", "text", "seconds")


@R.add("""SELECT count(*) AS rows, CAST(count_if(s_suppkey IS NULL) AS BIGINT) AS missing, round(avg(CASE WHEN s_suppkey IS NULL THEN 1 ELSE 0 END), 6) AS rate FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def quality_missing_rate(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("audio/"), "c_custkey").alias("path"))
    return Q.missing_rate(rows, "path", table(spark, d, "supplier").select(F.concat(F.lit("audio/"), "s_suppkey").alias("path")))


@R.add("""WITH p AS (SELECT l_orderkey, unnest([l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END]) AS x FROM lineitem), a AS (SELECT l_orderkey, round(avg(CAST(x AS DOUBLE)), 3) AS phones FROM p GROUP BY 1), b AS (SELECT l_orderkey, round(avg(CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS DOUBLE) END), 3) AS words FROM lineitem GROUP BY 1)
    SELECT l_orderkey, phones, words FROM a JOIN b USING (l_orderkey)""")
def quality_nested_means(spark, d):
    word = F.struct(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("string")).otherwise("n/a").alias("total"),
        F.array(F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise("-")).alias("phones"),
    )
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(word).alias("words"))
    return rows.select("l_orderkey", A.mean_of(F.flatten(F.transform("words", lambda w: w["phones"]))).alias("phones"), A.mean_of(F.transform("words", lambda w: w["total"])).alias("words"))


VOICED = """v AS (SELECT vec_id, embedding AS e, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0.02 THEN '1' ELSE '0' END), '') AS m FROM embeddings),
    s AS (SELECT vec_id, e, regexp_extract_all(m, '1{3,}') AS runs FROM v), f AS (SELECT vec_id, e, CAST(len(runs) AS INTEGER) AS segments, CAST(coalesce(list_sum(list_transform(runs, lambda r: length(r))), 0) AS INTEGER) AS frames FROM s)"""


def _voiced(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("wave"))
    return e.withColumn("s", A.speech(F.transform("wave", lambda x: x > F.lit(0.02).cast("float").cast("double")), 3))


@R.add(f"WITH {VOICED.replace('x > 0.02', 'x > CAST(0.02 AS FLOAT)')} SELECT vec_id, segments, frames, round(frames / len(e), 3) AS ratio, round(1 - round(frames / len(e), 3), 3) AS silence FROM f")
def frames_speech_ratio(spark, d):
    return _voiced(spark, d).select("vec_id", "s.segments", "s.frames", "s.ratio", F.round(1 - F.col("s.ratio"), 3).alias("silence"))


@R.add(f"""WITH {VOICED.replace('x > 0.02', 'x > CAST(0.02 AS FLOAT)')}, q AS (SELECT vec_id, segments, round(frames / len(e), 3) AS ratio, list_max(list_transform(e, lambda x: abs(x))) AS peak, vec_id % 4 * 10 AS seconds FROM f)
    SELECT vec_id, CAST(peak AS DOUBLE) AS peak, concat_ws('|', CASE WHEN seconds < 1 THEN 'audio_too_short' END, CASE WHEN seconds > 25 THEN 'audio_too_long' END, CASE WHEN segments = 0 THEN 'no_speech_detected' END, CASE WHEN ratio <= 0.1 OR ratio < 0.15 THEN 'mostly_silent' END, CASE WHEN peak > 0.3 THEN 'clipped' END) AS warnings,
        seconds < 1 OR ratio < 0.15 OR peak > 0.3 OR seconds * ratio < 0.35 AS bad FROM q""")
def frames_quality(spark, d):
    limits = {"shortest": 1.0, "longest": 25.0, "quiet": -1000.0, "clipped": 0.0, "silent": 0.9, "spoken": 0.15}
    v = _voiced(spark, d).withColumns({"seconds": F.col("vec_id") % 4 * 10.0, "peak": A.peak(F.col("wave"))})
    v = v.withColumn("w", A.quality_flags(F.col("seconds"), F.lit(0.0), (F.col("peak") > 0.3).cast("double"), F.col("s.segments"), F.col("s.ratio"), limits))
    bad = A.bad_for_fragments(F.col("w"), F.lit("good"), F.col("seconds") * F.col("s.ratio"))
    return v.select("vec_id", "peak", F.array_join("w", "|").alias("warnings"), bad.alias("bad"))


@R.add("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('21:' || doc_id), doc_id) AS place FROM documents) SELECT doc_id, place FROM p""")
def sample_shuffled(spark, d):
    return S.placed(table(spark, d, "documents").select("doc_id"), S.draw(21, "doc_id"), "doc_id")


MIX = """r AS (SELECT c_custkey, c_mktsegment AS source, c_acctbal > 0 AS keep FROM customer)"""
RATIOS = {"BUILDING": 0.5, "MACHINERY": 0.3, "FURNITURE": 0.2}


def _mix(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"), "c_acctbal")


@R.add(f"""WITH {MIX}, t(source, effective) AS (VALUES ('BUILDING', 500), ('MACHINERY', 300), ('FURNITURE', 200)) SELECT t.source, count(c_custkey) AS raw, CAST(count_if(keep) AS BIGINT) AS filtered, CAST(any_value(effective) AS BIGINT) AS effective FROM t LEFT JOIN r ON r.source = t.source GROUP BY t.source""")
def mix_planned(spark, d):
    return S.mix_plan(_mix(spark, d), "source", F.col("c_acctbal") > 0, RATIOS, 1000)


@R.add(f"""WITH {MIX}, t(source, effective) AS (VALUES ('BUILDING', 500), ('MACHINERY', 300), ('FURNITURE', 200)), k AS (SELECT c_custkey, source, effective, count(*) OVER (PARTITION BY source) AS n FROM r JOIN t USING (source) WHERE keep),
    full_ AS (SELECT c_custkey, source, CAST(unnest(range(0, effective // n)) AS INTEGER) AS cycle FROM k), last AS (SELECT c_custkey, source, CAST(effective // n AS INTEGER) AS cycle, effective % n AS rest, row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || (effective // n) || ':' || c_custkey), c_custkey) AS r FROM k),
    u AS (SELECT c_custkey, source, cycle FROM full_ UNION ALL SELECT c_custkey, source, cycle FROM last WHERE r <= rest)
    SELECT c_custkey, source, cycle, row_number() OVER (ORDER BY sha256('5:' || c_custkey || ':' || cycle), c_custkey || ':' || cycle) AS place FROM u""")
def mix_built(spark, d):
    return S.mix_build(_mix(spark, d), "source", "c_custkey", F.col("c_acctbal") > 0, RATIOS, 1000, 5).select("c_custkey", "source", "cycle", "place")
