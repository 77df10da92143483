"""Queries: scores of sounds, expected sounds, fragments, uncertain recordings, training labels, corrections of a comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import frames as A
from lexmill.functions import text as T
from lexmill.operators import correction as K
from lexmill.operators import evaluation as E
from lexmill.operators import pronunciation as N
from lexmill.plans.common import FORM, Registry, table

R = Registry()
LABELS = ["<pad>", "AA", "B", "D", "IY", "K", "S", "T"]


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


@R.add("""WITH e AS (SELECT vec_id, list_transform(range(0, 8), lambda f: list_transform(embedding[f * 8 + 1 : f * 8 + 8], lambda x: CAST(x AS DOUBLE))) AS fr, unnest([0, 1]) AS place FROM embeddings WHERE len(embedding) = 64),
    s AS (SELECT vec_id, place, fr, [vec_id % 7 + 1, (vec_id + 3) % 7 + 1] AS own, (vec_id + 3 * place) % 7 + 1 AS lab, CASE place WHEN 0 THEN [0, 1, 2] ELSE [4, 5, 6, 7] END AS ats FROM e),
    m AS (SELECT *, list_transform(range(0, 8), lambda l: list_sum(list_transform(ats, lambda f: fr[f + 1][l + 1])) / len(ats)) AS means FROM s),
    c AS (SELECT *, list_filter(range(0, 8), lambda l: l > 0 AND NOT list_contains(own, l)) AS rivals FROM m),
    b AS (SELECT *, means[lab + 1] AS mine, list_max(list_transform(rivals, lambda l: means[l + 1])) AS best FROM c)
    SELECT vec_id, CAST(place AS INTEGER) AS place, (['<pad>', 'AA', 'B', 'D', 'IY', 'K', 'S', 'T'])[lab + 1] AS phone, CAST(list_min(ats) AS INTEGER) AS start, CAST(list_max(ats) AS INTEGER) AS "end",
        round(1 / (1 + exp(best - mine)), 6) AS score, round(mine - best, 6) AS margin, CASE WHEN 1 / (1 + exp(best - mine)) < 0.48 THEN 'weak' WHEN 1 / (1 + exp(best - mine)) < 0.52 THEN 'acceptable' ELSE 'good' END AS status,
        (['<pad>', 'AA', 'B', 'D', 'IY', 'K', 'S', 'T'])[list_filter(rivals, lambda l: means[l + 1] = best)[1] + 1] AS competitor, round(mine, 6) AS own_lp, round(best, 6) AS competitor_lp FROM b""")
def phones_scored(spark, d):
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: A.doubles(F.slice("embedding", f * 8 + 1, F.lit(8))))
    part = lambda at, *frames: F.struct(((F.col("vec_id") + at) % 7 + 1).cast("int").alias("label"), F.array(*map(F.lit, frames)).alias("at"))
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", cut.alias("frames"), F.array(part(0, 0, 1, 2), part(3, 4, 5, 6, 7)).alias("segments"))
    return N.scored(rows, "frames", "segments", LABELS, 0, 0.48, 0.52)


@R.add("""WITH p AS (SELECT p_partkey AS id, p_name, round(p_partkey % 100 / 100, 6) AS score FROM part), w AS (SELECT id, score, unnest(string_split(lower(p_name), ' ')) AS word, generate_subscripts(string_split(lower(p_name), ' '), 1) - 1 AS place FROM p)
    SELECT id, CAST(place AS INTEGER) AS place, word, score, CASE WHEN score >= 0.85 THEN 'good' WHEN score >= 0.75 THEN 'acceptable' ELSE 'weak' END AS status FROM w""")
def phones_word_scores(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_partkey") % 100 / 100).alias("score"))
    return N.word_scores(rows, "p_name", "score", 0.75).select("id", "place", "word", "score", "status")


SAID = ["q", "Two", "tree!", "they're", "", "green", "red hen", "almond"]
SAID_SQL = "['q', 'Two', 'tree!', 'they''re', '', 'green', 'red hen', 'almond']"


@R.add(f"""WITH t AS (SELECT c_custkey AS id, ({SAID_SQL})[c_custkey % 8 + 1] AS text FROM customer), l AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
    o(word, phones) AS (VALUES ('q', 'K Y UW'), ('two', 'T UW'), ('tree', 'T R IY'), ('they''re', 'DH EH R')),
    f AS (SELECT id, text, {FORM.format('text')} AS w FROM t)
    SELECT id, text, CASE WHEN o.word IS NOT NULL THEN phones WHEN l.word IS NOT NULL THEN upper(l.word[1]) || ' ' || upper(l.word[-1]) ELSE '' END AS phones,
        CASE WHEN w = '' THEN 'empty' WHEN length(w) = 1 THEN 'letter_name' WHEN contains(w, ' ') THEN 'sentence_skipped' WHEN o.word IS NOT NULL THEN 'override' WHEN l.word IS NOT NULL THEN 'lexicon' ELSE 'unavailable' END AS phones_from
    FROM f LEFT JOIN o ON o.word = w LEFT JOIN l ON l.word = w""")
def phones_expected(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _pick(SAID, F.col("c_custkey") % 8).alias("text"))
    word = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    ends = lambda digit: F.array(F.concat(F.upper(F.left("word", F.lit(1))), F.lit(digit)), F.upper(F.right("word", F.lit(1))))
    lexicon = word.select("word", F.explode(F.array(F.struct(F.lit(2).alias("variant"), F.array(F.lit("X")).alias("phones")), F.struct(F.lit(1).alias("variant"), ends("1").alias("phones")))).alias("v")).select("word", "v.*")
    return N.expected_phones(rows, "text", lexicon).select("id", "text", F.array_join("phones", " ").alias("phones"), "phones_from")


@R.add(f"""WITH t AS (SELECT c_custkey AS id, ({SAID_SQL})[c_custkey % 8 + 1] AS text, c_nationkey % 2 = 0 AS sound FROM customer)
    SELECT id, text, sound, CASE text WHEN 'q' THEN CASE WHEN sound THEN 'K' ELSE 'K Y UW' END WHEN 'Two' THEN 'T UW' WHEN 'tree!' THEN 'T R IY' WHEN 'they''re' THEN 'DH EH R' WHEN '' THEN '' WHEN 'green' THEN 'G R IY N' WHEN 'red hen' THEN 'R EH D HH EH N' ELSE 'AE L M OW N D' END AS phones,
        CASE text WHEN 'q' THEN CASE WHEN sound THEN 'letter_sound' ELSE 'letter_name' END WHEN '' THEN 'empty' WHEN 'green' THEN 'spelling' WHEN 'red hen' THEN 'spelling' WHEN 'almond' THEN 'spelling' ELSE 'override' END AS phones_from FROM t""")
def phones_canonical(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _pick(SAID, F.col("c_custkey") % 8).alias("text"), (F.col("c_nationkey") % 2 == 0).alias("sound"))
    none = spark.createDataFrame([], "word string, variant int, phones array<string>")
    kind = F.when(F.col("sound"), "letter_sound").otherwise("letter")
    return N.canonical_phones(rows, "text", kind, none).select("id", "text", "sound", F.array_join("phones", " ").alias("phones"), "phones_from")


KINDS = ["word", "sentence", "letter", "rhyme"]


@R.add(f"""WITH w AS (SELECT p_partkey AS id, lower(string_split(p_name, ' ')[1]) AS e, ({KINDS})[p_partkey % 4 + 1] AS kind, CASE WHEN p_partkey % 3 > 0 THEN p_size / 50 END AS sound, p_partkey % 13 = 0 AS bad FROM part),
    h AS (SELECT *, CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN e[1] WHEN 2 THEN regexp_replace(e, '[aeiouy]', '', 'g') WHEN 3 THEN e[:3] WHEN 4 THEN e || 's' WHEN 5 THEN regexp_replace(e, '[aeiouy]', '', 'g')[2:] ELSE e END AS r FROM w),
    b AS (SELECT *, regexp_replace(e, '[aeiouy]', '', 'g') AS bones, list_filter(['blank_raw_transcript', 'raw_too_short_for_non_letter', 'raw_missing_vowel_like_character', 'raw_shorter_than_expected_ratio', 'raw_looks_like_consonant_skeleton'], lambda x: CASE x
        WHEN 'blank_raw_transcript' THEN r = '' WHEN 'raw_too_short_for_non_letter' THEN length(r) <= 1 AND length(e) > 1 WHEN 'raw_missing_vowel_like_character' THEN regexp_matches(e, '[aeiouy]') AND NOT regexp_matches(r, '[aeiouy]')
        WHEN 'raw_shorter_than_expected_ratio' THEN kind IN ('word', 'rhyme') AND length(r) / length(e) < 0.5 ELSE length(r) < length(e) AND length(r) >= 2 AND regexp_replace(e, '[aeiouy]', '', 'g') <> '' AND regexp_matches(regexp_replace(e, '[aeiouy]', '', 'g'), array_to_string(string_split(r, ''), '.*')) END) AS found FROM h)
    SELECT id, e AS expected, r AS raw, CASE WHEN kind = 'letter' THEN '' ELSE concat_ws('|', CASE WHEN len(found) > 0 THEN array_to_string(found, '|') END, CASE WHEN len(found) > 0 AND sound < 0.65 THEN 'incomplete_phoneme_coverage' END, CASE WHEN bad THEN 'bad_audio_quality' END) END AS reasons FROM b""")
def correct_fragments(spark, d):
    k, e = F.col("id"), F.col("expected")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.get(F.split("p_name", " "), F.lit(0))).alias("expected"), "p_size")
    bones = F.regexp_replace(e, "[aeiouy]", "")
    raw = F.when(k % 7 == 0, "").when(k % 7 == 1, F.left(e, F.lit(1))).when(k % 7 == 2, bones).when(k % 7 == 3, F.left(e, F.lit(3))).when(k % 7 == 4, F.concat(e, F.lit("s"))).when(k % 7 == 5, F.substr(bones, F.lit(2))).otherwise(e)
    found = N.fragment_reasons(e, F.col("raw"), _pick(KINDS, k % 4), F.when(k % 3 > 0, F.col("p_size") / 50), k % 13 == 0)
    return rows.withColumn("raw", raw).select("id", "expected", "raw", F.array_join(found, "|").alias("reasons"))


@R.add("""WITH c AS (SELECT c_custkey AS id, list_filter(['too_short', 'no_speech_detected', 'mostly_silent', 'low_volume', 'clipped'], lambda x: (c_custkey // CASE x WHEN 'too_short' THEN 1 WHEN 'no_speech_detected' THEN 2 WHEN 'mostly_silent' THEN 4 WHEN 'low_volume' THEN 8 ELSE 16 END) % 2 = 1 AND c_custkey % 3 > 0) AS flags, c_nationkey % 2 = 0 AS mute, c_nationkey % 3 > 0 AS asked FROM customer),
    r AS (SELECT id, flags, list_concat(list_transform(flags, lambda x: CASE WHEN x = 'too_short' THEN 'audio_too_short' ELSE x END), CASE WHEN mute THEN ['blank_asr_transcript'] ELSE [] END, CASE WHEN mute AND asked THEN ['expected_text_without_reliable_asr_evidence'] ELSE [] END) AS reasons FROM c)
    SELECT id, len(reasons) > 0 AS uncertain, len(reasons) > 0 AS retry_required, array_to_string(reasons, '|') AS reasons, len(flags) > 0 AS gate_failed, CASE WHEN len(reasons) = 0 THEN '' WHEN list_contains(reasons, 'audio_too_short') THEN 'Please record again. Make sure your voice is clear and at least 1 second long.'
        WHEN list_has_any(reasons, ['no_speech_detected', 'mostly_silent']) THEN 'Please record again. Make sure your voice is clear and close enough to the microphone.' WHEN list_contains(reasons, 'low_volume') THEN 'Please record again with a clearer, louder voice.'
        WHEN list_contains(reasons, 'clipped') THEN 'Please record again a little farther from the microphone.' ELSE 'Please record again. The audio was not reliable enough to score.' END AS message FROM r""")
def frames_uncertain(spark, d):
    k = F.col("c_custkey")
    flags = F.array_compact(F.array(*[F.when((F.floor(k / 2**i) % 2 == 1) & (k % 3 > 0), name) for i, name in enumerate(N.DOUBTS)]))
    heard, asked = F.when(F.col("c_nationkey") % 2 == 0, " ").otherwise("a word"), F.when(F.col("c_nationkey") % 3 > 0, "a word").otherwise("")
    u = table(spark, d, "customer").select(k.alias("id"), N.uncertainty(flags, heard, F.array().cast("array<string>"), asked, gate=True).alias("u"))
    return u.select("id", "u.uncertain", "u.retry_required", F.array_join("u.reasons", "|").alias("reasons"), "u.gate_failed", "u.message")


@R.add("""WITH c AS (SELECT o_orderkey AS id, (['K', 'AE', 'T', 'XX', ''])[o_orderkey % 5 + 1] AS weak, (['usable', 'low_confidence', 'unusable'])[o_custkey % 3 + 1] AS alignment, o_orderkey % 11 = 0 AS fine, (['', 'B', 'IY'])[(o_orderkey // 5) % 3 + 1] AS nearest, (o_orderkey % 10) / 10 AS score,
        ([['K', 'AE', 'T'], ['K', 'AE'], ['K', 'AE', 'T', 'S'], [], ['B', 'AE', 'T']])[(o_orderkey // 7) % 5 + 1] AS decoded FROM orders),
    p AS (SELECT *, CASE weak WHEN 'K' THEN 'initial' WHEN 'AE' THEN 'medial' WHEN 'T' THEN 'final' ELSE 'unknown' END AS pos, NOT list_contains(decoded, weak) AS gone, len(decoded) AS m FROM c)
    SELECT id, CASE WHEN alignment = 'unusable' THEN 'far_answer' WHEN fine THEN CASE WHEN alignment = 'low_confidence' THEN 'correct_with_low_confidence' ELSE 'far_answer' END WHEN weak = '' THEN 'far_answer' WHEN alignment = 'low_confidence' AND score < 0.35 THEN 'low_confidence_audio'
        WHEN m > 3 THEN 'phoneme_insertion' WHEN pos = 'final' AND (m < 3 OR (gone AND nearest = '')) THEN 'final_sound_omission' WHEN gone AND (m < 3 OR nearest = '') THEN 'phoneme_omission' WHEN weak = 'AE' OR nearest = 'IY' THEN 'vowel_confusion'
        WHEN pos = 'initial' THEN 'initial_sound_substitution' WHEN pos = 'medial' THEN 'medial_sound_confusion' ELSE 'consonant_confusion' END AS error, pos AS position FROM p""")
def phones_error(spark, d):
    k = F.col("o_orderkey")
    heard = [["K", "AE", "T"], ["K", "AE"], ["K", "AE", "T", "S"], [], ["B", "AE", "T"]]
    decoded = F.element_at(F.array(*[F.array(*map(F.lit, h)).cast("array<string>") for h in heard]), (F.floor(k / 7) % 5 + 1).cast("int"))
    weak, expected = _pick(["K", "AE", "T", "XX", ""], k % 5), F.array(*map(F.lit, heard[0]))
    found = N.acoustic_error(F.lit("far_answer"), k % 11 == 0, _pick(["usable", "low_confidence", "unusable"], F.col("o_custkey") % 3), weak, _pick(["", "B", "IY"], F.floor(k / 5) % 3), k % 10 / 10, expected, decoded)
    return table(spark, d, "orders").select(k.alias("id"), found.alias("error"), N.position(weak, expected).alias("position"))


@R.add(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(upper(regexp_replace(translate(replace(coalesce(text, ''), 'ß', 'ss'), '‘’‚‛', ''''''''''), '\[[^\]]+\]|\([^)]+\)|<[^>]+>', ' ', 'g')), '[^A-Z'']', ' ', 'g'), ' +', ' ', 'g')) AS label,
    trim(regexp_replace(regexp_replace(lower(regexp_replace(translate(coalesce(text, ''), '‘’‚‛', ''''''''''), '\[[^\]]+\]|\([^)]+\)|<[^>]+>', ' ', 'g')), '[^abcdeilnorst]', ' ', 'g'), ' +', ' ', 'g')) AS few FROM documents""")
def text_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", T.label("text").alias("label"), T.label("text", set("abcdeilnorst") | {"|", "<pad>"}).alias("few"))


HEARD = [("q", "cue"), ("q", "yoo"), ("w", "double you"), ("z", "they"), ("ten", "then"), ("tin", "thin"), ("see", "c"), ("", "x"), ("a", ""), ("red hen", "read hen"), ("Bee.", "bee")]


@R.add("""WITH v(k, expected, raw, accepted, reason, corrected) AS (VALUES (0, 'q', 'cue', true, 'expected_centric_letter_alias_match', 'q'), (1, 'q', 'yoo', false, 'transcript_only_rejected_ambiguous_letter_alias', 'yoo'), (2, 'w', 'double you', true, 'expected_centric_letter_alias_match', 'w'),
    (3, 'z', 'they', false, 'no_letter_alias_match', 'they'), (4, 'ten', 'then', true, 'expected_centric_known_word_confusion', 'ten'), (5, 'tin', 'thin', false, 'no_safe_word_correction', 'thin'), (6, 'see', 'c', true, 'expected_centric_known_word_confusion', 'see'),
    (7, '', 'x', false, 'empty_expected_text', 'x'), (8, 'a', '', false, 'empty_raw_transcript', ''), (9, 'red hen', 'read hen', false, 'sentence_correction_not_applied', 'read hen'), (10, 'Bee.', 'bee', true, 'exact_match_after_normalization', 'bee'))
    SELECT c_custkey AS id, expected, raw, accepted, reason, corrected FROM customer JOIN v ON k = c_custkey % 11""")
def correct_plainly(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[_pick([h[i] for h in HEARD], F.col("c_custkey") % 11).alias(n) for i, n in enumerate(("expected", "raw"))])
    c = c.withColumns({"e": T.for_evaluation("expected"), "r": T.for_evaluation("raw")})
    return c.withColumn("x", K.plainly(F.col("e"), F.col("r"), T.prompt_kind("e"))).select("id", "expected", "raw", "x.*")


@R.add("""WITH e AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_partkey % 17 = 0 THEN 'he' ELSE 'hen' END AS x, CASE WHEN l_partkey % 17 = 0 THEN 'she' ELSE 'pen' END AS y, l_partkey % 100 / 100 AS spelling, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 20 / 20 END AS sound,
        CASE WHEN l_suppkey % 4 > 1 THEN l_orderkey % 10 / 10 END AS acoustic, CASE WHEN l_orderkey % 3 = 0 THEN 0.5 ELSE 1.0 END AS ctx, CASE WHEN l_partkey % 5 = 0 THEN 0.95 ELSE 0.0 END AS conf, l_partkey % 13 = 0 AS same, l_quantity / 50 AS final FROM lineitem),
    r AS (SELECT *, CASE WHEN x = 'he' THEN 'rejected_short_function_word_safety' WHEN same AND ctx >= 0.95 THEN 'homophone_match' WHEN conf >= 0.9 AND ctx >= 0.95 AND (spelling >= 0.5 OR coalesce(sound, 0) >= 0.7 OR coalesce(acoustic, 0) >= 0.75) THEN 'known_asr_confusion_match'
        WHEN acoustic >= 0.75 AND ctx >= 0.95 AND (spelling >= 0.5 OR coalesce(sound, 0) >= 0.7) THEN 'gop_supported_expected_match' WHEN sound >= 0.9 AND final >= 0.78 THEN 'phoneme_expected_match' WHEN spelling >= 0.9 AND ctx >= 0.95 THEN 'spelling_context_expected_match'
        WHEN sound IS NULL AND acoustic IS NULL AND spelling < 0.9 THEN 'rejected_no_acoustic_evidence' WHEN final >= 0.78 AND (sound IS NOT NULL OR acoustic IS NOT NULL) THEN 'spelling_phoneme_expected_match' ELSE 'rejected_low_similarity' END AS reason FROM e)
    SELECT id, line, reason NOT LIKE 'rejected%' AS accepted, reason FROM r""")
def correct_ladder(spark, d):
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    odd = p % 17 == 0
    x = K.ladder(
        F.when(odd, "he").otherwise("hen"), F.when(odd, "she").otherwise("pen"), F.col("l_quantity").cast("double") / 50, 0.78, p % 100 / 100, F.when(s % 3 > 0, s % 20 / 20),
        F.when(s % 4 > 1, o % 10 / 10), F.when(o % 3 == 0, 0.5).otherwise(1.0), F.when(p % 5 == 0, 0.95).otherwise(0.0), p % 13 == 0,
    )
    return table(spark, d, "lineitem").select(o.alias("id"), F.col("l_linenumber").alias("line"), x.alias("x")).select("id", "line", "x.*")


@R.add("""WITH n AS (SELECT o_orderpriority AS model, o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT model, string_agg(part || ':' || n, ',' ORDER BY part) AS shape FROM n GROUP BY 1) SELECT count(*) AS models, count(DISTINCT shape) <= 1 AS aligned FROM s""")
def report_comparable(spark, d):
    return E.comparable(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey")


@R.add("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'failed' ELSE '' END AS a_error, CASE c_nationkey % 3 WHEN 0 THEN 'tie' WHEN 1 THEN 'a' ELSE 'b' END AS winner FROM customer WHERE c_custkey % 5 = 0 OR c_nationkey % 3 > 0""")
def report_disagreements(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "failed").otherwise("").alias("a_error"), _pick(["tie", "a", "b"], F.col("c_nationkey") % 3).alias("winner"))
    return E.disagreements(rows, "winner", "a_error")
