"""Queries: normalisation, distances, error rates and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import kernels
from lexmill.functions import text as T
from lexmill.operators import evaluation as E
from lexmill.plans.common import FORM, FORMS, PAIRS, SCORED, Registry, pairs, table

R = Registry()
MACRO = """CAST(count_if(r <> '') AS BIGINT) AS evaluated, CAST(count_if(r = '') AS BIGINT) AS blank_reference, CAST(count_if(h = '') AS BIGINT) AS blank_hypothesis,
    round(avg(CASE WHEN r <> '' THEN wer END), 6) AS wer, round(avg(CASE WHEN r <> '' THEN cer END), 6) AS cer,
    round(avg(CASE WHEN r <> '' THEN CAST(exact AS INTEGER) END), 6) AS exact_rate"""


@R.add(rf"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g')) AS transcript, {FORM.format('text')} AS scoring FROM conversations")
def text_transcript_forms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.transcript("text").alias("transcript"), T.for_scoring("text").alias("scoring"))


@R.add(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS strict_md5 FROM documents")
def text_strict_form(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strict("text")).alias("strict_md5"))


@R.add(r"""SELECT page_id, length(html) - length(regexp_replace(html, '\[[^\]]*\]|\([^)]*\)|<[^>]*>', '', 'g')) AS marked,
    len(regexp_extract_all(html, '<[^>]*>')) AS tags FROM pages""")
def text_noise_marks(spark, d):
    p = table(spark, d, "pages")
    bare = F.regexp_replace("html", r"\[[^\]]*\]|\([^)]*\)|<[^>]*>", "")
    return p.select("page_id", (F.length("html") - F.length(bare)).cast("long").alias("marked"), F.size(F.regexp_extract_all("html", F.lit("<[^>]*>"), F.lit(0))).cast("long").alias("tags"))


#: The conversations hold no typographic quote and no character that composition changes; tests/test_functions.py has some.
@R.add(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\[[^\]]*\]|\([^)]*\)|<[^>]*>', ' ', 'g') AS x FROM conversations)
    SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(x), '[^A-Za-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g')) AS form FROM t""")
def text_evaluation_form(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.for_evaluation("text").alias("form"))


@R.add(r"""WITH t AS (SELECT conv_id, turn, text, trim(text) AS x, trim(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g')) AS p,
        len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS n FROM conversations),
    u AS (SELECT *, len(list_filter(string_split(p, ' '), lambda w: w <> '')) AS k FROM t)
    SELECT conv_id, turn, CAST(n AS INTEGER) AS words,
        CASE WHEN k = 0 THEN 'unknown' WHEN k = 1 AND length(p) = 1 THEN 'letter' WHEN k = 1 THEN 'word' ELSE 'sentence' END AS prompt_kind,
        CASE WHEN x = '' THEN 'blank' WHEN x LIKE '%?' THEN 'question' WHEN length(x) = 1 THEN 'letter' WHEN n <= 1 THEN 'word' WHEN n <= 4 AND NOT regexp_matches(x, '[.!?]') THEN 'phrase' ELSE 'sentence' END AS item_kind
    FROM u""")
def text_kinds(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.word_count("text").alias("words"), T.prompt_kind("text").alias("prompt_kind"), T.item_kind("text").alias("item_kind"))


@R.add(r"""WITH t AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM benchmark)
    SELECT item_id, CAST(list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))))) AS INTEGER) AS syllables, CAST(len(ws) AS INTEGER) AS words FROM t""")
def text_syllables(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.syllables("text").alias("syllables"), F.size(T.tokens(T.strict("text"))).alias("words"))


@R.add(r"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
    SELECT word, right(word, 2) AS family, regexp_extract(word, '^([^aeiou]*)(.*)$', 1) AS onset, regexp_extract(word, '^([^aeiou]*)(.*)$', 2) AS rime,
        regexp_replace(word, '[aeiouy]|[^a-z]', '', 'g') AS skeleton, regexp_matches(word, '^[^aeiou][aeiou][^aeiou]$') AS cvc FROM w""")
def text_word_parts(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("word", T.family("word").alias("family"), T.onset("word").alias("onset"), T.rime("word").alias("rime"), T.skeleton("word").alias("skeleton"), T.is_cvc("word").alias("cvc"))


@R.add("""SELECT p_partkey, list_filter(list_transform(CASE WHEN p_partkey % 3 = 0 THEN string_split(replace(p_name, ' ', ' | '), '|') WHEN p_partkey % 3 = 1 THEN string_split(replace(p_name, ' ', ','), ',')
    ELSE [p_name] END, lambda x: trim(x)), lambda x: x <> '') AS answers FROM part""")
def text_accepted_answers(spark, d):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(" | "))).when(F.col("p_partkey") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit(","))).otherwise(F.to_json(F.array("p_name")))
    return table(spark, d, "part").select("p_partkey", T.accepted_answers(cell).alias("answers"))


@R.add(f"WITH {SCORED} SELECT id, r, h, round(wer, 6) AS wer, round(cer, 6) AS cer, exact FROM scored")
def pairs_error_rates(spark, d):
    s = E.scored(pairs(spark, d))
    return s.select("id", "r", "h", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"), "exact")


@R.add(f"""WITH {SCORED}, p AS (SELECT id, r, h, CASE WHEN r = '' AND h = '' THEN 100.0 WHEN r = '' OR h = '' THEN 0.0 ELSE round(greatest(0.0, (1 - letter_edits / greatest(length(r), length(h))) * 100), 2) END AS percent FROM scored)
    SELECT id, percent, CASE WHEN r = '' OR h = '' THEN 'blank' WHEN r = h THEN 'exact' WHEN percent >= 90 THEN 'very_close' WHEN percent >= 75 THEN 'close' WHEN percent >= 50 THEN 'partial' ELSE 'far' END AS class FROM p""")
def pairs_similarity_class(spark, d):
    return E.scored(pairs(spark, d)).select("id", "percent", "class")


@R.add()
def pairs_error_category(spark, d):
    s = E.categorised(pairs(spark, d), "id")
    return s.select("id", "category", F.round(D.indel_ratio(F.col("r"), F.col("h")), 6).alias("indel"), F.round(D.lenient_edits(D.letters(F.col("r")), D.letters(F.col("h"))), 6).alias("lenient"))


@R.add()
def pairs_block_ratio(spark, d):
    return pairs(spark, d).select("id", F.round(kernels.block_ratio("ref", "hyp"), 6).alias("ratio"))


@R.add(f"WITH {SCORED} SELECT {MACRO} FROM scored")
def report_macro(spark, d):
    return E.macro(pairs(spark, d))


@R.add(f"WITH {SCORED} SELECT brand, {MACRO} FROM scored GROUP BY brand")
def report_by_group(spark, d):
    return E.macro(pairs(spark, d), "brand")


@R.add(f"WITH {SCORED} SELECT kind, CAST(sum(word_edits) AS BIGINT) AS word_edits, CAST(sum(n) AS BIGINT) AS words, round(sum(word_edits) / sum(n), 6) AS wer, round(sum(letter_edits) / sum(m), 6) AS cer FROM scored WHERE r <> '' GROUP BY kind")
def report_micro(spark, d):
    return E.micro(pairs(spark, d), "kind")


@R.add(f"WITH {SCORED} SELECT brand, kind, {MACRO} FROM scored GROUP BY GROUPING SETS ((), (brand), (kind))")
def report_grouping_sets(spark, d):
    return E.report(pairs(spark, d), "brand", "kind")


@R.add(f"""WITH {PAIRS}, ws AS (SELECT id, split_part(ref, ' ', 1) AS r, split_part(hyp, ' ', 1) AS h FROM pairs), s AS (SELECT *, levenshtein(r, h) / length(r) AS cer FROM ws WHERE regexp_matches(r, '^[a-z0-9'']{{1,5}}$'))
    SELECT count(*) AS rows, round(avg(CAST(r = h AS INTEGER)), 6) AS exact_rate, round(avg(CAST(h = '' AS INTEGER)), 6) AS blank_rate,
        round(avg(CAST(cer <= 0.4 AND r <> h AS INTEGER)), 6) AS near_rate, round(avg(cer), 6) AS cer FROM s""")
def report_short_words(spark, d):
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return E.short_words(pairs(spark, d).withColumns({"ref": first(F.col("ref")), "hyp": first(F.col("hyp"))}))


@R.add(f"""WITH {PAIRS}, ws AS (SELECT id, split_part(ref, ' ', 1) AS r, split_part(hyp, ' ', 1) AS h FROM pairs), s AS (SELECT *, levenshtein(r, h) / length(r) AS cer FROM ws WHERE regexp_matches(r, '^[^aeiou][aeiou][^aeiou]$'))
    SELECT count(*) AS rows, coalesce(round(avg(CAST(r = h AS INTEGER)), 6), 0) AS exact_rate, coalesce(round(avg(CAST(h = '' AS INTEGER)), 6), 0) AS blank_rate,
        coalesce(round(avg(CAST(cer <= 0.4 AND r <> h AS INTEGER)), 6), 0) AS near_rate, coalesce(round(avg(cer), 6), 0) AS cer FROM s""")
def report_cvc_words(spark, d):
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return E.cvc_words(pairs(spark, d).withColumns({"ref": first(F.col("ref")), "hyp": first(F.col("hyp"))}))


@R.add(f"""WITH {PAIRS}, ws AS (SELECT id, split_part(ref, ' ', 1) AS r, split_part(hyp, ' ', 1) AS h FROM pairs), s AS (SELECT *, levenshtein(r, h) / length(r) AS cer FROM ws WHERE r IN ('red', 'hot', 'small'))
    SELECT count(*) AS rows, coalesce(round(avg(CAST(r = h AS INTEGER)), 6), 0) AS exact_rate, coalesce(round(avg(CAST(h = '' AS INTEGER)), 6), 0) AS blank_rate,
        coalesce(round(avg(CAST(cer <= 0.4 AND r <> h AS INTEGER)), 6), 0) AS near_rate, coalesce(round(avg(cer), 6), 0) AS cer FROM s""")
def report_keywords(spark, d):
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return E.keywords(pairs(spark, d).withColumns({"ref": first(F.col("ref")), "hyp": first(F.col("hyp"))}), ("red", "HOT", "small ", "red"))


@R.add(f"WITH {FORMS} SELECT r, h, count(*) AS n FROM forms WHERE r <> h AND r <> '' GROUP BY r, h ORDER BY n DESC, r, h LIMIT 25")
def report_top_confusions(spark, d):
    return E.confusions(pairs(spark, d))


@R.add(f"""WITH {FORMS}, t AS (SELECT string_split(r, ' ') AS a, string_split(h, ' ') AS b FROM forms), u AS (SELECT unnest(list_zip(a, b)) AS x FROM t WHERE len(a) = len(b))
    SELECT x[1] AS r, x[2] AS h, count(*) AS n FROM u WHERE x[1] <> x[2] GROUP BY 1, 2 ORDER BY n DESC, r, h LIMIT 25""")
def report_token_substitutions(spark, d):
    return E.substitutions(pairs(spark, d))


@R.add(f"""WITH {SCORED}, b AS (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' ELSE '6+' END AS bucket, exact FROM scored), g AS (SELECT bucket, count(*) AS rows, round(avg(CAST(exact AS INTEGER)), 6) AS e FROM b GROUP BY bucket)
    SELECT x.bucket, coalesce(rows, 0) AS rows, coalesce(e, 0.0) AS exact_rate FROM (VALUES ('1'), ('2-5'), ('6+')) x(bucket) LEFT JOIN g ON g.bucket = x.bucket""")
def report_by_length(spark, d):
    return E.by_length(pairs(spark, d))


@R.add(f"WITH {SCORED} SELECT id, r, h, round(cer, 6) AS cer FROM scored ORDER BY cer DESC, id LIMIT 20")
def report_worst_examples(spark, d):
    return E.scored(pairs(spark, d)).select("id", "r", "h", F.round("cer", 6).alias("cer")).orderBy(F.desc("cer"), "id").limit(20)


@R.add(f"""WITH {SCORED}, w AS (SELECT kind, CASE WHEN abs(wer - cer) < 1e-12 THEN 'tie' WHEN wer < cer THEN 'wer' ELSE 'cer' END AS winner FROM scored)
    SELECT kind, winner, count(*) AS n FROM w GROUP BY kind, winner""")
def report_winners(spark, d):
    s = E.scored(pairs(spark, d))
    return s.groupBy("kind", E.winners(s, "wer", "cer").alias("winner")).agg(F.count("*").alias("n"))


@R.add(f"WITH {SCORED}, g AS (SELECT kind, avg(wer) AS wer, avg(cer) AS cer FROM scored GROUP BY kind) SELECT round(avg(wer), 6) AS macro_wer, round(avg(CASE WHEN kind IN ('SMALL', 'MEDIUM') THEN wer END), 6) AS clean_wer, arg_min(kind, (round(wer, 9), kind)) AS best FROM g")
def report_macro_over_sources(spark, d):
    g = E.scored(pairs(spark, d)).groupBy("kind").agg(F.avg("wer").alias("wer"))
    clean = F.when(F.col("kind").isin("SMALL", "MEDIUM"), F.col("wer"))
    return g.agg(F.round(F.avg("wer"), 6).alias("macro_wer"), F.round(F.avg(clean), 6).alias("clean_wer"), F.min_by("kind", F.struct(F.round("wer", 9), "kind")).alias("best"))


@R.add()
def align_words(spark, d):
    p = pairs(spark, d).select("id", kernels.alignment(F.split("ref", " "), F.split("hyp", " ")).alias("steps"))
    return p.select("id", F.posexplode("steps").alias("place", "s")).select("id", "place", "s.*")


@R.add()
def align_summary(spark, d):
    return align_words(spark, d).groupBy("id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("match", "substitution", "deletion", "insertion")])
