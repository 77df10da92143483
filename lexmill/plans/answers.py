"""Queries: answers and their errors, comparisons of models, contracts between tables, lookups and mixes of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import frames as A
from lexmill.functions import text as T
from lexmill.operators import evaluation as E
from lexmill.operators import lookup as L
from lexmill.operators import quality as Q
from lexmill.operators import responses as N
from lexmill.operators import sampling as S
from lexmill.plans.common import FORM, SCORED, Registry, pairs, table

R = Registry()

#: Each part's name as it was read: half of it, reversed, with a word more, another one, or as it is.
READ = """answers AS (SELECT p_partkey AS id, p_name AS expected, string_split(p_name, ' ') AS et, CASE p_partkey % 5 WHEN 0 THEN [et[1]] WHEN 1 THEN list_reverse(et) WHEN 2 THEN list_append(et, 'again') WHEN 3 THEN list_append(et[2:], 'other') ELSE et END AS heard FROM part)"""


def _read(spark, d):
    w = F.split("p_name", " ")
    rest = F.slice(w, F.lit(2), F.size(w))
    key = F.col("p_partkey") % 5
    at = F.when(key == 0, F.slice(w, 1, 1)).when(key == 1, F.reverse(w)).when(key == 2, F.array_append(w, F.lit("again"))).when(key == 3, F.array_append(rest, F.lit("other"))).otherwise(w)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("expected"), F.array_join(at, " ").alias("actual"))


@R.add(f"""WITH {READ} SELECT id, CASE WHEN et = heard THEN 'correct' WHEN len(et) = 1 THEN 'other' WHEN len(heard) <= greatest(1, len(et) // 2) THEN 'partial_sentence' WHEN list_sort(et) = list_sort(heard) THEN 'word_order_error'
    WHEN len(list_filter(et, lambda x: NOT list_contains(heard, x))) > 0 THEN 'skipped_word' WHEN len(heard) > len(et) THEN 'insertion' ELSE 'other' END AS error FROM answers""")
def answer_sentence_errors(spark, d):
    known = ["correct", "partial_sentence", "word_order_error", "skipped_word", "insertion"]
    kind = F.when((F.size(F.split("e", " ")) > 1) | (F.col("error") == "correct"), F.when(F.col("error").isin(known), F.col("error"))).alias("error")
    return N.analysed(_read(spark, d)).select("id", F.coalesce(kind, F.lit("other")).alias("error"))


@R.add(f"""WITH {READ}, m AS (SELECT id, et = heard AS exact, list_contains([et[1], array_to_string(list_reverse(et), ' ')], array_to_string(heard, ' ')) AS listed FROM answers)
    SELECT id, exact, listed, exact OR listed AS correct FROM m""")
def answer_matches(spark, d):
    w = F.split("expected", " ")
    rows = _read(spark, d).withColumn("accepted", F.array(F.get(w, F.lit(0)), F.array_join(F.reverse(w), " ")))
    return N.matched(rows, "accepted").select("id", "exact", "listed", "correct")


@R.add()
def answer_analysis(spark, d):
    got = N.analysed(_read(spark, d))
    return got.select("id", "e", "a", "exact", "correct", "closeness", "label", F.array_join("e_phones", " ").alias("e_phones"), F.array_join("a_phones", " ").alias("a_phones"), "c.*", "error", "place", "focus", F.col("feedback.hint").alias("hint"), F.col("feedback.summary").alias("summary"))


@R.add()
def answer_token_scores(spark, d):
    return N.token_scores(_read(spark, d)).select("id", "token_similarity", "token_accuracy")


@R.add(f"""WITH {SCORED}, w AS (SELECT kind, CASE WHEN abs(wer - cer) < 1e-12 THEN 'tie' WHEN wer < cer THEN 'wer' ELSE 'cer' END AS winner FROM scored)
    SELECT kind, CAST(count_if(winner = 'wer') AS BIGINT) AS wer, CAST(count_if(winner = 'cer') AS BIGINT) AS cer, CAST(count_if(winner = 'tie') AS BIGINT) AS tie FROM w GROUP BY kind""")
def report_winner_counts(spark, d):
    s = E.scored(pairs(spark, d))
    return s.groupBy("kind").agg(*[F.count_if(E.winners(s, "wer", "cer") == x).alias(x) for x in ("wer", "cer", "tie")])


@R.add(f"""WITH {SCORED}, g AS (SELECT kind, sum(word_edits) / sum(n) AS a, sum(letter_edits) / sum(m) AS b FROM scored WHERE r <> '' GROUP BY kind), w AS (SELECT kind, CASE WHEN abs(a - b) < 1e-12 THEN 'tie' WHEN a < b THEN 'a' ELSE 'b' END AS x FROM g),
    p AS (SELECT max(CASE WHEN kind = 'SMALL' THEN x END) AS letter, max(CASE WHEN kind = 'MEDIUM' THEN x END) AS word, max(CASE WHEN kind = 'LARGE' THEN x END) AS sentence FROM w)
    SELECT CASE WHEN letter = 'a' AND word = 'a' AND sentence = 'b' THEN 'short_a_long_b' WHEN letter = 'a' AND word = 'a' AND sentence = 'a' THEN 'all_a' WHEN sentence = 'b' THEN 'long_b' ELSE 'mixed' END AS routing FROM p""")
def report_routing(spark, d):
    g = E.micro(pairs(spark, d), "kind").select("kind", F.col("wer").alias("a"), F.col("cer").alias("b"))
    return E.routing(g, "kind", "a", "b", ("SMALL", "MEDIUM", "LARGE"))


@R.add("""WITH g AS (SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'A' THEN CAST(l_discount > 0.05 AS INTEGER) END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN CAST(l_discount > 0.05 AS INTEGER) END) AS b FROM lineitem GROUP BY l_linestatus)
    SELECT l_linestatus, round(100 * (b - a), 6) AS delta FROM g""")
def report_deltas(spark, d):
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("hit"))
    return E.deltas(rows, "l_linestatus", "l_returnflag", "hit", "A", "R")


@R.add("SELECT event_type, event_id, CAST(place AS INTEGER) AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def report_examples_per_kind(spark, d):
    return L.ranked(table(spark, d, "events"), "event_type", F.desc("value"), "event_id", top=5).select("event_type", "event_id", "place")


@R.add(rf"""WITH x AS (SELECT p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: {FORM.format('left(p_name, i)')}) AS s FROM part),
    y AS (SELECT p_partkey, list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] <> '' AND (i = 1 OR s[i] <> s[i - 1]) THEN s[i] END), lambda z: z IS NOT NULL) AS s FROM x)
    SELECT p_partkey, array_to_string(s[1:12], '|') AS steps FROM y""")
def text_prefix_steps(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.prefix_steps("p_name", 12), "|").alias("steps"))


@R.add("""SELECT c_custkey, CASE WHEN age IS NULL THEN '' WHEN age < 13 THEN 'child' WHEN age < 18 THEN 'teen' ELSE 'adult' END AS age_group, CASE WHEN age IS NULL THEN '' WHEN age < 18 THEN 'child' ELSE 'adult' END AS speaker
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 40 END AS age FROM customer)""")
def text_age_groups(spark, d):
    age = F.when(F.col("c_custkey") % 7 > 0, (F.col("c_custkey") % 40).cast("string")).otherwise("n/a")
    return table(spark, d, "customer").select("c_custkey", T.age_group(age).alias("age_group"), T.speaker_type(age).alias("speaker"))


@R.add("SELECT CAST(p_partkey AS VARCHAR) AS stem, p_size, p_name FROM part WHERE p_partkey % 3 = 0")
def join_by_stem(spark, d):
    p = table(spark, d, "part")
    audio = p.select(F.concat(F.lit("audio/a.b/"), "p_partkey", F.lit(".wav")).alias("audio"), "p_size")
    texts = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("text/"), "p_partkey", F.lit(".txt")).alias("path"), "p_name")
    return L.by_stem(audio, texts, "audio", "path").select("stem", "p_size", "p_name")


@R.add("""WITH s AS (SELECT c_nationkey, max(c_acctbal > 9000) AS hit FROM customer GROUP BY c_nationkey) SELECT c_custkey, c.c_nationkey FROM customer c JOIN s ON s.c_nationkey = c.c_nationkey WHERE c_acctbal > 9000 OR NOT hit""")
def join_soft_filter(spark, d):
    return L.soft_filter(table(spark, d, "customer"), "c_nationkey", F.col("c_acctbal") > 9000).select("c_custkey", "c_nationkey")


@R.add("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'VIP' END, c_mktsegment) AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 AND c_acctbal > 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def join_overlay(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    top = base.where("c_custkey % 4 = 0").select("c_custkey", F.lit("VIP").alias("c_mktsegment"), F.when(F.col("c_acctbal") > 0, 0.0).alias("c_acctbal"))
    return L.overlay(base, top, "c_custkey")


@R.add("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS k, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY l_orderkey)
    SELECT coalesce(o_orderkey, l_orderkey) AS id, CASE WHEN o_orderkey IS NULL THEN 'no_parent' WHEN l_orderkey IS NULL THEN 'no_children' WHEN n <> k THEN 'repeated' WHEN low <> 1 OR high <> n THEN 'gap' ELSE 'ok' END AS state FROM orders FULL JOIN g ON o_orderkey = l_orderkey""")
def contract_children(spark, d):
    return Q.children(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "l_linenumber")


@R.add("""SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, CAST(count_if(trim(coalesce(text, '')) = '') AS BIGINT) AS blank FROM documents GROUP BY ROLLUP (lang, source)""")
def quality_rollup(spark, d):
    return Q.rolled_up(table(spark, d, "documents"), ["lang", "source"], "n_chars", "text")


@R.add("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def quality_batch(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").offset(100).limit(50)


@R.add("SELECT s_suppkey, CAST(unnest(range(1, s_nationkey % 4 + 1)) AS INTEGER) AS copy FROM supplier")
def mix_repeated(spark, d):
    return S.repeated(table(spark, d, "supplier"), F.col("s_nationkey") % 4).select("s_suppkey", "copy")


@R.add("""WITH n AS (SELECT count(*) AS n FROM nation), p AS (SELECT n_nationkey, row_number() OVER (ORDER BY sha256('12:' || ((60 - n) // n) || ':' || n_nationkey), n_nationkey) AS r FROM nation, n)
    SELECT n_nationkey, false AS oversampled FROM nation UNION ALL SELECT n_nationkey, true FROM nation, n, range((60 - n) // n) UNION ALL SELECT n_nationkey, true FROM p, n WHERE r <= (60 - n) % n""")
def mix_oversampled(spark, d):
    return S.oversampled(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 60, 12)


@R.add("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('13:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('13:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents WHERE lang = 'de'),
    w AS (SELECT least((SELECT max(n) FROM a) / 0.75::DOUBLE, (SELECT max(n) FROM b) / 0.25::DOUBLE) AS w)
    SELECT doc_id, 'a' AS source FROM a, w WHERE r <= floor(w * 0.75::DOUBLE) UNION ALL SELECT doc_id, 'b' FROM b, w WHERE r <= floor(w * 0.25::DOUBLE)""")
def mix_weighted_pair(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return S.weighted_pair(docs.where("lang = 'en'").select("doc_id"), docs.where("lang = 'de'").select("doc_id"), "doc_id", 0.75, 0.25, 13)


@R.add("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS spot FROM embeddings), r AS (SELECT vec_id, spot, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, spot) AS place FROM e)
    SELECT vec_id, string_agg(CAST(spot AS VARCHAR), ',' ORDER BY place) AS top FROM r WHERE place <= 5 GROUP BY vec_id""")
def frames_top_labels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(A.top(F.col("embedding"), 5), ",").alias("top"))
