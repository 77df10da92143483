"""Queries: joins and rules, data quality, sampling and splits, frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import frames as A
from lexmill.functions import kernels
from lexmill.functions import text as T
from lexmill.operators import lookup as L
from lexmill.operators import quality as Q
from lexmill.operators import sampling as S
from lexmill.plans.common import PAIRS, Registry, pairs, table

R = Registry()


@R.add("""SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, CASE WHEN l.doc_id IS NULL THEN 'prompt_not_found' ELSE 'ready' END AS row_status
    FROM documents d LEFT JOIN (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1) l ON l.doc_id = d.doc_id""")
def join_first_match(spark, d):
    labels = table(spark, d, "labels").withColumn("o", F.struct("quality", "toxic"))
    return L.first_match(table(spark, d, "documents").select("doc_id", "lang"), labels, "doc_id", "o").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "row_status")


@R.add("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_missing_keys(spark, d):
    return L.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


BANDS = [("very_low", -1000.0, 0.0), ("low", 0.01, 2500.0), ("middle", 2500.01, 5000.0), ("high", 5000.01, 7500.0), ("top", 7500.01, 10000.0)]


@R.add(f"SELECT c_custkey, band FROM customer LEFT JOIN (VALUES {', '.join(map(str, BANDS))}) b(band, low, high) ON c_acctbal BETWEEN low AND high")
def join_score_band(spark, d):
    bands = spark.createDataFrame(BANDS, "band string, least double, most double")
    return L.band(table(spark, d, "customer"), "c_acctbal", bands).select("c_custkey", "band")


RULES = [("AUTOMOBILE", "ANY", "a"), ("BUILDING", "0", "b"), ("BUILDING", "ANY", "c"), ("FURNITURE", "7", "d"), ("HOUSEHOLD", "ANY", "e"), ("MACHINERY", "3", "f")]


@R.add(f"""WITH r(seg, n, o) AS (VALUES {', '.join(map(str, RULES))})
    SELECT c_custkey, coalesce(x.o, y.o) AS outcome FROM customer LEFT JOIN r x ON x.seg = c_mktsegment AND x.n = CAST(c_nationkey AS VARCHAR) LEFT JOIN r y ON y.seg = c_mktsegment AND y.n = 'ANY'""")
def join_wildcard_rules(spark, d):
    rules = spark.createDataFrame(RULES, "segment string, rule_nation string, outcome string")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return L.wildcard(rows, rules, "segment", "nation").select("c_custkey", "outcome")


LEXICON = {"small": "S M AO L", "red": "R EH D", "blue": "B L UW", "ring": "R IH NG", "bolt": "B OW L T"}


@R.add(f"""WITH x(word, p) AS (VALUES {', '.join(f"('{w}', '{p}')" for w, p in LEXICON.items())}), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
    g AS (SELECT p_partkey, count(*) AS n, count(p) AS k, string_agg(p, ' ' ORDER BY pos) AS phones FROM w LEFT JOIN x USING (word) GROUP BY p_partkey)
    SELECT p_partkey, CASE WHEN n = k THEN phones ELSE '' END AS phones FROM g""")
def join_lexicon(spark, d):
    lexicon = spark.createDataFrame([(w, p.split(" ")) for w, p in LEXICON.items()], "word string, phones array<string>")
    texts = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return L.pronounced(texts, "words", lexicon, "p_partkey").select("p_partkey", F.array_join("phones", " ").alias("phones"))


@R.add("SELECT l_orderkey, l_linenumber, max_by(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def join_last_rule(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("o"))
    return L.last_rule(rows, ["l_orderkey", "l_linenumber"], "o").select("l_orderkey", "l_linenumber", "l_partkey")


def _rules():
    tags = F.size(F.regexp_extract_all("html", F.lit("<script"), F.lit(0)))
    words = T.word_count(F.regexp_replace("html", "<[^>]*>", " "))
    return [("missing_payload", F.col("url").isNull()), ("empty_text", T.blank("html")), ("out_of_range", ~F.length("html").between(300, 20000)), ("unsupported_tag", tags > 1), ("too_few_words", words < 80)]


CASES = r"""CASE WHEN url IS NULL THEN 'missing_payload' WHEN trim(coalesce(html, '')) = '' THEN 'empty_text' WHEN NOT length(html) BETWEEN 300 AND 20000 THEN 'out_of_range'
    WHEN len(regexp_extract_all(html, '<script')) > 1 THEN 'unsupported_tag' WHEN len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) < 80 THEN 'too_few_words' END"""


@R.add(f"SELECT page_id, {CASES} AS reason FROM pages")
def quality_first_reason(spark, d):
    return table(spark, d, "pages").select("page_id", Q.first_reason(*_rules()).alias("reason"))


@R.add(f"SELECT coalesce({CASES}, 'accepted') AS reason, count(*) AS n FROM pages GROUP BY 1")
def quality_reason_counts(spark, d):
    return Q.reason_counts(table(spark, d, "pages"), *_rules())


@R.add("""SELECT o_orderkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL), '|'), ''), 'ok') AS flags FROM orders""")
def quality_flags(spark, d):
    return table(spark, d, "orders").select("o_orderkey", Q.flags(("cheap", F.col("o_totalprice") < 50000), ("pending", F.col("o_orderstatus") == "P"), ("urgent", F.col("o_orderpriority").like("1%"))).alias("flags"))


@R.add("SELECT col, band, count(*) AS n FROM (SELECT col, CASE WHEN value IS NULL THEN 'missing' WHEN value < 0.03 THEN 'low' WHEN value < 0.07 THEN 'medium' ELSE 'high' END AS band FROM (UNPIVOT (SELECT l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME col VALUE value)) GROUP BY col, band")
def quality_histogram(spark, d):
    return Q.histogram(table(spark, d, "lineitem"), ["l_discount", "l_tax"], 0.03, 0.07)


@R.add("SELECT 'lang' AS col, coalesce(lang, '') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, ''), count(*) FROM documents GROUP BY 2")
def quality_value_counts(spark, d):
    return Q.value_counts(table(spark, d, "documents"), "lang", "source")


@R.add("SELECT text, count(*) AS n FROM conversations GROUP BY text HAVING count(*) > 1")
def quality_duplicates(spark, d):
    return Q.duplicates(table(spark, d, "conversations"), "text")


@R.add("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def quality_invalid_values(spark, d):
    return Q.invalid_values(table(spark, d, "events"), "event_type", ["view", "click", "purchase"])


@R.add(r"SELECT count(*) AS rows, CAST(count_if(trim(text) = '') AS BIGINT) AS blank_texts, count(text) - count(DISTINCT text) AS repeated_keys, round(avg(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?'))), 6) AS mean_words FROM conversations")
def quality_coverage(spark, d):
    return Q.coverage(table(spark, d, "conversations"), "text", "text")


@R.add("""SELECT l_returnflag, count_if(l_quantity > 30) / count(*) AS big, count_if(l_discount > 0.05) / count(*) AS cut,
    CASE WHEN count_if(l_quantity > 30) / count(*) > 0.5 OR count_if(l_discount > 0.05) / count(*) > 0.6 THEN 'train' WHEN count_if(l_quantity > 30) / count(*) > 0.3 OR count_if(l_discount > 0.05) / count(*) > 0.4 THEN 'review' ELSE 'keep' END AS verdict FROM lineitem GROUP BY l_returnflag""")
def quality_decision(spark, d):
    rates = table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.count_if(F.col("l_quantity") > 30) / F.count("*")).alias("big"), (F.count_if(F.col("l_discount") > 0.05) / F.count("*")).alias("cut"))
    return Q.decision(rates, {"big": (0.5, 0.3), "cut": (0.6, 0.4)}).select("l_returnflag", "big", "cut", "verdict")


@R.add("SELECT p_brand, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS share FROM part GROUP BY p_brand, p_type")
def quality_shares(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")), 6))


def _draw(seed, *keys):
    return f"sha256('{seed}:' || {chr(32).join(f'CAST({k} AS VARCHAR)' for k in keys)})"


@R.add(f"SELECT doc_id FROM documents ORDER BY {_draw(7, 'doc_id')}, doc_id LIMIT 100")
def sample_stable(spark, d):
    return S.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


@R.add(f"SELECT source, doc_id, place FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY {_draw(8, 'doc_id')}, doc_id) AS INTEGER) AS place FROM documents) WHERE place <= 5")
def sample_per_source(spark, d):
    return S.per_group(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5, 8)


@R.add(f"""WITH g AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT count(*) AS n FROM g), k AS (SELECT *, row_number() OVER (ORDER BY {_draw(9, 'o_custkey')}, o_custkey) AS r FROM g, n)
    SELECT o_custkey, CASE WHEN r <= greatest(1, round_even(n * 0.1, 0)) THEN 'test' WHEN r <= 2 * greatest(1, round_even(n * 0.1, 0)) THEN 'valid' ELSE 'train' END AS split FROM k""")
def split_by_group(spark, d):
    return S.group_split(table(spark, d, "orders"), "o_custkey", 9)


@R.add(f"""WITH k AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_draw(10, 'c_custkey')}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_mktsegment, c_custkey, CASE WHEN r <= least(greatest(1, CAST(round(n * (1 - 0.8)) AS INTEGER)), n - 1) THEN 'evaluation' ELSE 'train' END AS split FROM k""")
def split_stratified(spark, d):
    return S.stratified_holdout(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 10)


@R.add(f"""WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT s_suppkey, CAST(unnest(range(0, 250 // n + 1)) AS INTEGER) AS cycle FROM supplier, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY sha256('11:' || cycle || ':' || s_suppkey), s_suppkey) AS p FROM c)
    SELECT s_suppkey, cycle FROM r, n WHERE cycle < 250 // n OR p <= 250 % n""")
def sample_virtual_epoch(spark, d):
    return S.virtual_epoch(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 250, 11)


@R.add("SELECT text, min(conv_id * 1000 + turn) AS first_key, arg_min(role, conv_id * 1000 + turn) AS role FROM conversations GROUP BY text")
def distinct_first(spark, d):
    rows = table(spark, d, "conversations").select("text", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("first_key"))
    return S.first_of(rows, ["text"], "first_key").select("text", "first_key", "role")


@R.add("""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r(lang, ratio) AS (VALUES ('en', 0.45::DOUBLE), ('de', 0.3::DOUBLE), ('fr', 0.15::DOUBLE), ('es', 0.1::DOUBLE)),
    t AS (SELECT *, floor(min(n / ratio) OVER ()) AS total FROM s JOIN r USING (lang)), k AS (SELECT *, CAST(floor(total * ratio) AS BIGINT) AS take FROM t)
    SELECT lang, CAST(take + CASE WHEN row_number() OVER (ORDER BY ratio DESC, lang) = 1 THEN total - sum(take) OVER () ELSE 0 END AS BIGINT) AS take FROM k""")
def mix_feasible(spark, d):
    sizes = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return S.feasible_mix(sizes, "lang", "n", {"en": 0.45, "de": 0.3, "fr": 0.15, "es": 0.1})


@R.add("SELECT DISTINCT text FROM documents WHERE text IN (SELECT text FROM benchmark)")
def split_leaks(spark, d):
    return S.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), "text")


@R.add("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 6) AS rms, len(list_filter(embedding, lambda x: abs(x) >= 0.2)) / len(embedding) AS clipped,
    CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best, round(list_sort(embedding, 'DESC')[1]::DOUBLE - list_sort(embedding, 'DESC')[2]::DOUBLE, 6) AS margin FROM embeddings""")
def frames_levels(spark, d):
    v = table(spark, d, "embeddings").withColumn("v", A.doubles(F.col("embedding")))
    w = F.col("v")
    return v.select("vec_id", F.round(A.rms(w), 6).alias("rms"), A.clipped(F.col("embedding"), 0.2).alias("clipped"), A.argmax(w).alias("best"), F.round(A.margin(w), 6).alias("margin"))


@R.add("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) AS best_log_prob FROM e""")
def frames_log_softmax(spark, d):
    v = table(spark, d, "embeddings").withColumn("v", A.doubles(F.col("embedding")))
    return v.select("vec_id", F.round(F.array_max(A.log_softmax(F.col("v"))), 6).alias("best_log_prob"))


@R.add("""WITH x AS (SELECT l_orderkey, list(l_linenumber % 3 ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 OR a[i] <> a[i - 1] THEN a[i] END), lambda x: x IS NOT NULL AND x <> 0), ',') AS labels FROM x""")
def frames_greedy_decode(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    labels = F.transform("a", lambda y: y["l_linenumber"] % 3)
    return x.select("l_orderkey", F.array_join(A.collapsed(labels, F.lit(0)), ",").alias("labels"))


def _frames(spark, d):
    """Each vector as 16 frames of 4 label scores."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: A.log_softmax(F.transform(F.slice("v", i * 4 + 1, F.lit(4)), lambda x: x * 20)))
    return table(spark, d, "embeddings").withColumn("v", A.doubles(F.col("embedding"))).select("vec_id", "label", cells.alias("frames"))


@R.add()
def frames_forced_alignment(spark, d):
    labels = F.array(F.col("label") % 3 + 1, F.lit(1), F.lit(3))
    f = kernels.over(_frames(spark, d).withColumns({"labels": labels, "blank": F.lit(0)}), "vec_id", kernels.forced_alignment, "frames", "labels", "blank")
    at = lambda p: F.concat_ws(":", p["label"].cast("string"), p["start"].cast("string"), p["stop"].cast("string"))
    mean = A.total(F.transform("parts", lambda p: p["score"])) / F.size("parts")
    return f.select("vec_id", F.array_join(F.transform("parts", at), ",").alias("parts"), F.round(A.sigmoid(mean), 6).alias("confidence"))


@R.add()
def frames_beam_search(spark, d):
    f = kernels.over(_frames(spark, d).withColumns({"blank": F.lit(0), "width": F.lit(8)}), "vec_id", kernels.beam_search, "frames", "blank", "width")
    return f.select("vec_id", F.array_join("parts", ",").alias("labels"))
