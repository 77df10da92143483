"""Queries: rows by place, and sounds from frames to a decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import frames as A
from lexmill.operators import acoustics as S
from lexmill.operators import positions as N
from lexmill.plans.common import Registry, table

R = Registry()


@R.add("""WITH s AS (SELECT s_name, row_number() OVER () - 1 AS place FROM supplier), p AS (SELECT p_name, row_number() OVER () - 1 AS place FROM part)
    SELECT place, s_name, p_name FROM s FULL JOIN p USING (place)""")
def positions_side_by_side(spark, d):
    return N.side_by_side(table(spark, d, "supplier").select("s_name"), table(spark, d, "part").select("p_name"))


@R.add("""WITH p AS (SELECT p_partkey, p_name, row_number() OVER () - 1 AS place FROM part), d AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || place), place) AS r FROM p)
    SELECT p_partkey, p_name, place FROM d WHERE r <= 100""")
def positions_sample_in_order(spark, d):
    return N.sampled_in_order(table(spark, d, "part").select("p_partkey", "p_name"), 100, 42)


MODEL = ["<pad>", "ɑ", "b", "d", "i", "k", "s", "t"]
SAID = ["bead", "seat", "keep", "", "dad", "teak", "beat", "deed"]


@R.add(f"""WITH said(pick, word, phones, a1, a2, a3, lacking) AS (VALUES (0, 'bead', 'B IY D', 2, 4, 3, ''), (1, 'seat', 'S IY T', 6, 4, 7, ''), (2, 'keep', 'K IY P', 0, 0, 0, 'P'), (3, '', '', 0, 0, 0, ''),
        (4, 'dad', 'D AE D', 0, 0, 0, 'AE'), (5, 'teak', 'T IY K', 7, 4, 5, ''), (6, 'beat', 'B IY T', 2, 4, 7, ''), (7, 'deed', 'D IY D', 3, 4, 3, '')),
    rows AS (SELECT vec_id, word, phones, a1, a2, a3, lacking, ({SAID})[(vec_id + vec_id % 3) % 8 + 1] AS raw, vec_id % 11 = 0 AS odd, vec_id % 13 = 0 AS poor,
        list_transform(range(0, 8), lambda f: list_transform(embedding[f * 8 + 1 : f * 8 + 8], lambda x: 10 * CAST(x AS DOUBLE))) AS fr FROM embeddings JOIN said ON pick = vec_id % 8 WHERE len(embedding) = 64),
    ready AS (SELECT * FROM rows WHERE a1 > 0 AND NOT odd AND NOT poor),
    ahead AS (SELECT vec_id, list_transform([a1, a2, a3], lambda l: list_transform(range(0, 9), lambda t: coalesce(list_sum(list_transform(range(0, t), lambda f: fr[f + 1][l + 1] - fr[f + 1][1])), 0))) AS s FROM ready),
    ways AS (SELECT a.t AS a, b.t AS b, c.t AS c, d.t AS d, e.t AS e, f.t AS f FROM range(0, 9) a(t), range(0, 9) b(t), range(0, 9) c(t), range(0, 9) d(t), range(0, 9) e(t), range(0, 9) f(t) WHERE a.t < b.t AND b.t <= c.t AND c.t < d.t AND d.t <= e.t AND e.t < f.t),
    best AS (SELECT vec_id, arg_max([a, b, c, d, e, f], s[1][b + 1] - s[1][a + 1] + s[2][d + 1] - s[2][c + 1] + s[3][f + 1] - s[3][e + 1]) AS w FROM ahead CROSS JOIN ways GROUP BY vec_id),
    parts AS (SELECT vec_id, fr, [a1, a2, a3] AS own, p, ([a1, a2, a3])[p] AS l, w[2 * p - 1] AS x, w[2 * p] AS y FROM ready JOIN best USING (vec_id), (VALUES (1), (2), (3)) t(p)),
    means AS (SELECT *, list_transform(range(0, 8), lambda l2: list_sum(list_transform(range(x, y), lambda f: fr[f + 1][l2 + 1])) / (y - x)) AS m FROM parts),
    rivals AS (SELECT *, list_filter(range(1, 8), lambda l2: NOT list_contains(own, l2)) AS others FROM means),
    won AS (SELECT *, list_max(list_transform(others, lambda l2: m[l2 + 1])) AS top FROM rivals),
    scored AS (SELECT vec_id, p, x, y, round(1 / (1 + exp(top - m[l + 1])), 6) AS score, ({MODEL})[list_filter(others, lambda l2: m[l2 + 1] = top)[1] + 1] AS rival FROM won),
    told AS (SELECT vec_id, list_sum(list(score)) / 3 AS score, arg_min(p, score * 10 + p * 1e-9) AS low, string_agg(x || '-' || y, ' ' ORDER BY p) AS spans, arg_min(rival, score * 10 + p * 1e-9) AS nearest, list(score ORDER BY p) AS each FROM scored GROUP BY vec_id),
    joined AS (SELECT rows.*, t.score, low, spans, nearest, each, CASE WHEN word = '' AND raw = '' THEN 1 WHEN word = '' OR raw = '' THEN 0 ELSE round(greatest(0, 1 - levenshtein(word, raw) / length(word)), 6) END AS support FROM rows LEFT JOIN told t USING (vec_id)),
    said2 AS (SELECT *, score IS NOT NULL AND score >= 0.6 AND each[1] >= 0.8 AND each[3] >= 0.8 AND each[2] < 0.8 AND nearest IN ('i', 'iː') AS helped FROM joined)
    SELECT vec_id, CASE WHEN word = '' THEN 'skipped_no_expected_text' WHEN odd THEN 'skipped_unsupported_prompt_type' WHEN poor THEN 'skipped_bad_audio' WHEN a1 = 0 THEN 'alignment_failed' WHEN score >= 0.75 THEN 'accepted_by_pronunciation_evidence'
            WHEN helped THEN 'accepted_by_short_word_gop_structure' ELSE 'rejected_low_gop' END AS decision,
        CASE WHEN word = '' THEN 'expected_text is missing' WHEN odd THEN 'unsupported prompt type: picture' WHEN poor THEN 'audio quality flag clipped is true' WHEN a1 = 0 THEN 'phoneme token not found in model vocabulary: ' || lacking END AS reason,
        round(score, 6) AS score, CASE WHEN score IS NOT NULL THEN round((score + support) / 3, 6) END AS confidence, phones, spans,
        CASE WHEN score IS NULL THEN 'failed' WHEN score >= 0.25 THEN 'usable' ELSE 'low_confidence' END AS quality, string_split(phones, ' ')[low] AS weakest, nearest FROM said2""")
def phones_pronounced(spark, d):
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.transform(A.doubles(F.slice("embedding", f * 8 + 1, F.lit(8))), lambda x: x * 10))
    k, pick = F.col("vec_id"), F.array(*map(F.lit, SAID))
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(
        "vec_id", F.element_at(pick, (k % 8 + 1).cast("int")).alias("expected"), F.element_at(pick, ((k + k % 3) % 8 + 1).cast("int")).alias("raw"), F.when(k % 11 == 0, "picture").otherwise("word").alias("kind"),
        F.when(k % 13 == 0, F.array(F.lit("clipped"))).alias("flags"), cut.alias("frames"))
    none = spark.createDataFrame([], "word string, variant int, phones array<string>")
    out = S.pronounced(rows, ["vec_id"], "frames", MODEL, 0, none, raw="raw", flags="flags")
    spans = F.array_join(F.transform("scores", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), " ")
    return out.select("vec_id", "decision", "reason", "score", "confidence", F.array_join("phones", " ").alias("phones"), spans.alias("spans"), "quality", "weakest", "nearest")
