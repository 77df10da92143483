"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import fim, fingerprints, langid, mixing, packing, phrases, pii, secrets, simhash, suffix_tree, tokens, topk, vector_dedup
from lexmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compared(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written("sketch").alias("fingerprint"), fingerprints.written("edited_sketch").alias("edited_fingerprint"),
        fingerprints.resemblance("sketch", "edited_sketch").alias("near_edited"), fingerprints.resemblance("sketch", "next_sketch").alias("near_next"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_exact_top_k, op3_lm_scoring, op4_embedding_near_dedup, op5_secret_scan,
        op6_best_fit_packing, op7_simhash_near_dedup, op8_token_counts, op9_source_mixing, op10_pii,
        op11_fill_in_middle, op12_fingerprints, op13_collocations,
    )
}

#: SQL for the operators that SQL expresses over whole tables; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings),
        s AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.own <> c.own
        ),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
        ),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id
    """,
    "op11_fill_in_middle": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
        drawn AS (
            SELECT *, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS x FROM h
        ),
        formed AS (
            SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS hi,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain'
                        WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ),
        parts AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM formed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
        placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
        grams AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM placed JOIN (VALUES (1), (2), (3), (4)) AS t(k) ON i + k - 1 <= len(ws)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        longer AS (SELECT lang, f, string_split(phrase, ' ') AS ws, k FROM f WHERE k > 2),
        inner_ AS (
            SELECT lang, f, unnest([array_to_string(ws[1 : k - 1], ' '), array_to_string(ws[2 : k], ' ')]) AS phrase FROM longer
            UNION ALL
            SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' '), array_to_string(ws[3:4], ' ')]) FROM longer WHERE k = 4
        ),
        most AS (SELECT lang, phrase, max(f) AS m FROM inner_ GROUP BY ALL),
        kept AS (SELECT f.* FROM f LEFT JOIN most USING (lang, phrase) WHERE k > 1 AND (m IS NULL OR 100 * CAST(m AS HUGEINT) < 80 * CAST(f AS HUGEINT))),
        cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, k, unnest(range(1, k)) AS c FROM kept),
        scored AS (
            SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:c], ' ')
            JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[c + 1 : cuts.k], ' ')
        ),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
}
