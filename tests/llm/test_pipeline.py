import importlib
import random
import subprocess
import sys
from collections import Counter

import corpus_pipeline as pipeline
from lexmill.llm import langid, packing, pii
from lexmill.llm.queries import QUERIES
from tests.llm.test_operators import brute_components, brute_print, odd_documents

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    unique = stages["simhash_near_dedup"](spark, kept, SF)
    rows = [(r.doc_id, brute_print(r.text)) for r in kept.collect()]
    root = brute_components({p for _, p in rows}, [(a, b) for _, a in rows for _, b in rows if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for d, p in rows:
        least[root[p]] = min(d, least.get(root[p], d))
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(least.values())
    clean = stages["pii"](spark, unique, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in clean.collect():
        assert not pii.spans(r.text)[0] and r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or pii.spans(texts[r.doc_id])[1]
    mixed = stages["source_mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and set(r.doc_id for r in mixed.collect()) <= set(least.values())
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = stages["best_fit_packing"](spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_and_odd_rows(spark, tmp_path):
    odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert langid and packing


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_the_rest_imports_without_this_subpackage():
    code = "import sys; sys.modules['lexmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and not any(n.startswith('op') for n in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("corpus_pipeline").__file__.rpartition("/")[0])


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_text(spark):
    a, b = "one two three four five six seven eight", "red green blue white black brown pink grey"
    c = "to be or not to be that is the question"
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (None, a, "s"), (None, c, "s"), (None, c, "s"), (None, c, "t"), (7, b, "t"), (5, b, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = [(3, a), (5, b), (None, c)]
    for _ in range(2):
        kept = pipeline.near_dedup(spark, docs, SF)
        assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_language_stage_rejects_long_junk_and_other_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    away = [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1000)), "".join(rng.choice("0123456789abcdef") for _ in range(1000)), "xyz " * 200,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    ]
    stay = ["The", "Von.", "That it.", "Des enberge die enver."]
    for languages in (["en", "de", "fr", "es"], ["en", "de"]):
        learned = docs.where(docs["lang"].isin(languages)).select("doc_id", "text", "lang")
        extra = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(away + stay)], "doc_id long, text string, lang string")
        kept = {r.text for r in pipeline.language(spark, learned.unionByName(extra), SF).where("doc_id < 0").collect()}
        assert kept == set(stay), languages
