"""Fill-in-middle, fingerprints and collocations against brute force, and their defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import fim, fingerprints, phrases, queries
from tests.llm.test_operators import SF, odd_documents


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


# --- 11: fill-in-middle


def units(text, unit):
    pattern = {"character": r"(?s).", "word": r"[^\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    return [m.start() for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_units_sentinels_and_cuts(unit):
    rng, a = random.Random(unit), fim.Automaton(unit)
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "b", " ", "\n", "é", "漢", "😀", "<", "<P>", "P", ">", "<M", "\t"]) for _ in range(rng.choice([0, 1, 3, 20, 900]))) for _ in range(30)]
        raw = [t.encode() for t in texts]
        bounds = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        n, met, scanned = a.scan(data, bounds)
        assert n.tolist() == [len(units(t, unit)) for t in texts]
        assert met.tolist() == [sum(t.count(s) for s in fim.SENTINELS) for t in texts]
        after = np.array([rng.randrange(x + 1) for x in n.tolist()])
        places = a.cuts(data, scanned, after)
        for t, b, at, low, k in zip(texts, raw, places.tolist(), bounds.tolist(), after.tolist(), strict=False):
            assert len(b[: at - low].decode()) == (0 if k == 0 else [*units(t, unit), len(t)][k])


def test_sentinels_that_could_be_misread_are_refused():
    for bad in (("ab", "ba", "x"), ("a", "a", "b"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.Automaton("character", bad)
    with pytest.raises(ValueError):
        fim.Automaton("page")


@pytest.mark.parametrize("unit, sentinels", [("character", fim.SENTINELS), ("word", ("<|pre|>", "<|suf|>", "<|mid|>")), ("line", fim.SENTINELS)])
def test_every_text_is_restored(spark, odd, unit, sentinels):
    texts = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(300 + i, t) for i, t in enumerate(["<P>", "a<S>b", "<|mid|>", "<", "<P", ">P<", "é<M>", " ", "\n\n", "<<P<S"])], "doc_id long, text string"))
    got = fim.transform(texts.repartition(3), unit, sentinels=sentinels)
    rows = got.withColumn("back", fim.restored("output", "form", sentinels)).collect()
    assert Counter((r.doc_id, r.back) for r in rows) == Counter((r.doc_id, r.text or "") for r in texts.collect())
    for r in rows:
        assert r.n == len(units(r.back, unit))
        if r.form != "plain":
            p, m = r.back[: r.prefix_chars], r.back[r.prefix_chars : r.prefix_chars + r.middle_chars]
            s, (P, S, M) = r.back[len(p) + len(m) :], sentinels
            assert r.output == (P + p + S + s + M + m if r.form == "psm" else S + s + P + p + M + m)
            assert all(x in (0, len(r.back), *units(r.back, unit)) for x in (len(p), len(p) + len(m)))
        else:
            assert (r.prefix_chars, r.middle_chars, r.output) == (None, None, r.back)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_transform_of_an_empty_table_and_of_one_long_text(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "ab é漢 " * 900_000
    row = fim.transform(spark.createDataFrame([(2, text)], "doc_id long, text string"), plain=0).withColumn("back", fim.restored("output", "form")).first()
    assert row.back == text and row.n == len(text) and row.form != "plain"


# --- 12: fingerprints


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_shingle_hashes_tell_shingles_apart():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "C", "été", "ab"]) + rng.choice(["", "\t", "\n "]) for _ in range(rng.randrange(12))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    hashes, at = fingerprints.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    seen = {}
    for i, t in enumerate(texts):
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(set(own)) == len(shingles(t))
        for h in own:
            seen.setdefault(h, set()).update(shingles(t) if len(shingles(t)) == 1 else ())
    assert all(len(s) <= 1 for s in seen.values())


def test_sketches_estimate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    k = fingerprints.K
    rows = fingerprints.compared(docs).withColumns({
        "alike": fingerprints.resemblance("sketch", "edited_sketch"), "held": fingerprints.containment("sketch", "edited_sketch"),
        "kinds": fingerprints.distinct_shingles("sketch"), "both": fingerprints.merged("sketch", "edited_sketch"),
    }).collect()
    assert len(rows) == docs.count()
    off = []
    for r in rows:
        a, b = shingles(r.text), shingles(r.edited)
        assert len(r.sketch) == min(k, len(a)) and r.sketch == sorted(set(r.sketch)) and len(r.both) == min(k, len(a | b))
        off.append((r.alike - likeness(a, b), r.kinds / max(1, len(a)) - 1, r.held - len(a & b) / max(1, len(a))))
        if len(a | b) < k:
            assert abs(off[-1][0]) < 1e-12 and r.kinds == len(a)
    off = np.array(off)
    assert np.abs(off.mean(axis=0)).max() < 0.02 and off.std(axis=0)[0] < 0.05 and np.abs(off[:, 0]).max() < 0.2


def test_next_documents(spark):
    rng = random.Random(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (0, 1, 2, 200):
            rows = [(i * 7 - 300, " ".join(rng.choice("ab cd é") for _ in range(rng.randrange(9)))) for i in range(n)]
            rng.shuffle(rows)
            order = sorted(rows, reverse=True)
            want = {r[0]: (r[1], order[(i + 1) % n][1]) for i, r in enumerate(order)}
            for parts in (1, 3, 40):
                spark.conf.set("spark.sql.shuffle.partitions", parts)
                got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
                assert len(got) == n and {r.doc_id: (r.text, r.next_text) for r in got} == want
        # Ties: null ids last, equal rows follow one another.
        rows = [(1, "a")] * 50 + [(1, "b")] * 30 + [(None, None)] * 20 + [(0, "z")]
        for parts in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = Counter(tuple(r) for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
            assert sum(got.values()) == 101 and got[(1, "a", "a")] == 49 and got[(1, "b", "b")] == 29 and got[(None, "", "")] == 19 and got[(0, "z", "")] == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprint_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in queries.op12_fingerprints(spark, SF).collect()}
    assert set(got) == set(docs)
    import hashlib

    prints, sketch = {}, lambda s: {s[i : i + 16] for i in range(0, len(s), 16)}
    for i, d in enumerate(order):
        text, after = docs[d], docs[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(r.fingerprint, shingles(text)) == shingles(text)
        assert abs(r.near_edited - likeness(shingles(text), shingles(edited))) < 0.2
        other = sketch(got[order[(i + 1) % len(order)]].fingerprint)
        both = sorted(sketch(r.fingerprint) | other)[: fingerprints.K]
        assert abs(r.near_next - (sum(x in other and x in sketch(r.fingerprint) for x in both) / len(both) if both else 1)) < 1e-9


def test_sketches_merge(spark, odd):
    rows = odd.select("doc_id", "source", "text", fingerprints.sketches("text", 8).alias("sketch"))
    got = {r.source: r.sketch for r in fingerprints.merged_by(rows, ["source"], k=8).collect()}
    held = {}
    for r in rows.collect():
        held.setdefault(r.source, set()).update(r.sketch)
    assert got == {s: sorted(h)[:8] for s, h in held.items()}
    empty = spark.createDataFrame([(None, [])], "a array<long>, b array<long>")
    one = empty.select(fingerprints.resemblance("a", "b"), fingerprints.containment("a", "b"), fingerprints.distinct_shingles("a"), fingerprints.resemblance("b", F.array(F.lit(3).cast("long")))).first()
    assert tuple(one) == (1.0, 1.0, 0.0, 0.0)


# --- 13: collocations


def brute_phrases(rows, least, longest=4, inside=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {q for p, a in found.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * a >= inside * f[q := (p[0], *p[i:j])]}
    ranked = {}
    for p, a in found.items():
        if p not in gone:
            score, k = min((2000000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            ranked.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in ranked.items() for i, x in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("parts", [2, 64])
def test_collocations_against_brute_force(spark, parts, monkeypatch):
    rng = random.Random(3)
    words = ["the", "of", "Été", "x", "y", "zz", "the", "the", "of", " q", "the\x01", "of\x00", " "]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(300)]
    rows += [(None, "en"), ("", "xx"), ("...", "xx"), ("the of " * 3000, "en")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        # With few parts hardly a prefix is split; with many, most of the frequent ones are, down to three words.
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
        for least, top in ((2, 2000), (30, 5)):
            assert sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top).collect()) == brute_phrases(rows, least, top=top)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one", None)], "text string, lang string")).count() == 0


def test_keys_and_stack():
    assert phrases._key((b"a", b"b", b"c"), set()) == (b"a", b"b c")
    assert phrases._key((b"a", b"b", b"c"), {b"a", b"a b"}) == (b"a b c", b"")
    assert phrases._key((b"a",), {b"a"}) == (b"a", b"")
    done = []
    stack = phrases.Stack(lambda words, n: done.append((b" ".join(words), n)))
    for s, n in ((b"b c", 2), (b"b", 1), (b"a b c", 1), (b"a b", 3)):
        stack.push(s.split(), n)
    stack.pop(0)
    assert done == [(b"b c", 2), (b"b", 3), (b"a b c", 1), (b"a b", 4), (b"a", 4)]


# --- 6, 8: pre-tokens as the library has them


def test_tokens_of_every_code_point():
    """The library and the regex package know different versions of Unicode; counts and ids are the library's all the same."""
    import array

    from lexmill.llm import tokens

    c = tokens.counter(tokens.vocabulary("byte_bpe_50k.json"))
    for form in ("{}'s", "a{}1", " {}'ll"):
        strings = [form.format(chr(p)) for p in range(0x80, 0x30000, 1) if not 0xD800 <= p < 0xE000]
        for s, e in zip(strings, c.library.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            assert c.encode(s) == array.array("I", e.ids).tobytes() and c.count(s) == len(e.ids), s
    assert c.count("՘'ll") == len(c.library.encode("՘'ll", add_special_tokens=False).ids)
