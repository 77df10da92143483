"""The operators against brute force on small tables, and their defined cases."""

import math
import os
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import common, langid, mixing, packing, simhash, suffix_tree, tokens, topk, vector_dedup
from lexmill.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, label int"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like results."""
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "été", "über"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 40))), rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", "s3", None]), 5, 0.5, "x", 1) for i in range(60)]
    rows += [(100, None, "aa", "s1", None, None, None, None), (101, "", "bb", None, 0, None, None, None), (102, "1234 !?", "aa", "s2", 0, None, None, None), (103, "x", None, None, None, None, None, None)]
    rows += [(104, "long text here " * 4000, "aa", "s1", 0, None, None, None), (None, "no id at all", "bb", "s2", 0, None, None, None)]
    rows += [rows[3], rows[3], rows[7], (105, rows[3][1], "aa", "s1", 0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


# --- connected components


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")).collect()}
    want = brute_components({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7: SimHash


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_meet_every_close_pair():
    masks = simhash.masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_simhash_against_brute_force(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    prints = defaultdict(list)
    for d, t in rows:
        prints[brute_print(t)].append(d)
    fps = sorted(prints)
    root = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = defaultdict(lambda: math.inf)
    for fp, ids in prints.items():
        least[root[fp]] = min([least[root[fp]], *[i for i in ids if i is not None]])
    for r in got:
        want = least[root[int(r.fingerprint, 16)]]
        assert r.component_id == (None if want == math.inf else want)
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((d or -1, f"{brute_print(t):016x}") for d, t in rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4, 1024])
def test_crowded_buckets_link_like_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ 7 for f in list(fps)[:20]} | {f ^ 3 for f in list(fps)[:20]}
    links = simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"))
    got = brute_components(fps, [(r.a % 2**64, r.b % 2**64) for r in links.collect()])
    want = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    groups = lambda roots: sorted(sorted(n for n in fps if roots[n] == r) for r in set(roots.values()))
    assert groups(got) == groups(want)


# --- 2 and 4: vectors


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    centers = rng.standard_normal((6, 24))
    for i in range(400):
        v = centers[i % 6] + rng.standard_normal(24) * rng.choice([0.02, 0.08, 2.0])
        v = v * 10.0 ** rng.integers(-1, 2)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 6 == 0)))
    rows += [(400 + i, rows[8][1], rows[8][2]) for i in range(30)]
    bad = [(500, None, 0), (501, [], 0), (502, [0.0] * 24, 0), (503, [math.nan] + [1.0] * 23, 0), (504, [None] + [1.0] * 23, 0), (505, [math.inf] + [1.0] * 23, 1), (506, rows[8][1], None), (507, [1.0, 2.0], 0), (520, [0.0] * 24, 1)]
    return rows, bad, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x"))


@pytest.mark.parametrize("block", [16, 512])
def test_vector_dedup_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows, bad, df = vectors(spark)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    ids = [r[0] for r in rows]
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() > 500
    root = brute_components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    right = sum(got[i].n_links == near[k].sum() and got[i].component_id == root[i] for k, i in enumerate(ids))
    assert right >= 0.99 * len(ids)
    found = sum(got[i].n_links for i in ids)
    assert 0.99 * near.sum() <= found <= near.sum()
    for i, *_ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("slab", "bucket", "steep"), [(16_384, 512, 0.8), (40, 8, 0.8), (40, 8, -2.0), (40, 8, 9.0)])
def test_top_k_against_brute_force(spark, monkeypatch, slab, bucket, steep):
    for name, value in (("SLAB", slab), ("BUCKET", bucket), ("STEEP", steep), ("BLOCK", 10)):
        monkeypatch.setattr(topk, name, value)
    rows, bad, df = vectors(spark)
    again = [(20, rows[33][1], 0), (20, rows[20][1], 0), (21, rows[40][1], 0), (40, rows[41][1], 1)]
    df = df.union(spark.createDataFrame(again, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")))
    real = [(i, np.floor(np.array(v) * 64)) for i, v, _ in rows + bad + again if v and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in real)
    real = [(i, np.pad(v, (0, width - len(v)))) for i, v in real]
    want = []
    for own, (q, asked) in enumerate(real):
        if q % 20 == 0:
            order = sorted((-int(v @ asked), i) for other, (i, v) in enumerate(real) if other != own)[:20]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(order, 1)]
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0, 20).collect())) == sorted(want)
    huge = spark.createDataFrame([(20 * i, [4e6 + i] * 4) for i in range(3)], "vec_id long, embedding array<double>")
    big = {(r.query_id, r.rank): r.score for r in topk.top_k(huge, F.col("id") % 20 == 0, 20).collect()}
    assert big[0, 1] == 4 * 256_000_000 * 256_000_128 and big[20, 1] == 4 * 256_000_064 * 256_000_128
    wide = [(0, [5e6, 0.0]), (20, [1.0, 1.0]), (21, [3e14, -1.0]), (22, [-2e30, 1e300]), (23, [1e308, 1e-3])]
    large = {(r.query_id, r.vec_id): r.score for r in topk.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 20).collect()}
    assert (large[0, 20], large[0, 21]) == (20_480_000_000, 2**63 - 1) and large[20, 21] == 64 * (64 * 3 * 10**14 - 64) and large[0, 22] == -(2**63)
    few = topk.top_k(df.where("vec_id in (60, 61, 62, 500)"), F.col("id") % 20 == 0, 20)
    assert few.count() == 2 and topk.top_k(df.limit(0), F.col("id") % 20 == 0, 20).count() == 0


def test_top_k_broadcasts_no_block_or_slab(spark, monkeypatch):
    for name, value in (("SLAB", 40), ("BUCKET", 8), ("BLOCK", 10)):
        monkeypatch.setattr(topk, name, value)
    plans, made = {}, common.Cut.__init__

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        made(self, df, name)

    monkeypatch.setattr(common.Cut, "__init__", seen)
    assert topk.top_k(vectors(spark)[2], F.col("id") % 20 == 0, 20).count() > 0
    assert {"topk-first", "topk-asked", "topk-found"} <= set(plans)
    # A block copied for each slab is as large as queries times slabs: the driver would hold it whole.
    for name in plans.keys() - {"topk-asked"}:  # that one broadcasts a number for each query at most
        assert "Broadcast" not in plans[name] and "Generate" not in plans[name], name


@pytest.mark.parametrize("steep", [0.8, -2.0, 9.0])
@pytest.mark.parametrize("scale", [1, 40, 2000, 1e7, 1e12, 1e20])
def test_top_k_search_against_plain_products(monkeypatch, steep, scale):
    monkeypatch.setattr(topk, "STEEP", steep)
    rng = np.random.default_rng(3)
    k, rows = 7, np.floor(rng.normal(size=(300, 5)) * scale)
    rows[::17], rows[5] = 0, rows[6]
    own, ids, asked = np.arange(300), rng.integers(0, 200, 300), np.arange(0, 300, 9)
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))
    want = [sorted((-score(rows[a], rows[j]), int(ids[j])) for j in own if j != a)[:k] for a in asked]
    for floors in ([topk.NO_FLOOR] * len(asked), [-w[-1][0] if i % 3 else topk.NO_FLOOR for i, w in enumerate(want)]):
        best = topk.Best(np.array(floors, np.int64), k)
        for at in (own[:150], own[150:]):
            at = at[np.argsort(-topk._norms(rows[at]), kind="stable")]
            parts = [at[i : i + 32] for i in range(0, 150, 32)]
            topk.search((asked, rows[asked], topk._norms(rows[asked])), [topk.Bucket(own[x], ids[x], rows[x], topk._norms(rows[x])) for x in parts], best)
        got = [[] for _ in asked]
        for a, i, s in zip(best.at.tolist(), best.ids.tolist(), best.scores.tolist(), strict=True):
            got[a].append((-s, i))
        assert got == want


# --- 6 and 8: tokens


def test_token_counts_and_pieces_against_the_library(spark, odd):
    texts = odd.union(spark.createDataFrame([(200, "a<|endoftext|>b  \n\n x y \x1c z", None, None, 0, None, None, None)], SCHEMA))
    library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    rows = texts.select("doc_id", "text").collect()
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(texts).collect())
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 512) for r in rows)

    packed = packing.pack(texts, size=128).collect()
    want = Counter()
    for r in rows:
        own = [*ids(r.text), 2]
        edges = [0, *range(len(own) % 128 or 128, len(own) + 1, 128)]
        for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            want[r.doc_id, k, i, j - i, zlib.crc32(array("I", own[i:j]).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= math.ceil(sum(r.length for r in packed) / 128) + 2
    assert packing.pack(odd.limit(0)).count() == 0 and tokens.token_counts(odd.limit(0)).count() == 0


def test_pieces_of_one_length_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 2)
    docs = spark.createDataFrame([(None, "") for _ in range(700)] + [(i % 3, "same words here") for i in range(90)], "doc_id long, text string").repartition(7)
    numbered = packing.numbered(packing.cut(packing.pieces(docs, 8, 2, "byte_bpe_50k.json", "doc_id", "text"), "test-pieces")).cache()
    for r in numbered.groupBy("length").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect():
        assert r.ranks == list(range(len(r.ranks)))
    assert "SortMergeJoin [part#" in packing.pack(docs, 8)._jdf.queryExecution().executedPlan().toString()
    packed = packing.pack(docs, 8).collect()
    assert len(packed) == 790 and len({(r.sequence_id, r.offset) for r in packed}) == 790


def fewest(items, size):
    """The fewest bins, by trying: only for a handful of items."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {rooms[k]: k for k in range(len(rooms)) if rooms[k] >= items[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, size - items[i]])

    place(0, [])
    return best[0]


def test_plans_hold_everything_and_stay_near_the_fewest():
    rng = random.Random(4)
    for _ in range(300):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        bins = packing.plan(Counter(items), 20)
        assert Counter(x for b, k in bins for x in b * k) == Counter(items) and all(sum(b) <= 20 for b, _ in bins)
        assert sum(k for _, k in bins) <= fewest(items, 20) + 1


def test_dominance_never_costs_a_bin():
    rng = random.Random(5)
    for _ in range(300):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(2, 9))), reverse=True)
        found = packing.dominating(packing.Counts(Counter(items)), items[0], 20)
        if found:
            rest = list((Counter(items) - Counter(found)).elements())
            assert 1 + fewest(sorted(rest, reverse=True), 20) == fewest(items, 20), (items, found)


# --- 9: mixing


def test_mixing(spark, odd):
    out = mixing.mix(odd).collect()
    rows = odd.select("doc_id", "text", "source").collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode().split())
    assert sorted((r.doc_id or -1, r["size"]) for r in out) == sorted((r.doc_id or -1, size(r.text)) for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r.source] += size(r.text)
    names = [*sorted(x for x in by if x is not None), None]
    weight, total, held = {n: 1 + i % 3 for i, n in enumerate(names)}, sum(by.values()), set()
    while True:
        rest = (total - sum(3 * by[n] for n in held)) / sum(weight[n] for n in names if n not in held)
        over = {n for n in names if n not in held and weight[n] * rest > 3 * by[n]}
        if not over:
            break
        held |= over
    want = {n: 3.0 * by[n] if n in held else weight[n] * rest for n in names}
    source = {r.doc_id: r.source for r in rows}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in out:
        n = source[r.doc_id]
        assert r.target == pytest.approx(want[n]) and r.source_size == by[n]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[n] += r.taken
        longest[n] = max(longest[n], r["size"])
    assert all(abs(taken[n] - want[n]) <= longest[n] / 2 + 1 for n in names)
    again = mixing.mix(odd.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mixed = mixing.mixed(odd)
    per = Counter()
    for r in out:
        per[r.doc_id, r.source, r["size"]] += r.copies
    assert Counter((r.doc_id, r.source, size(r.text)) for r in mixed.collect()) == +per
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


# --- 1: languages


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    out = langid.identify(docs, net).join(docs, "doc_id").select("held_out", "lang_pred", "lang", "score").toPandas()
    assert (out.lang_pred == out.lang)[out.held_out].mean() > 0.97 and out.score.between(0, 1).all()
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), net).exceptAll(langid.identify(docs, net)).count() == 0


def test_language_id_defined_cases(spark, odd):
    net = langid.fit(odd)
    out = {r.doc_id: r for r in langid.identify(odd, net).collect()}
    for i in (100, 101, 102):
        assert out[i].lang_pred == "und" and out[i].score == 0
    assert out[103].lang_pred in ("aa", "bb") and out[None].held_out is True
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    kept = langid.accept(odd, 0.0, net)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert langid.identify(odd.limit(0)).count() == 0
    assert langid.accept(odd.withColumn("lang", F.lit(None).cast("string")), 0.5).count() == kept.count()
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients():
    net = langid.start(["a", "b", "c"], 4, 1)
    for f in ("table", "hidden", "out", "bias"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    rng = np.random.default_rng(0)
    w, y = rng.integers(0, 257, (5, 7)).astype(np.int16), rng.integers(0, 3, 5)
    _, grads = langid.gradients(net, w, y)
    for name, g in zip(("table", "hidden", "out", "bias"), grads, strict=True):
        a, at = getattr(net, name), np.unravel_index(np.argmax(np.abs(g)), g.shape)
        a[at] += 1e-5
        up, _ = langid.gradients(net, w, y)
        a[at] -= 2e-5
        down, _ = langid.gradients(net, w, y)
        a[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-4)


# --- 3: suffix tree


def brute_tree(texts, n, v, c, least_pair, least_context, divergence, depth):
    """The same tree by dictionaries: state (tokens, oldest first) to held successor counts, spread, total."""
    states = {}
    follow = defaultdict(Counter)
    for t in texts:
        seq = [b"", *t, b""]
        for i in range(1, len(seq)):
            for k in range(1, depth + 1):
                if i - k >= 0:
                    follow[tuple(seq[i - k : i])][seq[i]] += 1

    def prob(state, t):
        if not state:
            return (c[t] + 1) / (n + v + 1)
        counts, spread, total = states[state]
        return (counts.get(t, 0) + spread * prob(state[1:], t)) / total

    candidates = [(t,) for t in c if c[t] >= least_context]
    for _ in range(depth):
        new = {}
        for s in candidates:
            f = follow[s]
            if not f:
                continue
            size, kinds = sum(f.values()), len(f)
            keep = {t: k for t, k in f.items() if k >= least_pair}
            spread = size - sum(keep.values()) + kinds
            total = size + kinds
            gain = sum(k * math.log(((k + spread * prob(s[1:], t)) / total) / prob(s[1:], t)) for t, k in keep.items()) + (size - sum(keep.values())) * math.log(spread / total)
            if gain >= divergence:
                new[s] = keep, spread, total
        states |= new
        candidates = [(*s, t) for s in candidates for t, k in follow[s].items() if k >= least_context and (*s, t)[1:] in new]
    return states, prob


@pytest.mark.parametrize(("pair", "context", "divergence", "hot"), [(3, 128, 12.0, 1 << 20), (2, 5, 2.0, 1 << 20), (1, 3, 0.5, 12), (2, 4, 1.0, 0)])
def test_suffix_tree_against_brute_force(spark, odd, monkeypatch, pair, context, divergence, hot):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "LANE", 7 if hot else 1 << 20)
    got = suffix_tree.score(odd, least_pair=pair, least_context=context, divergence=divergence, depth=3).collect()
    rows = odd.select("doc_id", "text").collect()
    words = lambda t: (t or "").encode().lower().split()
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    train = [words(r.text) for r in rows if not out(r.doc_id)]
    c = Counter(w for t in train for w in [*t, b""])
    n, v = sum(c.values()), len(c)
    states, prob = brute_tree(train, n, v, c, pair, context, divergence, 3)
    assert states and (context > 100 or max(map(len, states)) == 3)
    want = []
    for r in rows:
        seq = [b"", *words(r.text), b""]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in seq[1:])
        total = 0.0
        for i in range(1, len(seq)):
            s = next((tuple(seq[i - k : i]) for k in (3, 2, 1) if i >= k and tuple(seq[i - k : i]) in states), ())
            total += math.log10(prob(s, seq[i]))
        want.append((r.doc_id, out(r.doc_id), len(seq) - 1, sum(c[t] > 0 for t in seq[1:]), n, base, total))
    for g, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.base_score)), sorted(want, key=lambda r: (str(r[0]), r[5])), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], abs=1e-5) and g.score == pytest.approx(w[6], abs=1e-5)


def test_hashes_are_those_of_spark(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 50))
    df = spark.createDataFrame([(int(x), int(y), f"w{x}é".encode()) for x, y in zip(a, b, strict=True)], "a long, b long, t binary")
    got = df.select(F.xxhash64("a", "b").alias("h"), F.xxhash64("t").alias("t")).collect()
    assert [r.h for r in got] == suffix_tree.mix(a, b).tolist()
    assert [r.t % 2**64 for r in got] == [xxhash.xxh64_intdigest(f"w{x}é".encode(), 42) for x in a]


def test_suffix_tree_empty(spark, odd):
    assert suffix_tree.score(odd.limit(0)).count() == 0
    alone = suffix_tree.score(odd.where("doc_id is null")).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score, alone.score) == (5, 0, 0, 0.0, 0.0)


def test_successors_travel_by_buckets(spark):
    """Each task sends a row for each bucket, however many contexts it has met, and the sums are those of all pairs."""
    rng = np.random.default_rng(7)
    texts = [[f"w{x}" for x in rng.zipf(1.3, 400) % 3000] for _ in range(40)]
    df = spark.createDataFrame([(" ".join(t).encode(),) for t in texts], "text binary").repartition(3)
    tokens = suffix_tree.token_counts(df).selectExpr("token as key", "cast(c as double) as value", "c as weight").cache()
    follow = Counter((a, b) for t in texts for a, b in zip(["", *t], [*t, ""], strict=True))
    code = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(w.encode(), 42) >> 63)
    assert len({a for a, _ in follow}) > 1000
    for hot in (1 << 20, 50, 0):
        levels = [suffix_tree.known(tokens.selectExpr("key", "1D as value", "weight"))[0]]
        ranks = suffix_tree.Ranks.of(*(x[:hot] for x in suffix_tree.hottest(tokens)[:2]))
        assert suffix_tree.successor_packs(df, levels, ranks, 64).count() <= 3 * 64
        got = suffix_tree.successor_counts(df, levels, 3, ranks, 16000).collect()
        assert {(r.s, r.next): r.c for r in got if r.next is not None} == {(code(a), code(b)): c for (a, b), c in follow.items() if c >= 3}
        rest, kinds = Counter(), Counter()
        for (a, _), c in follow.items():
            rest[code(a)] += c * (c < 3)
            kinds[code(a)] += c < 3
        assert {r.s: (r.c, r.kinds) for r in got if r.next is None} == {s: (c, kinds[s]) for s, c in rest.items() if c}


def test_cold_entries_are_asked_for_in_packs(spark, monkeypatch):
    """A task asks in a row for each bucket, however many keys its texts need, and copies of what tasks share do not stay."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 300) % 3000)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    shared, cut, asked = [], suffix_tree.Scratch.cut, []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: shared.append(broadcast(self, x)) or shared[-1])

    def counted(self, table, name):
        out = cut(self, table, name)
        if name == "suffix-tree-scores":
            asked.append(out.count() - len(docs))
        return out

    monkeypatch.setattr(suffix_tree.Scratch, "cut", counted)
    want = suffix_tree.score(df, least_pair=2, least_context=5).orderBy("doc_id").collect()
    assert not asked
    monkeypatch.setattr(suffix_tree, "HOT", 50)
    got = suffix_tree.score(df, least_pair=2, least_context=5).orderBy("doc_id").collect()
    assert 0 < asked[0] <= 3 * (suffix_tree.BUCKETS + 1)
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r), abs=2e-6) for r in want]
    assert len(shared) == 6 and not any(os.path.exists(x._path) for x in shared)


def test_packs_asked_and_answered():
    """Answers come in the order of the keys asked for, whatever bits the keys have, and go to all that use them."""
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 3000))
    keys[[0, -1]] = -(2**63), 2**63 - 1
    c = np.where(rng.random(len(keys)) < 0.5, rng.integers(1, 1000, len(keys)), 0)
    values = np.where(c > 0, np.log10(c + 1), rng.normal(size=len(keys)))
    there = rng.random(len(keys)) < 0.7
    batch = pa.RecordBatch.from_arrays([pa.array(keys[there]), pa.array(values[there]), pa.array(c[there])], ["key", "value", "c"])
    entries = pa.Table.from_batches(suffix_tree.entry_packs(iter([batch.slice(0, 900), batch.slice(900)]), 7))
    owner, at = rng.integers(0, 40, 9000), rng.integers(0, len(keys), 9000)
    owner[owner == 17] = 18
    wanted, uses = suffix_tree.questions(owner, keys[at], 7)
    wanted = pa.Table.from_batches([wanted]).append_column("pack", pa.array(np.full(wanted.num_rows, 500)))
    uses = pa.Table.from_batches([uses]).append_column("pack", pa.array([500]))
    of = lambda table, b: table.filter(pa.array(table["bucket"].to_numpy() == b))
    told = pa.concat_tables([suffix_tree.answers(of(wanted, b), of(entries, b)) for b in (3, 6, 0, 1, 5, 4, 2)])
    got = suffix_tree.gathered(uses, told).to_pydict()
    each = lambda x: np.bincount(owner, np.where(there, x, 0)[at], 40)
    assert got["row"] == list(range(500, 540)) and got["known_more"] == each(c > 0).tolist()
    assert np.allclose(got["base_more"], each(np.where(c > 0, values, 0))) and np.allclose(got["score_more"], each(values))


def test_packs_of_pairs_under_one_key():
    """Contexts and tokens whose hashes agree in the bits that are sorted by are still told apart."""
    rng = np.random.default_rng(3)
    s = (rng.integers(0, 5, 4000) << 40) | rng.integers(0, 3, 4000)
    nxt = np.where(rng.random(4000) < 0.5, (rng.integers(0, 4, 4000) << 40) | 9, rng.integers(0, 200, 4000) * 7)
    ranks = suffix_tree.Ranks.of(np.arange(100) * 7, rng.integers(1, 9, 100))
    key = lambda i: (s[i].view(np.uint64) & suffix_tree.HIGH) | ranks.get(nxt[i]).view(np.uint64)
    part = lambda i: suffix_tree.merged([(key(i), s[i], nxt[i], i % 300 + 1)])
    table = pa.Table.from_batches([suffix_tree.packs(part(i), ranks, 64) for i in np.split(np.arange(4000), 4)])
    want = Counter()
    for i in range(4000):
        want[int(s[i]), int(nxt[i])] += i % 300 + 1
    got = suffix_tree.summed(table, ranks, 0).to_pylist()
    assert len(got) == len(want) and {(r["s"], r["next"]): r["c"] for r in got} == want
