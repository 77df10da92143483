"""Column functions and kernels against brute force, and the defined edge cases."""

import itertools
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import frames as A
from lexmill.functions import kernels as K
from lexmill.functions import phonemes as P
from lexmill.functions import text as T


def lev(a, b, cost=lambda x, y: float(x != y)):
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + cost(x, y)))
        row = new
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return row[-1]


def test_distances_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abei") for _ in range(rng.randrange(6)))
    rows = [(i, word(), word()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = D.letters(F.col("a")), D.letters(F.col("b"))
    got = df.select("a", "b", D.edits(a, b).alias("e"), D.common(a, b).alias("c"), D.lenient_edits(a, b).alias("l"), D.is_subsequence(a, b).alias("s"), D.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    soft = lambda x, y: 0.0 if x == y else 0.25 if x in "aeiouy" and y in "aeiouy" else 1.0
    for r in got:
        assert r.e == lev(r.a, r.b) and r.c == lcs(r.a, r.b)
        assert r.l == pytest.approx(lev(r.a, r.b, soft))
        assert r.s == any("".join(x) == r.a for x in itertools.combinations(r.b, len(r.a)))
        n = len(r.a) + len(r.b)
        assert r.r == pytest.approx(2 * lcs(r.a, r.b) / n if n else 1.0)


def test_error_rates_and_categories(spark):
    rows = [("the cat", "the cat", 0.0, "exact"), ("the cat", "", 1.0, "blank_hypothesis"), ("", "dog", 1.0, "blank_reference"), ("", "", 0.0, "blank_reference"),
            ("the cat ran", "the cat", 1 / 3, "deletion"), ("the cat", "the big cat", 0.5, "insertion"), ("the cat", "the hat", 0.5, "substitution"), ("the cat sat", "zz qq ww", 1.0, "unrelated")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, h string, w double, c string")
    for r in df.select("*", D.word_error_rate(F.col("r"), F.col("h")).alias("wer"), D.error_category(F.col("r"), F.col("h"), D.indel_ratio(F.col("r"), F.col("h"))).alias("cat")).collect():
        assert r.wer == pytest.approx(r.w) and r.cat == r.c


def test_text_forms(spark):
    df = spark.createDataFrame([(0, "  Um, the CAT's—hat! "), (1, None), (2, "É x")], "i int, t string")
    got = df.orderBy("i").select(T.transcript("t"), T.for_scoring("t"), T.strict("t"), T.for_evaluation("t"), T.item_kind("t")).collect()
    assert tuple(got[0]) == ("um the cat's hat", "the cat's hat", "um the cat s hat", "um the cat's hat", "phrase") or got[0][4] == "sentence"
    assert tuple(got[1]) == ("", "", "", "", "blank")
    answers = spark.createDataFrame([('["a", "b"]',), ("a | b",), ("a,b",), ("a b",), (None,)], "t string").select(T.accepted_answers("t")).collect()
    assert [r[0] for r in answers] == [["a", "b"], ["a", "b"], ["a", "b"], ["a b"], []]


def test_phones(spark):
    df = spark.createDataFrame([("ship", "chip"), ("cat", "cut"), ("cat", "cap"), ("cat", ""), ("cat", "cat")], "e string, a string")
    e, a = P.spelled(F.col("e")), P.spelled(F.col("a"))
    c = P.compared(e, a)
    got = df.withColumn("c", c).select("e", P.pattern(e).alias("p"), P.word_error(F.col("e"), F.col("a"), F.col("c")).alias("err")).collect()
    assert [r.err for r in got] == ["initial_sound_error", "vowel_error", "final_sound_error", "blank", "correct"]
    assert got[0].p == "CVC"


def test_alignment_is_cheapest():
    rng = random.Random(2)
    words = ["cat", "cats", "dog", "sun", "son"]
    for _ in range(200):
        x, y = ([rng.choice(words) for _ in range(rng.randrange(5))] for _ in range(2))
        steps = K.align(x, y)
        assert [s[0] for s in steps if s[0]] == x and [s[1] for s in steps if s[1]] == y
        sim = lambda a, b: 1 - SequenceMatcher(None, a, b, autojunk=False).ratio()
        paid = sum(1.0 if None in s[:2] else sim(*s[:2]) for s in steps)
        assert paid == pytest.approx(lev(x, y, sim))


def paths(frames, labels, blank):
    for p in itertools.product(range(frames.shape[1]), repeat=len(frames)):
        kept = [k for k, _ in itertools.groupby(p)]
        if [k for k in kept if k != blank] == labels:
            yield sum(frames[t, k] for t, k in enumerate(p)), p


def test_forced_alignment_and_beam_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(30):
        f = np.log(rng.dirichlet(np.ones(3), 5))
        labels = [1, 2]
        # Beside a longer and a shorter row, with which it is padded.
        _, got, _ = K.forced_many([np.log(rng.dirichlet(np.ones(3), 8)), f, np.log(rng.dirichlet(np.ones(3), 2))], [[2, 1, 2], labels, [1]], [0, 0, 0])
        best, path = max(paths(f, labels, 0))
        assert [(x[0], x[-1]) for x in got] == [(path.index(k), len(path) - 1 - path[::-1].index(k)) for k in labels]
        score = {}
        for p in itertools.product(range(3), repeat=5):
            key = tuple(k for k, _ in itertools.groupby(p) if k != 0)
            score[key] = np.logaddexp(score.get(key, -math.inf), sum(f[t, k] for t, k in enumerate(p)))
        assert tuple(K.beam(f, 0, 1000)) == max(score, key=score.get)
    assert K.forced_many([np.zeros((1, 3)), np.zeros((2, 3))], [[1, 2], []], [0, 0]) == [None, []]


def test_frames(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1, 1, 0, 1, 2, 2]), ([], [])], "w array<double>, l array<int>")
    got = df.select(A.rms(F.col("w")), A.collapsed(F.col("l"), F.lit(0)), A.clipped(F.col("w"), 4.0)).collect()
    assert got[0][0] == pytest.approx(12.5**0.5) and got[0][1] == [1, 1, 2] and got[0][2] == 0.5
    assert got[1][0] == 0.0 and got[1][1] == []
