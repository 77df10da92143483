"""From frames to records: worked cases, labels, paths against all paths."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import kernels as K
from lexmill.operators import acoustics as S


def test_paths_against_all_paths():
    """Every path through blanks and labels is tried; rows of different lengths go together."""
    rng = np.random.default_rng(5)
    rows = [(rng.normal(size=(t, 4)), [int(x) for x in rng.integers(1, 4, n)]) for t, n in [(1, 1), (2, 2), (3, 2), (5, 2), (6, 3), (4, 3), (2, 3), (3, 0), (0, 2)] for _ in range(4)]
    got = K.forced_many([p for p, _ in rows], [x for _, x in rows], [0] * len(rows))
    for (p, x), found in zip(rows, got, strict=True):
        if not x:
            assert found == []
            continue
        states = [0] + [y for z in x for y in (z, 0)]
        best, path = -math.inf, None
        for way in itertools.product(range(len(states)), repeat=len(p)):
            steps = [b - a for a, b in itertools.pairwise(way)]
            fits = way and way[0] < 2 and way[-1] >= len(states) - 2 and all(d in (0, 1) or (d == 2 and states[w] and states[w] != states[w - 2]) for d, w in zip(steps, way[1:], strict=True))
            if fits and (score := sum(p[t, states[s]] for t, s in enumerate(way))) > best:
                best, path = score, way
        assert found == (None if path is None else [[t for t, s in enumerate(path) if s == 2 * i + 1] for i in range(len(x))])


def frames(labels, *best, weak=None):
    """Log scores with one clear label a frame; weak: {frame: (label, rival)} where a rival is ahead."""
    out = []
    for t, b in enumerate(best):
        p = [0.02] * len(labels)
        p[0], p[b] = 0.03, 0.90
        if weak and t in weak:
            p[weak[t][0]], p[weak[t][1]] = 0.08, 0.78
        out.append([math.log(x / sum(p)) for x in p])
    return out


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("book", 1, ["B", "UH1", "K"]), ("log", 1, ["L", "AO1", "G"])], "word string, variant int, phones array<string>")


MODEL = ["<pad>", "l", "ɔ", "ɡ", "b", "ʊ", "k", "uː"]


def test_pronounced(spark, lexicon):
    log = frames(MODEL, 0, 1, 1, 2, 2, 3, 0)
    book = frames(MODEL, 0, 4, 4, 5, 5, 6, 6, 0, weak={3: (5, 7), 4: (5, 7)})
    rival = frames(MODEL, 0, 4, 4, 5, 5, 6, 6, 0, weak={3: (5, 1), 4: (5, 1)})
    rows = [
        (1, "log", "word", "log", log, None), (2, "book", "word", "look", book, None), (3, "book", "word", "look", rival, None), (4, "", "word", "", log, None), (5, "log", "picture", "log", log, None),
        (6, "log", "word", "log", log, ["clipped"]), (7, "log", "word", "log", None, None), (8, "cat", "word", "cat", log, None), (9, "log", "word", "log", [], None), (10, "log", "word", "log", log[:2], None),
        (11, "two words", "sentence", "", log, None), (12, None, None, None, None, None), (13, "g", "letter", "g", log, None),
    ]
    df = spark.createDataFrame(rows, "id int, expected string, kind string, raw string, fr array<array<double>>, flags array<string>")
    got = {r.id: r for r in S.pronounced(df, ["id"], "fr", MODEL, 0, lexicon, raw="raw", flags="flags").collect()}
    assert len(got) == len(rows)
    assert got[1].decision == "accepted_by_pronunciation_evidence" and got[1].quality == "usable"
    assert [(s.phone, s.label, s.start, s.stop) for s in got[1].scores] == [("L", "l", 1, 3), ("AO", "ɔ", 3, 5), ("G", "ɡ", 5, 6)]
    assert got[2].decision == "accepted_by_short_word_gop_structure" and got[2].help.accepted and got[2].weakest == "UH" and got[2].nearest == "uː"
    assert got[3].decision == "rejected_low_gop" and got[3].help.reason == "weak vowel competitor is not an allowed acoustic variant"
    told = {i: (r.decision, r.reason) for i, r in got.items()}
    assert told[4] == ("skipped_no_expected_text", "expected_text is missing") and told[5] == ("skipped_unsupported_prompt_type", "unsupported prompt type: picture")
    assert told[6] == ("skipped_bad_audio", "audio quality flag clipped is true") and told[7] == ("not_available", "phoneme frame probabilities are unavailable")
    assert told[8] == ("alignment_failed", "phoneme token not found in model vocabulary: AE, T") and told[9][1] == "frame log probabilities are empty"
    assert told[10] == ("alignment_failed", "CTC alignment did not find a valid path") and got[10].score is None and got[10].quality == "failed"
    assert told[11][0] == "alignment_failed" and told[12][0] == "skipped_no_expected_text"


def test_labels(spark):
    df = spark.createDataFrame([(["AH1", "aa", "B", "ZH", "T"],), ([],)], "p array<string>")
    labels = ["ə", "ʌ", "AA", "b", "t", "T"]
    assert [r[0] for r in df.select(S.model_labels(F.col("p"), labels)).collect()] == [["ʌ", "AA", "b", None, "T"], []]


def test_records(spark):
    rows = [
        ("book", "word", False, 0.2, 0.9, "look", 0.3, "accepted_by_short_word_gop_structure", 0.7), ("book", "letter", False, 0.2, 0.9, "look", 0.3, "accepted_by_short_word_gop_structure", 0.7),
        ("cat", "word", True, 0.2, 0.9, "kat", None, "accepted_by_pronunciation_evidence", 0.8), ("cat", "word", False, 0.95, 0.9, "kat", 0.9, "accepted_by_pronunciation_evidence", 0.8),
        ("cat", "word", False, 0.5, 0.9, "kat", 0.9, "accepted_by_pronunciation_evidence", 0.8), ("a b", "sentence", True, 1.0, 0.9, "a c", 0.9, "accepted_by_pronunciation_evidence", 0.8),
        ("cat", "word", None, None, None, "kat", None, None, None),
    ]
    names = ["e", "k", "a", "s", "t", "d", "c", "g", "o"]
    df = spark.createDataFrame(rows, "e string, k string, a boolean, s double, t double, d string, c double, g string, o double").coalesce(1)
    got = [tuple(r[0]) for r in df.select(S.applied(*[F.col(n) for n in names])).collect()]
    assert got == [
        (True, "book", "gop_assisted_short_word_structure", 0.7, True), (False, "look", None, 0.3, False), (True, "cat", "expected_centric_with_acoustic_gop", 0.8, True),
        (True, "cat", "expected_centric_with_acoustic_gop", 0.9, True), (False, "kat", None, 0.9, False), (True, "a c", None, 0.9, False), (False, "kat", None, None, False),
    ]
