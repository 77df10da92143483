"""Correction by made evidence and chunk alignment: worked cases, and a plain second reading."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexmill.functions import distance as D
from lexmill.functions import kernels as K
from lexmill.operators import dynamic as Y

SOUNDS = {
    "knights": "N AY1 T S", "nights": "N AY1 T S", "pulled": "P UH1 L D", "poled": "P OW1 L D", "the": "DH AH0", "a": "AH0", "fish": "F IH1 SH", "tree": "T R IY1", "hand": "HH AE1 N D",
    "hund": "HH AH1 N D", "head": "HH EH1 D", "sun": "S AH1 N", "son": "S AH1 N", "nearby": "N IH1 R B AY2", "near": "N IH1 R", "by": "B AY1", "book": "B UH1 K", "mark": "M AA1 R K",
}


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([(w, 1, p.split()) for w, p in SOUNDS.items()], "word string, variant int, phones array<string>")


WORDS = [
    ("C", "See", "letter", None, None, True, "letter_alias_match"), ("L", "Elle", "letter", None, None, True, "letter_alias_match"), ("Q", "You", "letter", None, None, True, "letter_alias_match"),
    ("Leo", "Layo", "word", 0.84, None, True, "gop_supported_expected_match"), ("Leo", "banana", "word", None, None, False, "rejected_no_acoustic_evidence"),
    ("shield", "shild", "word", None, None, True, "vowel_tolerant_consonant_skeleton_match"), ("knights", "nights", "word", None, None, True, "homophone_match"),
    ("sun", "son", "word", None, None, True, "homophone_match"), ("sun", "son", "word", None, 0.0, True, "known_asr_confusion_match"),
    ("hand", "hund", "word", None, None, True, "vowel_tolerant_consonant_skeleton_match"), ("hand", "banana", "word", None, None, False, "rejected_no_acoustic_evidence"),
    ("hand", "head", "word", None, None, False, "rejected_low_similarity"), ("the", "a", "word", None, None, False, "rejected_suspicious_fragment_low_pronunciation_evidence"),
    ("fish", "fs", "word", None, 0.40, False, "rejected_suspicious_fragment_low_pronunciation_evidence"), ("tree", "tr", "word", None, 0.50, False, "rejected_suspicious_fragment_low_pronunciation_evidence"),
    ("fish", "fs", "word", 0.91, 0.83, True, "fragment_gop_supported_expected_match"), ("tree", "tr", "word", None, 0.86, True, "fragment_phoneme_supported_expected_match"),
    ("pulled", "poled", "passage", None, None, False, "rejected_low_similarity"), ("cat", "Cat.", None, None, None, True, "exact_normalized_match"),
    (None, "x", None, None, None, False, "skipped_no_expected_text"), ("x", None, None, None, None, False, "rejected_blank_raw_transcript"), ("", "", None, None, None, False, "skipped_no_expected_text"),
]


def test_words(spark, lexicon):
    rows = spark.createDataFrame([(i, *w[:5]) for i, w in enumerate(WORDS)], "id int, expected string, raw string, kind string, gop double, sound double")
    got = {r.id: r for r in Y.correct_words(rows, lexicon, kind="kind", gop="gop", sound="sound").collect()}
    assert len(got) == len(WORDS)
    for i, (expected, raw, *_, accepted, sub) in enumerate(WORDS):
        assert (got[i].dynamic.accepted, got[i].dynamic.sub_strategy) == (accepted, sub), (expected, raw)
        assert got[i].corrected == (expected if accepted else raw)
    assert got[9].dynamic.skeleton == 1.0 and got[9].dynamic.vowels >= 0.9 and got[9].dynamic.strategy == "dynamic_asr_spelling_variant"


def test_skipped_learned_and_poor_recordings(spark):
    rows = spark.createDataFrame([(1, "shield", "shill", False, False), (2, "fish", "fs", False, True), (3, "fish", "fish", True, False)], "id int, expected string, raw string, again boolean, bad boolean")
    learned = spark.createDataFrame([("Shield", "shill")], "expected string, raw string")
    got = {r.id: r.dynamic for r in Y.correct_words(rows, learned=learned, retry="again", bad_audio="bad").collect()}
    assert (got[1].strategy, got[1].confidence) == ("reinforcement_error_transcript_match", 1.0)
    assert got[2].sub_strategy == "fragment_retry_bad_audio" and got[3].sub_strategy == "skipped_retry_required"


def aligned(spark, rows, lexicon, learned=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, expected string, raw string").withColumn("kind", F.lit("passage"))
    out = {}
    for r in Y.align_chunks(df, ["id"], lexicon, learned, kind="kind").orderBy("id", "chunk", "within").collect():
        out.setdefault(r.id, []).append(r)
    return out


def test_chunks(spark, lexicon):
    rows = [("Arthur carried his shield", "arthur carried his shild"), ("Many knights pulled", "many nights pulled"), ("near by the book mark", "nearby the bookmark"), ("nearby fish", "near by um fish there"), ("a b c", ""), ("", "x y"), (None, None)]
    got = aligned(spark, rows, lexicon)
    assert [r.status for r in got[0]] == ["exact_correct"] * 3 + ["accepted_by_asr_spelling_variant"]
    assert [r.status for r in got[1]] == ["exact_correct", "accepted_by_homophone", "exact_correct"]
    assert [(r.chunk, r.expected_word, r.recognized_word, r.operation) for r in got[2]] == [
        (1, "near", "nearby", "merge_match"), (1, "by", "nearby", "merge_match"), (2, "the", "the", "match"), (3, "book", "bookmark", "merge_match"), (3, "mark", "bookmark", "merge_match")]
    assert [(r.expected_word, r.recognized_word, r.operation, r.status) for r in got[3]] == [
        ("nearby", "near by", "split_match", "accepted_by_split_merge"), ("fish", "fish", "match", "exact_correct"), (None, "there", "insertion", "inserted")]
    assert [r.status for r in got[4]] == ["missing"] * 3 and [r.status for r in got[5]] == ["inserted"] * 2 and 6 not in got
    learned = spark.createDataFrame([("shield", "xq")], "expected string, raw string")
    assert [r.status for r in aligned(spark, [("his shield", "his xq")], lexicon, learned)[0]][1] == "accepted_by_reinforcement_match"


def plain_path(own, met, price):
    """The cheapest steps, pushed from place to place in order; the first of equal ones stays."""
    best = {(0, 0): (0.0, [])}
    for i in range(len(own) + 1):
        for j in range(len(met) + 1):
            cost, steps = best[i, j]
            moves = [(1, 0, 1.0), (0, 1, 0.95)] + [(k, n, price(i, j, k, n)) for k, n in Y.SIZES if i + k <= len(own) and j + n <= len(met)]
            for k, n, p in moves:
                if i + k <= len(own) and j + n <= len(met) and p is not None and cost + p < best.get((i + k, j + n), (9e9,))[0]:
                    best[i + k, j + n] = (cost + p, [*steps, (i, j, k, n)])
    return best[len(own), len(met)][1]


def test_chunks_against_a_plain_reading(spark, lexicon):
    """All pairs of chunks scored, none left out beforehand, and paths pushed forward."""
    rng = random.Random(4)
    words = [*SOUNDS, "bookmark", "hands", "nearly", "she", "shed", "ant", "want", "to", "two"]
    rows = []
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 7))]
        met = " ".join(w if rng.random() < 0.6 else rng.choice([*words, w[:-1], w + "s", w.replace("e", "a")]) for w in own if rng.random() < 0.9)
        rows.append((" ".join(own), met.replace(" ", "", 1) if rng.random() < 0.3 else met))
    got = aligned(spark, rows, lexicon)
    cells = {(" ".join(a[i : i + k]), " ".join(b[j : j + n]), k, n) for x, y in rows for a, b in [(x.split(), y.split())] for k, n in Y.SIZES for i in range(len(a) - k + 1) for j in range(len(b) - n + 1)}
    pairs = spark.createDataFrame([(*c, "passage", None) for c in cells], "e string, r string, k int, l int, kind string, gop double")
    scored = {(r.e, r.r): r for r in Y.score_chunks(pairs, lexicon).collect()}

    def price(a, b):
        def of(i, j, k, n):
            s = scored[" ".join(a[i : i + k]), " ".join(b[j : j + n])]
            if 3 in (k, n) and not (s.status == "accepted_by_split_merge" and (s.boundary >= 0.92 or (s.sound or 0) >= 0.9 or s.confidence >= 0.9)):
                return None
            return 0.01 if s.status == "exact_correct" else max(0.04, 0.35 - s.confidence * 0.25) if s.correct else max(0.6, 1 - s.confidence * 0.35) if s.status == "partial" else 1.05

        return of

    for i, (x, y) in enumerate(rows):
        a, b = x.split(), y.split()
        want = []
        for nth, (p, q, k, n) in enumerate(plain_path(a, b, price(a, b))):
            status = "missing" if n == 0 else "inserted" if k == 0 else scored[" ".join(a[p : p + k]), " ".join(b[q : q + n])].status
            want += [(nth + 1, w, status) for w in a[p : p + k]] or [(nth + 1, None, status)]
        assert [(r.chunk, r.expected_word, r.status) for r in got.get(i, [])] == want, (x, y)


def test_likeness_against_plain_reading(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiybcdst'") for _ in range(rng.randrange(0, 9)))
    pairs = [(f"{word()} {word()}".strip(), word()) for _ in range(200)] + [("", ""), ("aei", "o"), ("a", "")]
    for r in Y.likeness(spark.createDataFrame(pairs, "e string, r string"), "e", "r").collect():
        a, b = r.e.replace("'", ""), r.r.replace("'", "")
        ratio = lambda x, y: 1.0 if not x and not y else round(SequenceMatcher(None, x, y).ratio(), 6) if x and y else 0.0
        assert r.boundary == ratio(a.replace(" ", ""), b) and r.spelling == max(ratio(a, b), r.boundary)
        s, t = ("".join(c for c in x if c.isalpha() and c not in "aeiouy") for x in (a, b))
        inside = lambda x, y: all(c in it for it in [iter(y)] for c in x)
        bones = r.spelling if not s and not t else 0.0 if not s or not t else 1.0 if s == t else round(max(SequenceMatcher(None, s, t).ratio(), min(len(s), len(t)) / max(len(s), len(t))), 6) if inside(s, t) or inside(t, s) else ratio(s, t)
        assert abs(r.skeleton - bones) < 1e-9, (r.e, r.r)


def test_matching_blocks():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert K.matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_records(spark, lexicon):
    rows = [(1, "hand", "hund", None), (2, "raise your hand", "raise your hund", None), (3, "near by", "nearby", None), (4, "fish", "tree", True), (5, "one two", "", None)]
    df = spark.createDataFrame(rows, "id int, expected string, raw string, against boolean")
    got = {r.id: r for r in Y.correct_records(df, ["id"], lexicon, contradicted="against").collect()}
    assert (got[1].displayed, got[1].strategy) == ("hand", "dynamic_asr_spelling_variant")
    assert (got[2].displayed, got[2].sub_strategy, got[2].accepted) == ("raise your hund", "word_alignment_dynamic_correction", True)
    assert got[3].sub_strategy == "passage_aware_dynamic_alignment_repair" and got[4].sub_strategy == "skipped_critical_phoneme_contradiction"
    assert got[5].sub_strategy == "no_word_alignment_corrections" and not got[5].accepted


def test_edits_of_many_tokens(spark):
    rng = random.Random(6)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(8))], [rng.choice("abcd") for _ in range(rng.randrange(8))]) for _ in range(80)]
    rows += [([str(i) for i in range(300)], [str(i) for i in range(5, 290)]), ([], []), (["a"], [])]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [last := i + 1] + [last := min(last + 1, row[j + 1] + 1, row[j] + (x != y)) for j, y in enumerate(b)]
        return row[-1]

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[2] for r in df.select("a", "b", D.edits(F.col("a"), F.col("b"))).collect()] == [plain(a, b) for a, b in rows]


def test_repeated_readings_are_aligned_once(spark, lexicon):
    """What a row's alignment costs is paid by distinct readings: chunks are made behind the shuffle that leaves one of each, in plans as they are run."""
    rows = [("near by the book mark", "nearby the bookmark"), ("Near by the book mark!", "nearby the bookmark"), ("his shield", "his shild")]
    few = aligned(spark, rows, lexicon)
    many = aligned(spark, rows * 30, lexicon)
    plain = lambda found: [r.asDict() | {"id": 0} for r in found]
    assert len(many) == 90 and all(plain(many[i]) == plain(few[i % 3]) for i in many) and plain(few[0]) == plain(few[1])
    df = spark.createDataFrame([(i, *r, {"near": 0.5 * (i % 2)}) for i, r in enumerate(rows[:2])], "id int, expected string, raw string, scores map<string,double>")
    assert {(r.id, r.gop) for r in Y.align_chunks(df, ["id"], lexicon, scores="scores").where("chunk = 1").collect()} == {(0, 0.0), (1, 0.5)}
    plan = Y.align_chunks(df, ["id"], lexicon)._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if "Filter" in line and "size(flatten(" in line]
    assert not below, "chunks made for a filter on rows"


def test_repeated_words_are_decided_once(spark, lexicon, monkeypatch):
    """What is compared and decided is one row for each distinct set of what a decision reads; every row gets its own."""
    rows = [("Leo", "Layo", "word", 0.84, None), ("sun", "son", "word", None, None), ("sun", "son", "word", None, 0.0), ("Sun!", "son", "word", None, 0.0), ("cat", "Cat.", None, None, None)]
    df = spark.createDataFrame([(i, *rows[i % 5]) for i in range(150)], "id int, expected string, raw string, kind string, gop double, sound double")
    compared, likeness = [], Y.likeness
    monkeypatch.setattr(Y, "likeness", lambda rows, *names: compared.append(rows.count()) or likeness(rows, *names))
    got = {r.id: r for r in Y.correct_words(df, lexicon, kind="kind", gop="gop", sound="sound").collect()}
    assert compared == [3] and sorted(got) == list(range(150))
    plain = lambda r: r.asDict(True) | {"id": 0}
    assert all(plain(got[i]) == plain(got[i % 5]) for i in got)
    assert [got[i].dynamic.sub_strategy for i in range(5)] == ["gop_supported_expected_match", "homophone_match", "known_asr_confusion_match", "known_asr_confusion_match", "exact_normalized_match"]
    assert got[3].corrected == "Sun!" and got[1].sound == 1.0 and got[2].sound == 0.0
