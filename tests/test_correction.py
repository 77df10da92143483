from lexmill.operators import correction


def test_letter_lattice_accepts_each_level(spark):
    rows = [("q", "ku"), ("b", "beee"), ("z", "zhi"), ("g", "jih"), ("b", "dog")]
    out = {(r.expected, r.raw): r for r in correction.corrected(spark.createDataFrame(rows, "expected string, raw string")).collect()}
    for row, score in zip(rows, (0.93, 0.90, 0.90, 0.90), strict=False):
        assert (out[row].strategy, out[row].score, out[row].accepted, out[row].corrected) == ("letter_lattice", score, True, row[0]), row
    assert out["b", "dog"].strategy == "rejected" and out["b", "dog"].lattice <= 0.80
