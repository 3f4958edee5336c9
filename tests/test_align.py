import numpy as np
from pyspark.sql import functions as F

from lyrebird.operators import align


def table(r, s, cost=1.0):
    """The whole table, cell by cell."""
    n, m = len(r), len(s)
    best = np.full((n + 1, m + 1), np.inf)
    best[0] = np.concatenate([[0], np.cumsum(cost * s)])
    for i in range(1, n + 1):
        for j in range(i, m + 1):
            best[i, j] = min(best[i - 1, j - 1] + abs(r[i - 1] - s[j - 1]), best[i, j - 1] + cost * s[j - 1])
    return min(best[n, j] + cost * s[j:].sum() for j in range(n, m + 1))


def test_gap_align_costs_least(spark):
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        r, s = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n + int(rng.integers(0, 9))).astype(float)
        path = align._gap_path(r, s, 1.0)
        assert (np.diff(path) > 0).all() and path[0] >= 0
        skipped = np.ones(len(s), bool)
        skipped[path] = False
        assert abs(r - s[path]).sum() + s[skipped].sum() == table(r, s)
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0, 2.0]), ([1.0], [])], "r array<double>, s array<double>").select(align.gap_align("r", "s").alias("p"))
    assert [x.p for x in df.collect()] == [[0, 2], []]


def test_anchors(spark):
    cases = [("ab cd ef", "cd", 0, 3), ("ab cd ef", "bcd", 0, 1), ("ab cd ef", "ef", 7, None), ("ab cd ef", "cdxx", 0, None), ("ab cde f", "cdexx", 0, 3), ("", "a", 0, None), ("abc", "", 0, None), ("ab ab", "ab", 1, 3)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, a string, s int")
    got = {r.i: r.p for r in df.select("i", align.locate_anchor(F.col("t"), F.col("a"), F.col("s")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_small_functions(spark):
    df = spark.createDataFrame([("กี่x", 2)], "t string, i int").select(align.snap_left(F.col("t"), F.col("i")).alias("a"), align.snap_left(F.col("t"), F.lit(9)).alias("b"), align.clean_sequence(F.lit(" / C //  G /")).alias("c"))
    assert tuple(df.first()) == (0, 9, "C / G")
    ok = lambda c, p: spark.range(1).select(align.palette_ok(F.lit(c), F.array(*map(F.lit, p)).cast("array<string>")).alias("r")).first()["r"]
    assert ok("G/B", ["G", "B"]) and not ok("G/C", ["G"]) and ok(" ", ["G"]) and ok("X", [])


def test_assemble_and_report(spark):
    lines = spark.createDataFrame([(1, 0, "กข"), (1, 1, ""), (1, 2, "คง"), (2, 0, "จ")], "id long, line_no int, line string")
    marks = spark.createDataFrame([(1, 0, 1, "C", 0.9), (1, 0, 0, "G", 0.2), (1, 1, 9, "Am", 0.8)], "id long, sung int, char int, symbol string, score double")
    rows = spark.createDataFrame([(1, 0, 0, "C / G"), (1, 1, 0, "F"), (1, 1, 1, "F G"), (1, 2, 0, "C")], "id long, after int, n int, seq string")
    sheets = align.assemble(lines, marks, rows)
    got = {r.id: r.sheet for r in sheets.collect()}
    assert got == {1: "Intro C / G\n[G]ก[C]ข\nInstru F\nF G\n\nคง[Am]\nOutro C\n", 2: "จ\n"}
    report = {r.id: r for r in align.align_report(lines, marks, sheets, spark.createDataFrame([(1, ["C", "G"])], "id long, palette array<string>"), spark.createDataFrame([(1, 2), (2, 1)], "id long, lyric_bands int")).collect()}
    assert report[1].lyric_exact and report[1].bad_symbols == ["Am"] and report[1].placed == 3 and report[1].rows_match and report[1].needs_review
    assert (report[1].avg_score, report[1].id_confidence) == (0.633, 0.667) and report[2].placed == 0 and report[2].needs_review


def test_available_offline(spark):
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id long")
    assert {r.id: r.cached for r in align.available_offline(ids(1, 2, 3), ids(1, 1), ids(2)).collect()} == {1: True, 2: True, 3: False}
