"""Rows of few file splits are dealt over all tasks before much work follows upon them."""

from pyspark.sql import functions as F

from lyrebird.operators import harmony, sheets, signals
from lyrebird.plans import catalogue, music
from lyrebird.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_sheets_are_dealt_before_they_are_parsed(spark):
    df = spark.range(40).coalesce(1).select("id", F.lit("[C]\n{key: D}\nla [G]la").alias("text"))
    lines = sheets.parse_lines(df, "id", "text")
    assert lines.rdd.getNumPartitions() == 4 and lines.count() == 120


def test_kinds_are_told_once(spark):
    """A filter on the kind of a line doesn't work it out anew."""
    df = spark.range(4).select("id", F.lit("[C]\n{key: D}").alias("text"))
    plan = sheets.parse_lines(df, "id", "text").where("kind != 'directive'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == 1


def test_tones_are_dealt_before_their_frames(spark):
    assert music.tone_frames(Tables(spark, SF)).rdd.getNumPartitions() == 4


def test_nearest_tone_sorts_no_table(spark):
    """The nearest of all tones by plain comparisons, no array for each frame."""
    hz = [None, float("nan"), *[float(f) for f in range(17900, 19100)]]
    df = spark.createDataFrame([(h,) for h in hz], "freq double").select("freq", signals.nearest_tone(F.col("freq")).alias("s"))
    want = {f: min(signals.TONES, key=lambda s: abs(signals.TONES[s] - f)) for f in hz[2:]}
    assert {r.freq: r.s for r in df.collect() if r.freq == r.freq and r.freq} == {f: s if abs(signals.TONES[s] - f) <= 37 else None for f, s in want.items()}
    assert [r.s for r in df.where("freq is null or isnan(freq)").collect()] == [None, None]
    assert "array" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_are_dealt_before_they_are_cleaned(spark):
    assert catalogue.raw_titles(Tables(spark, SF)).rdd.getNumPartitions() == 4


def test_keys_are_scored_many_rows_at_once(spark):
    """No function of each row's array; roots that are null count in the total alone."""
    rows = [(1, 0, 2, "maj"), (1, 1, 11, "min"), (1, 2, 6, "min"), (1, 3, 7, "maj"), (1, 4, 9, "maj"), (2, 0, 0, "min"), (3, 0, 0, "maj"), (3, 1, None, "maj")]
    found = harmony.detect_keys(spark.createDataFrame(rows, "id long, pos int, root int, quality string"), "id", "pos")
    assert sorted(map(tuple, found.collect())) == [(1, 2, "major", 1.0), (2, 0, "minor", 1.0), (3, 0, "major", 0.5)]
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
