"""Putting symbols into known lyrics: anchors, column alignment, assembly and a report for each song."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lyrebird.functions.text import only_script
from lyrebird.operators.sheets import insert_markers

# Thai vowels and marks that stand over or under the letter before them.
COMBINING = "ัิ-ฺ็-๎"
LOW_SCORE, SURE = 0.30, 0.85
# What labels a row in a finished sheet, and how a row of symbols is tidied.
LABEL = r"^(?i)(Intro|Instru|Solo|Outro|Ending|Hook|Verse|Chorus|Pre)(?![A-Za-z0-9_])"
SLASHES, ENDS = r"(?:/\s*){2,}", r"^[ /]+|[ /]+$"


def locate_anchor(text: Column, anchor: Column, start: Column) -> Column:
    """Where (from 0) an anchor begins at or after ``start``: as it is, else without regard to spaces, else by its
    first three characters in the same two ways. Null if nowhere, or if the anchor is empty."""
    places = F.when(F.length(text) > 0, F.filter(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.substr(text, i + 1, F.lit(1)) != " ")).otherwise(F.array().cast("array<int>"))
    compact, before = F.replace(text, F.lit(" "), F.lit("")), F.size(F.filter(places, lambda i: i < start))

    def seek(a: Column) -> Column:
        exact = F.nullif(F.call_function("locate", a, text, start + 1), F.lit(0)) - 1
        packed = F.nullif(F.call_function("locate", F.replace(a, F.lit(" "), F.lit("")), compact, before + 1), F.lit(0))
        return F.coalesce(exact, F.get(places, packed - 1))

    longer = F.length(F.replace(anchor, F.lit(" "), F.lit(""))) > 3
    return F.when(anchor != "", F.coalesce(seek(anchor), F.when(longer, seek(F.substring(anchor, 1, 3)))))


def snap_left(text: Column, at: Column) -> Column:
    """The place of the letter that a combining mark at ``at`` belongs to."""
    run = F.length(F.regexp_extract(F.substr(text, F.lit(1), at + 1), f"[{COMBINING}]*$", 0))
    return F.when((at > 0) & (at < F.length(text)), F.greatest(at - run, F.lit(0))).otherwise(at)


def palette_ok(symbol: Column, palette: Column) -> Column:
    """Whether the palette has the symbol, or every part of it between slashes; blank symbols and empty palettes pass."""
    name = F.trim(symbol)
    parts = F.filter(F.transform(F.split(name, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return (name == "") | (F.size(palette) == 0) | F.array_contains(palette, name) | F.forall(parts, lambda p: F.array_contains(palette, p))


def clean_sequence(row: Column) -> Column:
    """A row of symbols with single spaces and single slashes, neither at its ends."""
    tight = F.regexp_replace(F.trim(F.regexp_replace(row, r"\s+", " ")), SLASHES, "/ ")
    return F.trim(F.regexp_replace(tight, ENDS, ""))


def _gap_path(rendered: np.ndarray, source: np.ndarray, cost: float) -> np.ndarray:
    """The source column of each rendered one at least total difference; skipped ink costs ``cost`` each.

    A row of the table follows from the one before by one running minimum.
    """
    n, m = len(rendered), len(source)
    if n == 0 or m < n:
        return np.zeros(0, np.int32)
    skip = np.concatenate([[0.0], np.cumsum(cost * source)])
    row, match = skip.copy(), np.zeros((n + 1, m + 1), bool)
    for i in range(1, n + 1):
        met = np.full(m + 1, np.inf)
        met[i:] = row[i - 1 : m] + np.abs(rendered[i - 1] - source[i - 1 :])
        level = np.minimum.accumulate(met - skip)
        match[i, i] = True
        match[i, i + 1 :] = (met - skip)[i + 1 :] <= level[i:-1]
        row = level + skip
    end = int(np.argmin(row[n:] + skip[-1] - skip[n:])) + n
    out, i = np.zeros(n, np.int32), n
    while i:
        if match[i, end]:
            i -= 1
            out[i] = end - 1
        end -= 1
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def gap_align(rendered: pd.Series, source: pd.Series) -> pd.Series:
    """For each pair of column profiles, the source columns of the rendered ones; empty if the source is shorter."""
    return pd.Series([_kept_path(np.asarray(r, float).tobytes(), np.asarray(s, float).tobytes()) for r, s in zip(rendered, source, strict=True)])


@lru_cache(256)
def _kept_path(rendered: bytes, source: bytes) -> list[int]:
    """_gap_path, remembered, as lines come again."""
    return _gap_path(np.frombuffer(rendered, float), np.frombuffer(source, float), 1.0).tolist()


def assemble(lines: DataFrame, placements: DataFrame, rows: DataFrame, script: str = "฀-๿") -> DataFrame:
    """(id, sheet): lyrics word for word, symbols put in, and rows of symbols between them.

    lines: id, line_no, line; those with a letter of the script are sung and numbered from 0. placements: id,
    sung, char, symbol, score. rows: id, after (how many sung lines stand before), n, seq. The first row at a
    place is labelled: Intro before all, Outro after all, else Instru.
    """
    sung = F.rlike("line", F.lit(f"[{script}]"))
    by_line = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("is_sung", sung).withColumn("count", F.sum(sung.cast("int")).over(by_line))
    marks = placements.where("symbol != ''").groupBy("id", "sung").agg(F.array_sort(F.collect_list(F.struct(F.col("char").alias("at"), "symbol"))).alias("marks"))
    met = numbered.join(marks.hint("merge"), (numbered["id"] == marks["id"]) & numbered["is_sung"] & (numbered["count"] - 1 == marks["sung"]), "left").select(numbered["id"], "line_no", "line", "count", "marks")
    inside = F.transform("marks", lambda m: F.struct(F.greatest(F.lit(0), F.least(F.length("line"), m["at"])).alias("at"), m["symbol"].alias("symbol")))
    written = met.select("id", F.col("count").alias("k"), F.lit(0).alias("after"), F.col("line_no").alias("n"), F.when(F.col("marks").isNotNull(), insert_markers(F.col("line"), inside)).otherwise(F.col("line")).alias("out"), sung.alias("s"))
    total = numbered.groupBy("id").agg(F.sum(F.col("is_sung").cast("int")).alias("total"))
    label = F.when(F.col("after") == 0, "Intro ").when(F.col("after") >= F.col("total"), "Outro ").otherwise("Instru ")
    first = F.row_number().over(Window.partitionBy("id", "after").orderBy("n")) == 1
    between = rows.join(total.hint("merge"), "id").select("id", F.col("after").alias("k"), F.col("n"), F.concat(F.when(first, label).otherwise(""), "seq").alias("out"))
    # rows follow right after the sung line that they come after, before the lines that aren't sung
    part = F.when(F.col("s"), 0).otherwise(2)
    both = written.select("id", F.struct(F.col("k"), part.alias("p"), F.col("n").cast("long").alias("n"), "out").alias("r")).union(between.select("id", F.struct("k", F.lit(1).alias("p"), F.col("n").cast("long").alias("n"), "out").alias("r")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["out"]), "\n")
    return both.groupBy("id").agg(joined.alias("sheet")).select("id", F.concat(F.regexp_replace("sheet", r"^\s+|\s+$", ""), F.lit("\n")).alias("sheet"))


def align_report(lines: DataFrame, placements: DataFrame, sheets: DataFrame, palettes: DataFrame, bands: DataFrame, script: str = "฀-๿") -> DataFrame:
    """(id, lyric_exact, bad_symbols, placed, rows_match, avg_score, id_confidence, needs_review).

    palettes: id, palette; bands: id, lyric_bands (how many lyric rows the image shows).
    """
    sung = lines.where(F.rlike("line", F.lit(f"[{script}]")))
    want = sung.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "").alias("want"), F.count("*").alias("sung"))
    plain = F.filter(F.split("sheet", "\n"), lambda l: ~F.rlike(l, F.lit(r"^\s*\{.*\}\s*$")) & ~F.rlike(l, F.lit(LABEL)))
    got = sheets.select("id", F.regexp_replace(F.array_join(plain, "\n"), r"\[[^\]]*\]", "").alias("got"))
    symbols = placements.join(palettes.hint("merge"), "id", "left").where("symbol != ''")
    scored = symbols.groupBy("id").agg(
        F.round(F.avg("score"), 3).alias("avg_score"), F.round(F.avg(F.when(F.col("score") >= LOW_SCORE, 1.0).otherwise(0.0)), 3).alias("id_confidence"), F.count("*").alias("placed"),
        F.array_sort(F.collect_set(F.when(~palette_ok(F.col("symbol"), F.coalesce("palette", F.array().cast("array<string>"))), F.col("symbol")))).alias("bad_symbols"),
    )
    met = want.join(got.hint("merge"), "id").join(bands.hint("merge"), "id", "left").join(scored.hint("merge"), "id", "left")
    exact = only_script(F.col("want"), script) == only_script(F.col("got"), script)
    match = F.coalesce(F.col("lyric_bands") == F.col("sung"), F.lit(False))
    sure = F.coalesce("id_confidence", F.lit(0.0))
    bad = F.coalesce("bad_symbols", F.array().cast("array<string>"))
    return met.select(
        "id", exact.alias("lyric_exact"), bad.alias("bad_symbols"), F.coalesce("placed", F.lit(0)).alias("placed"), match.alias("rows_match"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), sure.alias("id_confidence"),
        (~exact | (F.size(bad) > 0) | ~match | (sure < SURE)).alias("needs_review"),
    )


def available_offline(songs: DataFrame, texts: DataFrame, images: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``cached``: whether a song's text or its image is there."""
    both = texts.select(key).union(images.select(key)).distinct().withColumn("_there", F.lit(True))
    return songs.join(both, key, "left").withColumn("cached", F.coalesce("_there", F.lit(False))).drop("_there")
