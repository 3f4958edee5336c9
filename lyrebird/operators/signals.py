"""Runs in ordered observations: bands, tone bursts and frames, and overlaps of masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lyrebird.operators.sweeps import following, furthest

# Carrier frequencies in Hz; a frame is S, six digits, E.
TONES = {"S": 18000, **{str(d): 18150 + 75 * d for d in range(10)}, "E": 18975}
TOLERANCE = 37


def merged_bands(bands: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 4, spread: bool = False) -> DataFrame:
    """(key, start, end): bands whose gap to all before them is under ``gap`` become one with these.

    A key's bands come together in one task; with ``spread`` (starts and ends are bigints then, the key isn't null)
    sweeps over range-sorted bands take the place of windows, and a key may hold any share of the rows.
    """
    if spread:
        known = furthest(bands.select(key, start, end), [key], [start, end], F.col(end), "_before")
        opened = F.when(F.col("_before").isNull() | (F.col(start) - F.col("_before") >= gap), F.col(start))
        named = following(known, [key], [start, end, "_before"], opened, "_opened", backward=True)  # of bands alike the one that opens comes first
        return named.groupBy(key, F.coalesce(opened, "_opened").alias("_band")).agg(F.max(end).alias(end)).select(key, F.col("_band").alias(start), end)
    by_start = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col(start) - before >= gap), 1).otherwise(0)
    numbered = bands.withColumn("_opened", opened).withColumn("_band", F.sum("_opened").over(by_start))
    return numbered.groupBy(key, "_band").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_band")


def nearest_tone(freq: Column) -> Column:
    """The symbol whose frequency is nearest, within the tolerance. Null: none.

    Symbols are over twice the tolerance apart, so at most one is within it.
    """
    return F.coalesce(*[F.when(F.abs(freq - hz) <= TOLERANCE, F.lit(s)) for s, hz in TONES.items()])


def bursts(frames: DataFrame, key: str, frame: str = "frame", freq: str = "freq") -> DataFrame:
    """(key, burst, symbol): runs of at least two frames of one tone. A null frequency is silence.

    One silent frame doesn't end a run, two do. Tones of no symbol neither end a run nor count as silence.
    """
    marked = frames.withColumn("symbol", nearest_tone(F.col(freq))).where(F.col(freq).isNull() | F.col("symbol").isNotNull())
    order = Window.partitionBy(key).orderBy(frame)
    quiet = F.col("symbol").isNull()
    pause = quiet & F.coalesce(F.lag(quiet).over(order), F.lit(False))
    marked = marked.withColumn("_pauses", F.sum(F.when(pause, 1).otherwise(0)).over(order))
    heard = marked.where("symbol is not null")
    new = (F.lag("symbol").over(order) != F.col("symbol")) | (F.lag("_pauses").over(order) != F.col("_pauses"))
    numbered = heard.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order))
    runs = numbered.groupBy(key, "_run").agg(F.first("symbol").alias("symbol"), F.count("*").alias("n")).where("n >= 2")
    return runs.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_run")).alias("burst"), "symbol")


def decoded_frames(found: DataFrame, key: str) -> DataFrame:
    """(key, code): the six digits of the first whole frame; a frame of another length before it gives null."""
    joined = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("burst", "symbol"))), lambda b: b["symbol"]), "").alias("s"))
    first = F.regexp_extract("s", r"S([0-9]{0,6})E", 1)
    return joined.select(key, F.when(F.length(first) == 6, first).alias("code"))


@F.pandas_udf(DoubleType())
def mask_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Intersection over union of two packed bit masks (binary); two empty masks overlap wholly."""

    x, y = ([bytes(m or b"") for m in masks] for masks in (a, b))
    size = [max(len(p), len(q)) for p, q in zip(x, y, strict=True)]
    p, q = (np.frombuffer(b"".join(m.ljust(n, b"\0") for m, n in zip(masks, size, strict=True)), np.uint8) for masks in (x, y))
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])

    def bits(m: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(np.bitwise_count(m), dtype=np.int64)])[ends])

    both, either = bits(p & q), bits(p | q)
    return pd.Series(np.where(either == 0, 1.0, both / np.maximum(either, 1)))


def score_report(scores: DataFrame, key: str, score: str = "score", least: float = 0.6) -> DataFrame:
    """(key, mean, share, low, needs_review): mean to three places, share of scores that reach ``least``, and the rest."""
    low = F.array_sort(F.collect_list(F.when(F.col(score) < least, F.col(score))))
    return scores.groupBy(key).agg(F.round(F.avg(score), 3).alias("mean"), F.round(F.avg(F.when(F.col(score) >= least, 1.0).otherwise(0.0)), 3).alias("share"), low.alias("low")).withColumn("needs_review", F.size("low") > 0)
