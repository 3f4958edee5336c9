"""Key detection over tables of symbols."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.music import QUALITIES, key_weights, parse_root, symbol_quality
from lyrebird.runtime import ship


def parsed_symbols(df: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """Adds root and quality; rows whose symbol has no root go."""
    return df.withColumn("root", parse_root(F.col(symbol_col))).where("root is not null").withColumn("quality", symbol_quality(F.col(symbol_col)))


def detect_keys(symbols: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """(id, tonic, mode, confidence) from (id, pos, root, quality); ids without symbols don't show.

    Symbols are counted by id, root and quality, with partial sums; an id's counts, at most 36, come together in
    a row, and the 24 keys of many rows are scored at once. Of the keys with the best score the first symbol's own wins, then
    the tonic that is a root most often, then major, then the lower tonic.
    """
    ship(symbols.sparkSession)
    keys = [(t, m) for m in (False, True) for t in range(12)]
    weights = np.array([key_weights(t, m) for t, m in keys]).T
    as_root = np.array([[int(r == t) for t, _ in keys] for r in range(12) for _ in QUALITIES])
    minor = list(QUALITIES).index("min")

    @F.arrow_udf("struct<tonic:int,minor:boolean,twice:bigint>")
    def scored(first: pa.Array, held: pa.Array) -> pa.Array:
        flat, size = held.flatten(), np.diff(held.offsets.to_numpy())
        n = np.zeros((len(held), 12 * len(QUALITIES)), np.int64)
        kind = flat.field("kind").fill_null(-1).to_numpy()
        known = (kind >= 0) & (kind < n.shape[1])
        np.add.at(n, (np.repeat(np.arange(len(held)), size)[known], kind[known]), flat.field("n").to_numpy()[known])
        points, roots, one = n @ weights, n @ as_root, first.fill_null(-1).to_numpy()
        own = one // len(QUALITIES) + 12 * (one % len(QUALITIES) == minor)
        mine = np.arange(len(keys)) == own[:, None]
        left = np.ones(points.shape, bool)
        for rule in (points, mine, roots):  # of the keys that are left, those with the most
            ranked = np.where(left, rule, -1)
            left = ranked == ranked.max(axis=1, keepdims=True)
        best = left.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(best % 12, pa.int32()), pa.array(best >= 12), pa.array(points[np.arange(len(best)), best])], names=["tonic", "minor", "twice"])

    # the place of a root and quality among all, in the order of key_weights
    kind = F.col("root") * len(QUALITIES) + F.array_position(F.array(*map(F.lit, QUALITIES)), F.col("quality")).cast("int") - 1
    counts = symbols.groupBy(id_col, "root", "quality").agg(F.count("*").alias("n"), F.min(pos_col).alias("pos"))
    whole = counts.groupBy(id_col).agg(F.collect_list(F.struct(kind.cast("int").alias("kind"), "n")).alias("_held"), F.min_by(kind.cast("int"), F.struct("pos", "root", "quality")).alias("_first"), F.sum("n").alias("_total"))
    best = whole.select(id_col, "_total", scored("_first", "_held").alias("b"))
    return best.select(id_col, F.col("b.tonic").alias("tonic"), F.when(F.col("b.minor"), "minor").otherwise("major").alias("mode"), F.least(F.lit(1.0), F.col("b.twice") / 2 / F.col("_total")).alias("confidence"))


def root_histogram(symbols: DataFrame, id_col: str) -> DataFrame:
    return symbols.groupBy(id_col, "root").agg(F.count("*").alias("n"))
