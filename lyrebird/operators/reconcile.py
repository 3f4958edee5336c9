"""Audits of what should be there against what is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, key: str = "key", **stores: DataFrame) -> DataFrame:
    """(key, expected, <store>...): where each key is found. One union, one aggregation."""
    names = ["expected", *stores]
    tagged = [df.select(key, *[F.lit(n == name).alias(n) for n in names]) for name, df in (("expected", expected), *stores.items())]
    return reduce(DataFrame.union, tagged).groupBy(key).agg(*[F.bool_or(n).alias(n) for n in names])


def discrepancies(found: DataFrame, *stores: str, key: str = "key") -> DataFrame:
    """(report, key): missing_<store> and orphan_<store> for each store, as rows."""
    reports = F.array(*[F.when(F.col("expected") & ~F.col(s), F.lit(f"missing_{s}")) for s in stores], *[F.when(~F.col("expected") & F.col(s), F.lit(f"orphan_{s}")) for s in stores])
    return found.select(F.explode(F.filter(reports, lambda r: r.isNotNull())).alias("report"), key)


def strays(key: str = "key", **stores: DataFrame) -> DataFrame:
    """(report, key): stray_<store> for the files of each store that are none of the expected kind (``sources.files.by_suffix``)."""
    return reduce(DataFrame.union, [df.select(F.lit(f"stray_{name}").alias("report"), key) for name, df in stores.items()])


def verdict(found: DataFrame, *stores: str) -> DataFrame:
    """One row of counts, and whether all agree."""
    counts = [F.count_if("expected").alias("n_expected")]
    for s in stores:
        counts += [F.count_if(F.col("expected") & ~F.col(s)).alias(f"missing_{s}"), F.count_if(~F.col("expected") & F.col(s)).alias(f"orphan_{s}")]
    bad = reduce(lambda a, b: a + b, [F.col(c) for s in stores for c in (f"missing_{s}", f"orphan_{s}")])
    return found.agg(*counts).withColumn("in_sync", bad == 0)


def case_mismatches(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Pairs that agree when lower-cased, with whether they agree exactly."""
    a = left.select(F.col(left_col).alias("wanted"), F.lower(left_col).alias("_k"))
    b = right.select(F.col(right_col).alias("present"), F.lower(right_col).alias("_k"))
    return a.join(b, "_k").select("wanted", "present", (F.col("wanted") == F.col("present")).alias("exact"))


def skip_existing(wanted: DataFrame, present: DataFrame, name_col: str = "name") -> DataFrame:
    """Wanted files whose stem, whatever the ending, isn't present."""
    stem = F.regexp_replace(F.col(name_col), r"\.[^.]*$", "")
    return wanted.withColumn("_stem", stem).join(present.select(stem.alias("_stem")), "_stem", "left_anti").drop("_stem")


def report_json(rows: DataFrame, report_col: str = "report", key: str = "key", sample: int = 50) -> DataFrame:
    """(report, n, json): each report's count and its first keys, cut in tasks before they are shuffled."""
    from pyspark.sql import Window

    counts = rows.groupBy(report_col).agg(F.count("*").alias("n"))
    firsts = rows.withColumn("_r", F.row_number().over(Window.partitionBy(report_col).orderBy(key))).where(F.col("_r") <= sample)
    lists = firsts.groupBy(report_col).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return counts.join(lists, report_col).select(report_col, "n", F.to_json(F.struct(F.col(report_col).alias("report"), "n", "keys")).alias("json"))
