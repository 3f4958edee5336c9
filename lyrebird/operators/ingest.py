"""Ingestion: append-only logs, what is left to do, and the finished table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.functions.text import is_image


def last_write(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. Partial maxima go before the shuffle, so a busy key is no task's burden."""
    fields = [c for c in log.columns if c not in (key, order)]
    last = log.groupBy(key).agg(F.max_by(F.struct(order, *fields), F.col(order)).alias("r"))
    return last.select(key, f"r.{order}", *[f"r.{c}" for c in fields])


def status_tally(df: DataFrame, status_col: str = "status") -> DataFrame:
    return df.groupBy(status_col).agg(F.count("*").alias("n"))


def page_status(code: Column, has_block: Column, src: Column) -> Column:
    """What a fetched page is; the first that holds."""
    return F.when(code == 404, "404").when(~has_block, "no_div").when(src.isNull() | (src == ""), "no_img").when(~is_image(src), "placeholder").otherwise("ok")


def todo_any(ids: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Ids that no log row names, whatever its status."""
    return ids.join(log.select(key), key, "left_anti")


def todo_settled(ids: DataFrame, log: DataFrame, settled: tuple[str, ...] = ("ok", "no_lyrics"), key: str = "id") -> DataFrame:
    """Ids without a settled row; those that failed are tried again."""
    return ids.join(log.where(F.col("status").isin(*settled)).select(key), key, "left_anti")


def worklist(df: DataFrame, done: DataFrame, key: str = "id", ids: list[int] | None = None, start: int = 0, limit: int | None = None, force: bool = False, skip: int = 0) -> DataFrame:
    """Rows to work on: those named, whether done or not; else from ``start`` on and not done.

    Of these, in the order of the key, ``skip`` are left out and then ``limit`` are taken.
    """
    if ids is not None:
        picked = df.where(F.col(key).isin(*ids))
    else:
        picked = df.where(F.col(key) >= start)
        picked = picked if force else picked.join(done.select(key), key, "left_anti")
    if skip or limit is not None:
        picked = picked.orderBy(key)
        picked = picked.offset(skip) if skip else picked
        picked = picked.limit(limit) if limit is not None else picked
    return picked


def finalize(log: DataFrame, blocklist: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """The table that a log amounts to: last rows, without blocked ids, with real images only."""
    return last_write(log, key, order).join(blocklist.select(key), key, "left_anti").where(is_image(F.col("src")))


def merged_blocklists(*lists: DataFrame, key: str = "id") -> DataFrame:
    """The ids of all lists, each once, in ascending order; null ids go."""
    out = lists[0].select(key)
    for more in lists[1:]:
        out = out.union(more.select(key))
    return out.where(F.col(key).isNotNull()).distinct().orderBy(key)


def largest_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: the largest id, null ids as 0, and 0 for an empty table."""
    return df.agg(F.coalesce(F.max(F.coalesce(F.col(key), F.lit(0))), F.lit(0)).alias("largest"))


def probe_end(hits: DataFrame, start: int, misses: int, key: str = "id") -> DataFrame:
    """One row, ``last``: the last hit before the first ``misses`` ids in a row from start on that are no hits.

    ``start - 1`` if the very first ids are misses. Gaps are seen from one hit to the next. Hits are cut into
    ranges of ids; a range knows its own gaps, its first and its last hit, so ranges chain through a row each
    and the ids themselves never come to one task.
    """
    width = 1 << 20
    ids = hits.where(F.col(key) >= start).select(F.col(key).alias("id")).distinct().withColumn("range", F.floor((F.col("id") - start) / width))
    gap = F.col("id") - F.lag("id").over(Window.partitionBy("range").orderBy("id"))
    inner = ids.withColumn("gap", gap)
    ranges = inner.groupBy("range").agg(F.min("id").alias("first"), F.max("id").alias("end"), F.min(F.when(F.col("gap") > misses, F.col("id") - F.col("gap"))).alias("stop"))
    # one row for each range of a million ids
    before = F.coalesce(F.lag("end").over(Window.orderBy("range")), F.lit(start - 1))
    chained = ranges.withColumn("before", before)
    stops = chained.select(F.when(F.col("first") - F.col("before") > misses, F.col("before")).otherwise(F.col("stop")).alias("stop"), "end")
    return stops.agg(F.coalesce(F.min("stop"), F.max("end"), F.lit(start - 1)).alias("last"))


def upload_plan(local: DataFrame, stored: DataFrame, key: str = "key", force: bool = False) -> DataFrame:
    """Files to send: all if forced, else those that the store lacks or has in another size."""
    both = local.join(stored.select(F.col(key), F.col("size").alias("stored_size")), key, "left")
    return (both if force else both.where(~F.col("size").eqNullSafe(F.col("stored_size")))).drop("stored_size")
