"""Search over titles, recency-aware order, and related items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.functions.text import has_all, has_run, name_tokens, search_key
from lyrebird.operators.names import numbered
from lyrebird.runtime import spread_join, stage_table


def with_search_key(df: DataFrame, name_col: str, nfc: bool = True) -> DataFrame:
    return df.withColumn("search_key", search_key(F.col(name_col), nfc))


def search(df: DataFrame, query: str, id_col: str = "id", limit: int = 500) -> DataFrame:
    """The first ``limit`` rows by id whose ``search_key`` has every token of the query."""
    return df.where(has_all(F.col("search_key"), query)).orderBy(id_col).limit(limit)


def search_within(df: DataFrame, query: str, name_col: str = "name") -> DataFrame:
    """Rows whose name has the query as one run; for lists that are short and already ordered."""
    return df.where(has_run(F.col(name_col), query))


def in_list_order(items: DataFrame, catalogue: DataFrame, id_col: str = "id") -> DataFrame:
    """The catalogue's rows of (pos, id) lists, with their places; ids that the catalogue lacks go."""
    return items.join(catalogue, id_col)


def pinned(catalogue: DataFrame, recents: DataFrame, id_col: str = "id") -> DataFrame:
    """All rows with their place: recent ones first in their order (column ``pos``), then the rest by id."""
    marked = catalogue.join(recents.select(id_col, "pos"), id_col, "left").withColumn("_late", F.coalesce("pos", F.lit((1 << 62))))
    return numbered(marked, ["_late", id_col], "place").drop("_late")


def first_found(own: DataFrame, others: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: one's own if there is one, else the first of the others'."""
    both = own.select("*", F.lit(0).alias("_rank")).unionByName(others.select("*", F.lit(1).alias("_rank")))
    fields = [c for c in both.columns if c not in (key, "_rank")]
    best = both.groupBy(key).agg(F.min(F.struct("_rank", *order, *[f for f in fields if f not in order])).alias("b"))
    return best.select(key, *[F.col(f"b.{f}").alias(f) for f in fields])


def related(catalogue: DataFrame, n: int = 12) -> DataFrame:
    """(id, rank, other): for each row of (id, name) up to n others.

    First the n smallest ids that share a token of the name, then the row's followers on the ring of all
    ids. Only the n + 1 smallest ids of a token can ever count, so each token is cut to these before the
    join, and a token that very many rows have is dealt over several tasks; only rows with fewer
    than n such look at the ring, whose next 2n - 1 followers suffice, as at most n - 1 of them can be taken already.
    """
    songs = numbered(catalogue.select("id", "name"), ["id"], "idx")
    total = songs.count()
    words = songs.select("id", F.explode(F.array_distinct(name_tokens(F.col("name")))).alias("token"))
    heads = first_n(words, "token", "id", n + 1).groupBy("token").agg(F.collect_list("id").alias("others"))
    heads = heads.join(words.groupBy("token").agg(F.count("*").alias("rows")), "token")
    met = spread_join(words, heads, ["token"], "rows").select("id", F.explode("others").alias("other"))
    shared = first_n(met.where("id != other"), "id", "other", n)
    shared = shared.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("shared"))
    none = F.array().cast("array<long>")
    songs = stage_table(songs.join(shared, "id", "left").withColumn("shared", F.coalesce("shared", none)), "related")
    steps = min(2 * n - 1, max(total - 1, 0))
    few = songs.where(F.size("shared") < n).select("id", "idx") if steps else songs.select("id", "idx").limit(0)
    ring = few.select("id", F.explode(F.sequence(F.lit(1), F.lit(max(steps, 1)))).alias("step"), "idx")
    ring = ring.withColumn("at", (F.col("idx") + F.col("step")) % F.lit(max(total, 1))).join(songs.select(F.col("idx").alias("at"), F.col("id").alias("other")), "at")
    followers = ring.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "other"))), lambda s: s["other"]).alias("followers"))
    both = songs.select("id", "shared").join(followers, "id", "left").withColumn("followers", F.coalesce("followers", none))
    picked = F.slice(F.concat("shared", F.array_except("followers", "shared")), 1, n)
    return both.select("id", F.posexplode(picked).alias("rank", "other")).select("id", (F.col("rank") + 1).alias("rank"), "other")



def first_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n smallest distinct values of a key; each task cuts its own rows to n before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.select(key, order).distinct().withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
