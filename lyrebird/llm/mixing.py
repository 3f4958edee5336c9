"""Mixing sources to target weights: hash thresholds from histograms, without sorting documents.

Every document has a hash of its own. A source's budget is met by the documents below a threshold, found by
histograms: sizes are summed by source and by the hash's leading digits, the bucket in which the running sum
passes the budget is cut into finer buckets, and so on, each time only that one. Thresholds of smaller budgets
are below those of larger ones, so a smaller mix is a part of a larger one.

DataFrame functions only. A source may hold any share of the rows: it is summed with partial sums, its
histogram has at most 2**DIGIT rows a level, and its one row meets the documents by a join that spreads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.operators.names import numbered
from lyrebird.runtime import spread_join, stage_table

#: What a document's size counts.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a document's hash, and of it that a level of histograms tells apart.
HASH, DIGIT = 60, 12


def hashes(id_col: Column, text: Column, seed: int) -> Column:
    """60 bits of a row's id and text, as a bigint; a null id is told from all others, a null text counts as empty."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(own), 1, HASH // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (source_key, source_size, n) with each one's weight and target.

    Sources take the weights by turns in the order of their keys. They divide ``share`` times all sizes by
    weight; none gets over ``most`` times its own size, and what is above goes to the others by weight, until
    none is above. Only sums go to the driver; a round ends at least one source's growth or is the last.
    """
    order = F.array(*[F.lit(float(w)) for w in weights])
    known = stage_table(numbered(sources, ["source_key"], "place").withColumn("weight", F.element_at(order, (F.col("place") % len(weights) + 1).cast("int"))).drop("place"), "sources")
    full = F.col("source_size") * float(most)
    size, weight = known.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, left, stopped = share * (size or 0), weight or 1.0, 0
    while True:
        part = F.col("weight") * F.lit(float(budget)) / F.lit(float(left))
        held, gone, n = known.where(part > full).agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
        if n == stopped or gone == weight:
            return known.withColumn("target", F.when(part > full, full).otherwise(part))
        budget, left, stopped = share * size - most * held, weight - gone, n


def thresholds(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """(source_key, need, below): the rows of a source whose hash is under ``below`` have about ``need`` together.

    ``rows`` has source_key, hash and size, ``needs`` has source_key and need, for one source as many as wanted:
    their thresholds are nested. The sum is off by at most half the size of the rows of one hash at the
    boundary. A source whose rows have no more than ``need`` gets a threshold above all hashes, one without
    rows the same.
    """
    open_, done = needs.select("source_key", "need", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("held")), None
    at = rows.select("source_key", "hash", "size")
    for shift in range(HASH - DIGIT, -1, -DIGIT):
        bucket = F.call_function("shiftright", F.col("hash"), F.lit(shift))
        if done is None:
            summed = at.groupBy("source_key", bucket.alias("fine")).agg(F.sum("size").alias("size"), F.min("hash").alias("first"), F.max("hash").alias("last"))
            cut = open_.join(summed, "source_key", "left")
        else:
            inside = F.call_function("shiftright", F.col("hash"), F.lit(shift + DIGIT)).alias("bucket")
            wanted = open_.select("source_key", "bucket").distinct()
            summed = at.select("source_key", inside, bucket.alias("fine"), "hash", "size").join(wanted, ["source_key", "bucket"])
            summed = summed.groupBy("source_key", "bucket", "fine").agg(F.sum("size").alias("size"), F.min("hash").alias("first"), F.max("hash").alias("last"))
            cut = open_.join(summed, ["source_key", "bucket"])
        # at most 2**DIGIT rows for each source and need
        running = F.sum("size").over(Window.partitionBy("source_key", "need").orderBy("fine").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        passed = cut.withColumn("after", F.col("held") + running).groupBy("source_key", "need").agg(
            F.min(F.when(F.col("after") > F.col("need"), F.struct("fine", "first", "last", F.col("size"), F.col("after")))).alias("b")
        )
        passed = stage_table(passed.select("source_key", "need", "b.*"), "boundary")
        over, under = F.col("after") - F.col("need"), F.col("need") - (F.col("after") - F.col("size"))
        below = F.when(F.col("fine").isNull(), F.lit(1 << HASH)).when(over < under, F.col("last") + 1).otherwise(F.col("first"))
        found = passed.where("fine is null or first = last").select("source_key", "need", below.cast("long").alias("below"))
        done = found if done is None else done.unionByName(found)
        open_ = passed.where("first < last").select("source_key", "need", F.col("fine").alias("bucket"), (F.col("after") - F.col("size")).alias("held"))
        if open_.isEmpty():
            break
    return done


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """How often a mix takes each document: doc_id, source, size, source_size, target, repeats, taken.

    Sizes are words between blanks. A source whose target is k times its size and a rest takes all its
    documents k times, and those below its threshold once more; so none is taken more than ``most`` times,
    rounded up. A source's words in the mix are off its target by half a document at most (of the rows that
    agree in id and text, which are taken alike, half of all together). The same rows always give the same mix,
    in whatever order or partitions they come.

    A null or empty text has no words and takes none; a null source is a source of its own, after all others;
    a null id is like any other; an empty table gives no rows; texts of any length count whole; other columns
    are not read. Texts are read once, to write narrow rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = docs.select(F.col(id_col).alias("doc_id"), key.alias("source_key"), size.alias("size"), hashes(F.col(id_col), F.col(text_col), seed).alias("hash"))
    narrow = stage_table(narrow, "sizes")
    sources = targets(narrow.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = stage_table(sources.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    cut = thresholds(narrow, sources.where("need > 0").select("source_key", "need")).select("source_key", "below")
    sources = sources.join(cut, "source_key", "left").select("source_key", "n", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below"))
    repeats = F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return (
        spread_join(narrow, sources, ["source_key"], "n")
        .withColumn("repeats", F.when(F.col("size") > 0, repeats).otherwise(0).cast("long"))
        .select("doc_id", F.when(F.col("source_key") != "t", F.expr("substring(source_key, 2)")).alias("source"), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )
