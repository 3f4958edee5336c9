"""Hilbert-curve shards: metadata dimensions are quantised, rows follow the curve, and runs of it are cut.

Rows that are near in every dimension stand near on the curve, so each shard (or file) covers a small box
of the metadata space and a reader's filters on any of the dimensions skip most of the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyrebird.operators.names import numbered
from lyrebird.runtime import stage_table, unused

#: Bits for each dimension; a dimension has at most 2**BITS - 1 cut points, whatever the input's size.
BITS = 5
#: Distinct values of a dimension that are cut on the driver; more are numbered on the cluster.
FEW = 4096


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell with these coordinates (each from 0 to 2**bits - 1).

    The coordinates go through the usual exchange-and-invert steps from the highest bit down, then
    through a Gray code; the bits of what results, dealt out dimension by dimension, are the place.
    """
    n = len(axes)
    if n == 1:
        return axes[0].cast("long")
    steps = F.array(*[F.struct(F.lit(1 << level).alias("q"), F.lit(i).alias("i")) for level in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own, first = F.get(x, s["i"]), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        invert = own.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, j: F.when(invert, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), step)

    def gray(x: Column, i: Column) -> Column:
        return F.transform(x, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))

    coded = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), turned, gray)

    def flip(t: Column, level: Column) -> Column:
        return F.when(F.get(t, F.lit(n - 1)).bitwiseAND(level) != 0, F.transform(t, lambda v, j: F.when(j == n, v.bitwiseXOR(level - 1)).otherwise(v))).otherwise(t)

    # the last entry gathers what all coordinates are flipped by
    held = F.aggregate(F.array(*[F.lit(1 << level) for level in range(bits - 1, 0, -1)]), F.concat(coded, F.array(F.lit(0))), flip)
    order = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(i).alias("i")) for level in range(bits - 1, -1, -1) for i in range(n)])

    def deal(h: Column) -> Column:
        def step(out: Column, s: Column) -> Column:
            return out * 2 + F.call_function("shiftright", F.get(h, s["i"]).bitwiseXOR(F.get(h, F.lit(n))), s["level"]).bitwiseAND(F.lit(1))

        return F.aggregate(order, F.lit(0).cast("long"), step)

    return F.get(F.transform(F.array(held), deal), F.lit(0))  # held is worked out once


def curve_table(spark: SparkSession, n: int, bits: int) -> DataFrame:
    """(cell, curve) for all 2**(n * bits) cells, whatever the input; a cell packs its coordinates, first highest."""
    side = F.lit((1 << bits) - 1)
    axes = [F.call_function("shiftright", F.col("cell"), F.lit(bits * (n - 1 - i))).bitwiseAND(side) for i in range(n)]
    return spark.range(1 << n * bits).withColumnRenamed("id", "cell").select("cell", hilbert_index(axes, bits).alias("curve"))


def _measure(df: DataFrame, name: str) -> Column:
    """What orders a dimension: a long for numbers, a string for anything else."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.floor(F.col(name) * 1024).cast("long")
    return F.col(name).cast("string")


def cut_points(df: DataFrame, dims: list[str], bits: int = BITS) -> dict[str, list]:
    """For each dimension, at most 2**bits - 1 values that part it into equal shares.

    Shares are of rows for numbers and of distinct values for anything else. Only the dimensions are read. Of
    more than FEW distinct values the cut points alone come to the driver.
    """
    shares = 1 << bits
    points: dict[str, list] = {}
    for name in dims:
        values = df.select(_measure(df, name).alias("v"))
        if isinstance(df.schema[name].dataType, T.NumericType):
            found = values.agg(F.percentile_approx("v", [i / shares for i in range(1, shares)], 10_000).alias("p")).first()["p"] or []
        else:
            values = values.where("v is not null").distinct()
            held = sorted(r["v"] for r in values.limit(FEW + 1).collect())
            n = len(held)
            if n > FEW:
                ranked = numbered(values, ["v"])
                n = ranked.count()
                found = [r["v"] for r in ranked.where(F.col("n").isin(*sorted({n * i // shares for i in range(1, shares)}))).collect()]
            else:
                found = [held[n * i // shares] for i in range(1, shares)] if held else []
        points[name] = sorted(set(found))
    return points


def with_curve(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """df with the rows' place on the curve over the dimensions; a null value counts as the smallest.

    The curve is worked out once for each cell of the grid, whose size bits and dims alone decide. Columns of
    any name pass unchanged but for one called ``name``, which is replaced.
    """
    if len(dims) * bits > 18:
        raise ValueError("the grid has more than 2**18 cells; take fewer dimensions or bits")
    points = cut_points(df, dims, bits)

    def cell(dim: str) -> Column:
        if not points[dim]:
            return F.lit(0)
        v = _measure(df, dim)
        return F.coalesce(reduce(lambda a, b: a + b, [(v > F.lit(p)).cast("int") for p in points[dim]]), F.lit(0))

    at = unused("cell", df)
    place = reduce(lambda a, b: a * (1 << bits) + b, [cell(d).cast("long") for d in dims])
    grid = curve_table(df.sparkSession, len(dims), bits).select(F.col("cell").alias(at), F.col("curve").alias(name))
    return df.withColumn(at, place).drop(name).join(F.broadcast(grid), at).drop(at)


def hilbert_shards(docs: DataFrame, n_shards: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Each row's shard: runs of the curve whose counts of rows are at most one apart.

    Rows of one cell follow the id, then the text's checksum and size; rows that agree in all of these are
    alike, and either may come first. A null text has no bytes and the checksum 0; null ids come first;
    rows of an empty table get no shards. A cell, source or text that holds a third of all rows is cut like
    any other run, and a text of any length counts whole. Only the id, the text and the dimensions are read (a dimension that the table lacks is
    left out), so other columns' names don't matter.

    Returns id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard (null under this law)
    and curve. The texts are read once, to write narrow rows; one shuffle of these: ranks come from the rows'
    places in the sorted partitions.
    """
    dims = [d for d in dims if d in docs.columns]
    if not dims:
        dims = [id_col]
    kept = docs.select(F.col(id_col), F.col(text_col), *[F.col(d) for d in dims if d not in (id_col, text_col)])
    narrow = with_curve(kept, dims, bits, "_curve").select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("_curve").alias("curve"),
    )
    order = ["curve", "doc_id", "text_crc32", "size"]
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = stage_table(narrow, "narrow")
    placed = stage_table(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    # one row for each partition: how many rows stand before it
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(F.call_function("shiftright", F.col("place"), F.lit(33)).alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("part", F.call_function("shiftright", F.col("place"), F.lit(33)))
        .join(offsets, "part")
        .withColumn("rank", rank)
        .withColumn("shard", F.expr(f"int((rank * {n_shards}) div {max(total, 1)})"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("rank") - F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "curve",
        )
    )


def write_runs(docs: DataFrame, path: str, n_files: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", bits: int = BITS) -> None:
    """Write the whole rows as files along the curve; each file's Parquet statistics bound a small box.

    Repeated rows are written as often as they come, texts of any length whole, nulls as the smallest values of
    their dimensions; an empty table gives files without rows.
    """
    curve = unused("curve", docs)
    curved = with_curve(docs, [d for d in dims if d in docs.columns] or [id_col], bits, curve)
    curved.repartitionByRange(n_files, curve, id_col).sortWithinPartitions(curve, id_col).drop(curve).write.parquet(path)
