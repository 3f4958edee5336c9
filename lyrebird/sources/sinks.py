"""Sinks: logs that grow, compacted arrays, slim tables, chunked link lists and rejected rows."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.operators.names import numbered


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as a folder of their own, numbered after those that are there.

    A writer first claims a number by creating a file of that name, which one of two can do; the other takes the
    next one. A writer that fails afterwards leaves its number unused.
    """
    place, store = _folder(rows.sparkSession, path)
    names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
    last = max([int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and n[6:].isdigit()], default=0)
    claim = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    store.mkdirs(place)
    while True:
        last += 1
        try:
            if store.createNewFile(claim(f"{path}/_claim-{last:012d}")):
                break
        except Py4JJavaError as e:  # some stores tell in this way that the file is there
            if "AlreadyExists" not in str(e):
                raise
    rows.write.mode("error").json(f"{path}/batch={last:012d}")


def write_compacted(rows: DataFrame, path: str, key: str = "id") -> None:
    """Sorted by id over all files: the files' names follow the order."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_slim(catalogue: DataFrame, path: str) -> None:
    catalogue.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_chunks(links: DataFrame, path: str, part: str = "part") -> None:
    """One folder for each part."""
    links.repartition(part).write.mode("overwrite").partitionBy(part).json(path)


def chunked(df: DataFrame, order: str, size: int, name: str = "chunk") -> DataFrame:
    """Adds the number of the batch, of at most ``size`` rows each, that a row is sent with."""
    return numbered(df, [order], "_n").withColumn(name, F.floor(F.col("_n") / size)).drop("_n")


def write_report(rows: DataFrame, path: str) -> None:
    """Sidecar records of a run, one JSON object a line."""
    rows.write.mode("overwrite").json(path)


def write_rejected(outcomes: DataFrame, path: str, name: str = "name", error: str = "error") -> DataFrame:
    """Write what failed as lines of name and error between a tab; returns one row, (ok, failed), of all outcomes.

    An outcome without an error is a success. What is written can be read as the next run's work list.
    """
    outcomes.where(F.col(error).isNotNull()).select(name, error).write.mode("overwrite").option("sep", "\t").csv(path)
    return outcomes.agg(F.count_if(F.col(error).isNull()).alias("ok"), F.count_if(F.col(error).isNotNull()).alias("failed"))
