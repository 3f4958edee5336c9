"""What every job needs from the cluster: shared scratch space, stage tables and code on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a session on this machine alone (tests,
    a laptop) gets a folder of its own, which becomes the session's checkpoint folder; on a cluster, where
    executors couldn't see such a folder, this raises.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            shared = held.get()
        elif sc.master.startswith("local"):
            shared = tempfile.mkdtemp(prefix="lyrebird-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint: the lineage ends in files that every executor can read."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again; it is removed when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is removed."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the hash of its keys over as many tasks as shuffles have.

    Narrow rows that much work follows upon fill few file splits, often one; dealt first, the work goes over all
    tasks, and groups, windows and joins by the same keys need no further shuffle. It keeps its number of tasks
    whatever the size of the rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of one key that a join brings to a task at most, about.
SPREAD = 1 << 20


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined with a table that has each key once and, in the column ``n``, how many rows have it.

    A key that more than ``most`` rows have is dealt over as many copies of its table row, by a hash of each
    row's own columns, so that a row that is computed again goes where it went before (rows alike in all
    columns stay together). Only these keys are broadcast: there are at most rows / most of them. ``n`` doesn't
    show in the result. Null keys meet nothing.
    """
    most = most or SPREAD
    copies, salt = unused("copies", rows, table), unused("salt", rows, table)
    table = table.withColumn(copies, F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int"))
    common = table.where(F.col(copies) > 1).select(*keys, copies)
    marked = rows.join(F.broadcast(common), keys, "left").withColumn(salt, salt_of(rows, F.col(copies))).drop(copies)
    dealt = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop(copies, n)
    return marked.join(dealt, [*keys, salt], how).drop(salt)


def salt_of(rows: DataFrame, n: Column) -> Column:
    """A number under n for each row, decided by its values alone; 0 where n is null. Columns that hold maps don't count."""
    own = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.coalesce(F.pmod(F.xxhash64(*own), n), F.lit(0)).cast("int")


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def ship(spark: SparkSession) -> None:
    """Give executors this package's Python files, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_lyrebird_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    folder = tempfile.mkdtemp(prefix="lyrebird-code-")
    path = os.path.join(folder, "lyrebird_code.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(path)
    sc._lyrebird_shipped = True
