"""A keyed table that grows by batches, of which each rewrites only the buckets of its own keys.

The table is a number of buckets by the key's hash. A manifest, one small file for each version, says which folder
holds each bucket; a batch writes its buckets anew and then a manifest that names them beside the untouched ones.
Readers see a whole version or the one before. Manifests carry the number of their batch, so a batch that is run
again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lyrebird.runtime import unused

#: Buckets of a new table; a table keeps those that it began with.
BUCKETS = 64


def _store(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[int]:
    place, store = _store(spark, f"{path}/_versions")
    names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/_versions/{version:012d}.json", wholetext=True).first()[0])


def upsert(batch: DataFrame, path: str, key: str, step: Callable[[DataFrame], DataFrame], number: int | None = None, buckets: int = BUCKETS) -> int:
    """Step the table on: each bucket that the batch touches becomes ``step`` over its rows and the batch's.

    step keeps the columns and works key by key. ``number`` is the batch's; one that the table has already seen
    changes nothing. Of two writers of one version the second fails. Returns the table's version. At most
    ``buckets`` bucket numbers go to the driver. Files of versions before the last two are removed.
    """
    spark = batch.sparkSession
    versions = _manifests(spark, path)
    held = _manifest(spark, path, versions[-1]) if versions else {"version": 0, "batch": None, "buckets": buckets, "files": {}, "schema": batch.schema.json()}
    if number is not None and held["batch"] is not None and number <= held["batch"]:
        return held["version"]
    slot = unused("bucket", batch)
    marked = batch.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(held["buckets"])).cast("int"))
    touched = sorted(r[0] for r in marked.select(slot).distinct().collect())
    version = held["version"] + 1
    there = [held["files"][str(b)] for b in touched if str(b) in held["files"]]
    stored = spark.read.schema(batch.schema).parquet(*[f"{path}/{f}" for f in there]) if there else None
    both = batch if stored is None else stored.unionByName(batch)
    out = step(both).select(*batch.columns).withColumn(slot, F.pmod(F.xxhash64(key), F.lit(held["buckets"])).cast("int"))
    data = f"data-{version:012d}"
    out.repartition(slot).write.mode("overwrite").partitionBy(slot).parquet(f"{path}/{data}")
    files = held["files"] | {str(b): f"{data}/{slot}={b}" for b in touched}
    for b in touched:  # a step may leave a bucket empty
        if not _store(spark, f"{path}/{files[str(b)]}")[1].exists(_store(spark, f"{path}/{files[str(b)]}")[0]):
            del files[str(b)]
    place, store = _store(spark, f"{path}/_versions/{version:012d}.json")
    written = store.create(place, False)
    written.write(json.dumps({"version": version, "batch": number, "buckets": held["buckets"], "files": files, "schema": batch.schema.json()}).encode())
    written.close()
    _clean(spark, path, [*versions, version])
    return version


def _clean(spark: SparkSession, path: str, versions: list[int]) -> None:
    """Remove manifests before the last two, and bucket folders that neither of these names."""
    kept = {f for v in versions[-2:] for f in _manifest(spark, path, v)["files"].values()}
    for v in versions[:-2]:
        old = _manifest(spark, path, v)
        for f in set(old["files"].values()) - kept:
            place, store = _store(spark, f"{path}/{f}")
            store.delete(place, True)
        place, store = _store(spark, f"{path}/_versions/{v:012d}.json")
        store.delete(place, False)


def read_upserted(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last version, or of one of the last two."""
    versions = _manifests(spark, path)
    if not versions:
        raise FileNotFoundError(f"no table under {path}")
    held = _manifest(spark, path, version or versions[-1])
    schema = StructType.fromJson(json.loads(held["schema"]))
    files = [f"{path}/{f}" for f in held["files"].values()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def upserting(stream: DataFrame, path: str, key: str, step: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
    """A writer of a stream whose batches are upserted one after another."""
    return stream.writeStream.foreachBatch(lambda batch, number: upsert(batch, path, key, step, number, buckets) and None)
