"""Sources: logs, arrays, listings, texts and sitemaps, each with its schema declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.text import trimmed

RECORDS = "id long, src string, alt string"
SCRAPE_LOG = "id long, src string, alt string, status string"
SONG_TEXTS = "id long, lyrics string, palette array<string>, status string, error string"


def json_array(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str = SCRAPE_LOG) -> DataFrame:
    """One record a line; blank and malformed lines go.

    Adds ``line_no``, a struct that orders lines as they were appended: by the append's number
    (``sinks.append_log``; other files have 0 and go by their time), the file, its part and the place there.
    It doesn't depend on how the files are packed into tasks.
    """
    batch = F.coalesce(F.regexp_extract(F.col("_metadata.file_path"), r"/batch=([0-9]+)/[^/]*$", 1).try_cast("long"), F.lit(0))
    time = F.when(batch == 0, F.col("_metadata.file_modification_time"))
    place = F.struct(batch.alias("batch"), time.alias("at"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", place.alias("line_no"))
    parsed = lines.select("line_no", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null and r.id is not null").select("line_no", "r.*").drop("_bad")


def listing(spark: SparkSession, path: str, glob: str = "*", store: str = "local") -> DataFrame:
    """(store, key, size) of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.lit(store).alias("store"), F.element_at(F.split("path", "/"), -1).alias("key"), F.col("length").alias("size"))


def by_suffix(files: DataFrame, suffix: str = ".webp", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Files with the suffix, in any case and after a name, and all others (strays)."""
    ours = F.rlike(F.lower(F.col(key)), F.lit(r"[^.].*\Q" + suffix.lower() + r"\E$"))
    return files.where(ours), files.where(~ours)


def ids_with_text(files: DataFrame, key: str = "key") -> DataFrame:
    """The ids of files named ``<id>.md``."""
    return files.select(F.regexp_extract(key, r"^(\d+)\.md$", 1).alias("id")).where("id != ''").select(F.col("id").try_cast("long").alias("id"))


def texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(id, text) of ``<id>.md`` files; blank ones have a null text."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return files.select(F.regexp_extract("name", r"^(\d+)\.", 1).try_cast("long").alias("id"), F.when(trimmed(F.col("value")) != "", F.col("value")).alias("text"))


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON array of numbers; a file that isn't one has none."""
    values = spark.read.text(path, wholetext=True)
    return values.select(F.explode(F.from_json("value", "array<long>")).alias("id")).where("id is not null")


def local_or_remote(local: DataFrame, remote: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """(key, content): the local content, else the remote one."""
    both = local.select(key, F.col(content).alias("_l")).join(remote.select(key, F.col(content).alias("_r")), key, "full")
    return both.select(key, F.coalesce("_l", "_r").alias(content))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``k=v`` lines; quotes go, comments too, and the first of a key counts, by file and line."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("n")).where(~F.rlike("value", F.lit(r"^\s*(#|$)")))
    pairs = lines.select("n", F.trim(F.regexp_extract("value", r"^([^=]*)=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("value", r"^[^=]*=(.*)$", 1)), r"^[\"']|[\"']$", "").alias("v"))
    return pairs.where("key != ''").groupBy("key").agg(F.min_by("v", "n").alias("value"))
