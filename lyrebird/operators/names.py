"""Catalogue names: collisions, disambiguation, the slim catalogue, chunks and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.functions.text import clean_name, encode_uri, slugify, xml_escape
from lyrebird.runtime import spread_join, stage_table, unused


def counted_names(df: DataFrame, name_col: str, key: str = "name_key") -> DataFrame:
    """How many rows share each lower-cased name: a small table for a join, summed in tasks first."""
    return df.groupBy(F.lower(F.col(name_col)).alias(key)).agg(F.count("*").alias("same_name"))


def disambiguate(df: DataFrame, id_col: str, name_col: str, prefix: str = "") -> DataFrame:
    """Adds ``name``: the cleaned name, with ``_id`` after it for every row whose name, in any case, is shared.

    Counts are aggregated, only shared names are joined back, and a name that very many rows share is dealt
    over several tasks. Null names stay null. Columns of any other name pass unchanged; a column ``name`` is
    replaced.
    """
    clean, key, same = (unused(c, df) for c in ("clean", "key", "same"))
    cleaned = df.withColumn(clean, clean_name(F.col(name_col), prefix)).withColumn(key, F.lower(clean))
    shared = counted_names(cleaned.select(clean), clean, key).where("same_name > 1").withColumn(same, F.lit(True))
    named = spread_join(cleaned, shared, [key], "same_name", "left")
    return named.withColumn("name", F.when(F.col(same), F.concat_ws("_", clean, F.col(id_col).cast("string"))).otherwise(F.col(clean))).drop(clean, key, same)


def collision_report(df: DataFrame, id_col: str, name_col: str, prefix: str = "") -> DataFrame:
    """(name_lower, n, ids): names that more than one row has, with the ids in order.

    A row for each name, so a name's ids must fit a row; ``collisions`` has them as rows.
    """
    found = collisions(df, id_col, name_col, prefix)
    return found.groupBy("name_lower", "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def collisions(df: DataFrame, id_col: str, name_col: str, prefix: str = "") -> DataFrame:
    """(name_lower, n, id): the rows whose name, in any case, n rows have, n being over one."""
    cleaned = df.select(F.lower(clean_name(F.col(name_col), prefix)).alias("name_lower"), F.col(id_col).alias("id"))
    shared = cleaned.groupBy("name_lower").agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n"))
    return spread_join(cleaned, shared, ["name_lower"], "rows").select("name_lower", "n", "id")


def slim_catalogue(df: DataFrame, with_text: DataFrame, id_col: str, name_col: str, prefix: str = "") -> DataFrame:
    """id, name and has_text; ``with_text`` is a table of ids (column ``id``)."""
    named = disambiguate(df, id_col, name_col, prefix).select(F.col(id_col).alias("id"), "name")
    return named.join(with_text.select("id").distinct().withColumn("_has", F.lit(True)), "id", "left").select("id", "name", F.coalesce("_has", F.lit(False)).alias("has_text"))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Adds a gapless number from 0 in the order given, without bringing the rows to one task.

    The rows are range-sorted and written as Parquet; each partition's share is counted, and what stands
    before it is added.
    """
    at, p, b = (unused(c, df) for c in ("place", "part", "before"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage_table(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.call_function("shiftright", F.col(at), F.lit(33))
    held = sorted((r["p"], r["c"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    before, total = [], 0
    for number, rows in held:  # one row for each partition
        before.append((number, total))
        total += rows
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, f"{p} long, {b} long"))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(p, part).join(offsets, p).withColumn(name, F.col(b) + inside).drop(p, b, at)


def sitemap(catalogue: DataFrame, base: str, chunk: int = 45_000) -> DataFrame:
    """(part, id, loc): the pages of songs that have text, ``chunk`` to a file, in the order of ids."""
    pages = numbered(catalogue.where("has_text").select("id", "name"), ["id"])
    loc = xml_escape(F.concat(F.lit(f"{base}/song/"), F.col("id").cast("string"), F.lit("/"), encode_uri(slugify(F.col("name")))))
    return pages.select((F.floor(F.col("n") / chunk) + 1).cast("long").alias("part"), "id", loc.alias("loc"))


def sitemap_index(chunks: DataFrame, base: str) -> DataFrame:
    """(part, loc, n): the files of a sitemap."""
    counts = chunks.groupBy("part").agg(F.count("*").alias("n"))
    return counts.select("part", F.concat(F.lit(f"{base}/sitemaps/songs-"), F.col("part").cast("string"), F.lit(".xml")).alias("loc"), "n")


def suffixed_duplicates(df: DataFrame, group: list[str], order: list[str], name_col: str, out: str = "shown") -> DataFrame:
    """Adds the shown name: the second and later rows of a name in a group get `` (n)`` in display order."""
    n = F.row_number().over(Window.partitionBy(*group, name_col).orderBy(*order))
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(name_col), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(name_col)))


def song_card(df: DataFrame, base: str) -> DataFrame:
    """(id, json): a structured-data record for each song of (id, name, artist, song_key)."""
    url = F.concat(F.lit(f"{base}/song/"), F.col("id").cast("string"), F.lit("/"), encode_uri(slugify(F.col("name"))))
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("MusicComposition").alias("@type"), F.col("name"), url.alias("url"), F.col("artist").alias("composer"), F.col("song_key").alias("musicalKey"))
    return df.select("id", F.to_json(body).alias("json"))


def song_graph(df: DataFrame, base: str, home: str = "Home") -> DataFrame:
    """(id, json): a song's graph of records, from (id, name, symbols): the work, its breadcrumbs and, if it has symbols, a question about them."""
    url = F.concat(F.lit(f"{base}/song/"), F.col("id").cast("string"), F.lit("/"), encode_uri(slugify(F.col("name"))))
    kind = lambda k: F.lit(k).alias("@type")
    step = lambda n, name, item: F.struct(kind("ListItem"), F.lit(n).alias("position"), name.alias("name"), item.alias("item"))
    work = F.to_json(F.struct(kind("MusicComposition"), F.col("name"), url.alias("url")))
    crumbs = F.to_json(F.struct(kind("BreadcrumbList"), F.array(step(1, F.lit(home), F.lit(f"{base}/")), step(2, F.col("name"), url)).alias("itemListElement")))
    answer = F.struct(kind("Answer"), F.array_join("symbols", ", ").alias("text"))
    asked = F.to_json(F.struct(kind("FAQPage"), F.array(F.struct(kind("Question"), F.col("name"), answer.alias("acceptedAnswer"))).alias("mainEntity")))
    nodes = F.array_compact(F.array(work, crumbs, F.when(F.size("symbols") > 0, asked)))
    return df.select("id", F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(nodes, ","), F.lit("]}")).alias("json"))
