"""Single functions and the file sources and sinks, over the part, orders, customer, events and pages tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions import music
from lyrebird.functions import text as tx
from lyrebird.operators import align, ingest, signals
from lyrebird.plans.catalogue import _LAST_SQL, event_log, slim_catalogue
from lyrebird.plans.registry import ORACLES, Tables, query
from lyrebird.runtime import scratch_path
from lyrebird.sources import files, objects, sinks


def _pick(key: Column, *values: str | Column) -> Column:
    """The value whose place is the key's rest."""
    out = F.when(key % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key % len(values) == i, v)
    return out


def _pick_sql(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders")
def chunk_numbers(t: Tables) -> DataFrame:
    return sinks.chunked(t.orders.select(F.col("o_orderkey").alias("id")), "id", 1000)


@query(f"SELECT id, coalesce(regexp_matches(code, '^[0-9]{{6}}$'), false) AS ok FROM (SELECT c_custkey AS id, {_pick_sql('c_custkey', 'lpad(CAST(c_custkey AS VARCHAR), 6, chr(48))', 'CAST(c_custkey AS VARCHAR)', 'c_name', 'NULL')} AS code FROM customer)")
def room_codes(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), tx.room_code(_pick(k, F.lpad(k.cast("string"), 6, "0"), k.cast("string"), F.col("c_name"), F.lit(None).cast("string"))).alias("ok"))


_HEADS = ("89504E470D0A1A0A0000", "FFD8FFE000", "47494638376100", "47494638396100", "424D00", "52494646000000005745425000", "5249464600000000574156", "00")
_KINDS_SQL = "CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'gif' WHEN starts_with(h, '424D') THEN 'bmp' WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp' END"


@query(f"SELECT id, {_KINDS_SQL} AS kind FROM (SELECT page_id AS id, {_pick_sql('page_id', *(repr(h) for h in _HEADS))} AS h FROM pages)")
def image_kinds(t: Tables) -> DataFrame:
    k = F.col("page_id")
    return t.pages.select(k.alias("id"), tx.image_kind(F.unhex(_pick(k, *_HEADS))).alias("kind"))


@query(r"SELECT p_partkey AS id, regexp_replace('ก' || p_name || ' ไข่ ' || p_type || 'é๙', '[^\x{0E00}-\x{0E7F}]', '', 'g') AS letters FROM part")
def script_letters(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), tx.only_script(F.concat(F.lit("ก"), "p_name", F.lit(" ไข่ "), "p_type", F.lit("é๙"))).alias("letters"))


@query(r"SELECT p_partkey AS id, regexp_replace(p_name || '.*+?^${}()|[]\' || p_brand, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS pattern FROM part")
def escaped_patterns(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), tx.regex_escape(F.concat("p_name", F.lit(".*+?^${}()|[]\\"), "p_brand")).alias("pattern"))


_ANSWERS = ('<think>a\nb</think> ```json\n{"a": 5}\n```', '```\nplain\n```', ' <THINK>x</THINK>so: {"a": 7} ok ', "no JSON", '{"a": 9}', "<think>never closed")
_ANSWER_SQL = _pick_sql("p_partkey", *("'" + a.replace("'", "''") + "'" for a in _ANSWERS))


@query(rf"SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(x, '(?is)<think>.*?</think>', '', 'g'), ' ' || chr(10)), '^```[A-Za-z]*[ \t]*\n?', ''), '\n?```$', '') AS answer FROM (SELECT p_partkey AS id, {_ANSWER_SQL} AS x FROM part)")
def clean_responses(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), tx.clean_response(_pick(k, *_ANSWERS)).alias("answer"))


@query(rf"SELECT id, TRY_CAST(json_extract_string(CASE WHEN o = '' THEN NULL ELSE o END, '$.a') AS INTEGER) AS a FROM (SELECT p_partkey AS id, regexp_extract({_ANSWER_SQL}, '(?s)\{{.*\}}') AS o FROM part)")
def salvaged_answers(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), tx.salvaged_json(_pick(k, *_ANSWERS), "a int")["a"].alias("a"))


_NAMES_SQL = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""SELECT id, degree, (CASE WHEN flats THEN {_NAMES_SQL(music.FLATS)} ELSE {_NAMES_SQL(music.SHARPS)} END)[(tonic + [0, 2, 3, 5, 7, 8, 10][degree + 1]) % 12 + 1] || ['m', '°', '', 'm', '', '', ''][degree + 1] AS symbol
FROM (SELECT p_partkey AS id, p_partkey % 12 AS tonic, p_size % 2 = 0 AS flats, CAST(d AS INTEGER) AS degree FROM part CROSS JOIN (SELECT unnest(range(0, 7)) AS d))""")
def minor_symbols(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 12).cast("int").alias("tonic"), (F.col("p_size") % 2 == 0).alias("flats"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("degree"))
    return rows.select("id", "degree", music.diatonic_symbol(F.col("tonic"), F.col("degree"), F.col("flats"), minor=True).alias("symbol"))


_ROWS = ("G/B", " C / D ", "", "/", "Am", "C//G", " / C //  G /", "F  G   /  Am")
_ROW_SQL = _pick_sql("p_partkey", *(f"'{r}'" for r in _ROWS))
_PALETTES = (("G", "B"), ("C", "D", "Am"), (), ("C", "G/B"), ("F",))
_PALETTE_SQL = _pick_sql("p_partkey", *("CAST([" + ", ".join(f"'{s}'" for s in p) + "] AS VARCHAR[])" for p in _PALETTES))


@query(f"""SELECT id, name = '' OR len(p) = 0 OR list_contains(p, name) OR len(list_filter(list_transform(string_split(name, '/'), lambda x: trim(x)), lambda x: x <> '' AND NOT list_contains(p, x))) = 0 AS ok
FROM (SELECT p_partkey AS id, trim({_ROW_SQL}) AS name, {_PALETTE_SQL} AS p FROM part)""")
def palette_checks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    palettes = [F.array(*map(F.lit, p)).cast("array<string>") for p in _PALETTES]
    return t.part.select(k.alias("id"), align.palette_ok(_pick(k, *_ROWS), _pick(k, *palettes)).alias("ok"))


@query(rf"SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(r, '\s+', ' ', 'g')), '(?:/\s*){{2,}}', '/ ', 'g'), '^[ /]+|[ /]+$', '', 'g')) AS row FROM (SELECT p_partkey AS id, {_ROW_SQL} AS r FROM part)")
def clean_sequences(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), align.clean_sequence(_pick(k, *_ROWS)).alias("row"))


_THAI = ("กี่x", "เพื่อ น", "abc", "ก็", "น้ำใจ")


@query(rf"SELECT id, CAST(CASE WHEN i > 0 AND i < length(s) THEN greatest(i - length(regexp_extract(substr(s, 1, i + 1), '[ัิ-ฺ็-๎]*$')), 0) ELSE i END AS INTEGER) AS at FROM (SELECT p_partkey AS id, p_size % 7 AS i, {_pick_sql('p_partkey', *(repr(s) for s in _THAI))} AS s FROM part)")
def snapped_places(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), align.snap_left(_pick(k, *_THAI), (F.col("p_size") % 7).cast("int")).cast("int").alias("at"))


@query("SELECT p_partkey AS id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) OR p_partkey IN (SELECT s_suppkey * 7 FROM supplier) AS cached FROM part")
def cached_songs(t: Tables) -> DataFrame:
    key = lambda c: c.cast("long").alias("id")
    return align.available_offline(t.part.select(key(F.col("p_partkey"))), t.lineitem.where("l_quantity >= 49").select(key(F.col("l_partkey"))), t.supplier.select(key(F.col("s_suppkey") * 7)))


@query("SELECT id, CASE WHEN a | b = 0 THEN 1.0 ELSE bit_count(a & b) / bit_count(a | b) END AS share FROM (SELECT p_partkey AS id, CAST(p_partkey % 256 AS INTEGER) AS a, CAST(p_size % 4 * 85 AS INTEGER) AS b FROM part)")
def mask_overlaps(t: Tables) -> DataFrame:
    byte = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))
    return t.part.select(F.col("p_partkey").alias("id"), signals.mask_overlap(byte(F.col("p_partkey") % 256), byte(F.col("p_size") % 4 * 85)).alias("share"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderkey % 3 = 0")
def text_ids(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return files.ids_with_text(t.orders.select(F.concat(k, _pick(k, ".md", ".md.bak", "x.md")).alias("key")))


@query("SELECT DISTINCT s_suppkey * 2 AS id FROM supplier")
def blocklist_file(t: Tables) -> DataFrame:
    """JSON arrays of up to a hundred numbers, each a file of its own, and read back."""
    path = scratch_path(t.spark, "blocked")
    arrays = t.supplier.groupBy(F.floor(F.col("s_suppkey") / 100)).agg(F.to_json(F.collect_list(F.col("s_suppkey") * 2)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.blocklist(t.spark, path).distinct()


@query("SELECT CAST(p_partkey AS BIGINT) AS id, 's' || p_size AS src, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS alt FROM part")
def json_array_file(t: Tables) -> DataFrame:
    """Arrays of up to five hundred records, each a file of its own, and read back."""
    path = scratch_path(t.spark, "array")
    rows = t.part.select(F.floor(F.col("p_partkey") / 500).alias("file"), F.to_json(F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("s"), "p_size").alias("src"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("alt"))).alias("r"))
    arrays = rows.groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.json_array(t.spark, path)


@query("SELECT 'KEY' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_suppkey || '=x' END AS value FROM supplier")
def settings_file(t: Tables) -> DataFrame:
    """Settings in several files, with comments, blank lines, quotes and keys that come again."""
    k = F.col("s_suppkey")
    lines = t.supplier.select(k.alias("n"), F.concat(F.lit("KEY"), k, F.when(k % 2 == 0, F.concat(F.lit(' = "'), "s_name", F.lit('"'))).otherwise(F.concat(F.lit("="), k, F.lit("=x")))).alias("value"))
    more = t.supplier.select((k + 1_000_000).alias("n"), _pick(k, F.lit("# a comment = 1"), F.lit("  "), F.concat(F.lit("KEY"), k, F.lit("=later"))).alias("value"))
    path = scratch_path(t.spark, "settings")
    lines.union(more).repartition(F.floor(F.col("n") % 1_000_000 / 50)).sortWithinPartitions("n").select("value").write.text(path)
    return files.settings(t.spark, path)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def compacted_file(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "compacted")
    sinks.write_compacted(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), path)
    return t.spark.read.schema("id long, status string").json(path)


@query("SELECT o_custkey % 5 AS part, o_orderkey AS id FROM orders")
def chunk_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "chunks")
    sinks.write_chunks(t.orders.select((F.col("o_custkey") % 5).alias("part"), F.col("o_orderkey").alias("id")), path)
    return t.spark.read.schema("id long, part long").json(path).select("part", "id")


@query(f"SELECT id, src, status FROM {_LAST_SQL}")
def replayed_log(t: Tables) -> DataFrame:
    """The events appended in three runs of unlike sizes, read back and compacted."""
    log = event_log(t).select("id", "src", F.lit(None).cast("string").alias("alt"), "status", "line_no")
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    path = scratch_path(t.spark, "log")
    cuts = [-1, last // 10, 9 * last // 10, last]
    for low, high in zip(cuts, cuts[1:], strict=False):
        sinks.append_log(log.where((F.col("line_no") > low) & (F.col("line_no") <= high)).orderBy("line_no").drop("line_no"), path)
    return ingest.last_write(files.json_lines(t.spark, path), "id", "line_no").select("id", "src", "status")


@query("SELECT 'store' AS store, 'p' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.txt' AS key, CAST(strlen(p_name) AS BIGINT) AS size FROM part WHERE p_partkey % 50 <> 7")
def put_and_listed(t: Tables) -> DataFrame:
    """An object for each part put into a store, those without a body rejected, and the store listed page by page."""
    store = objects.FolderStore(scratch_path(t.spark, "store"))
    k = F.col("p_partkey")
    rows = t.part.select(F.concat(F.lit("p"), F.lpad(k.cast("string"), 8, "0"), F.lit(".txt")).alias("key"), F.when(k % 50 != 7, F.col("p_name")).alias("body"))
    objects.put_objects(rows, store)
    top = t.part.agg(F.max("p_partkey")).first()[0] or 0
    return objects.paged_listing(t.spark, store, [f"p{top * i // 8:08d}" for i in range(1, 8)], limit=100)


@query("SELECT count(*) FILTER (WHERE p_partkey % 50 <> 7) AS ok, count(*) FILTER (WHERE p_partkey % 50 = 7) AS failed FROM part")
def rejected_puts(t: Tables) -> DataFrame:
    """Outcomes of puts counted, and the failed ones written as the next run's work list."""
    store, k = objects.FolderStore(scratch_path(t.spark, "store")), F.col("p_partkey")
    outcomes = objects.put_objects(t.part.select(F.concat(k, F.lit(".txt")).alias("key"), F.when(k % 50 != 7, F.col("p_name")).alias("body")), store)
    return sinks.write_rejected(outcomes, scratch_path(t.spark, "rejected"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name || chr(10) || s_suppkey END AS text FROM supplier")
def song_texts(t: Tables) -> DataFrame:
    """Texts in files named by their ids, some of them blank."""
    path, k = scratch_path(t.spark, "texts"), F.col("s_suppkey")
    objects.put_objects(t.supplier.select(F.concat(k, F.lit(".md")).alias("key"), F.when(k % 4 == 0, "  ").otherwise(F.concat("s_name", F.lit("\n"), k)).alias("body")), objects.FolderStore(path))
    return files.texts(t.spark, path)


@query(ORACLES["slim_catalogue"])
def slim_file(t: Tables) -> DataFrame:
    """The slim catalogue written, and only its columns read back."""
    path = scratch_path(t.spark, "slim")
    sinks.write_slim(slim_catalogue(t), path)
    return t.spark.read.parquet(path)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice / 1000, 3) AS score FROM orders")
def report_file(t: Tables) -> DataFrame:
    """Records of a run as JSON lines beside its results, read back."""
    path = scratch_path(t.spark, "report")
    sinks.write_report(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") / 1000, 3).alias("score")), path)
    return t.spark.read.schema("id long, status string, score double").json(path)


_ANCHOR = "CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 4, 3) WHEN 1 THEN replace(substr(p_name, 3, 6), ' ', '') WHEN 2 THEN substr(p_name, 5, 3) || 'zz' ELSE '' END"
_PLACED = "list_filter(range(1, length(line) + 1), lambda i: substr(line, CAST(i AS INTEGER), 1) <> ' ')"


def _sought(anchor: str) -> str:
    exact = f"nullif(strpos(substr(line, start + 1), {anchor}), 0) + start - 1"
    compact = f"nullif(strpos(substr(replace(line, ' ', ''), len(list_filter({_PLACED}, lambda i: i <= start)) + 1), replace({anchor}, ' ', '')), 0) + len(list_filter({_PLACED}, lambda i: i <= start))"
    return f"coalesce({exact}, {_PLACED}[CAST({compact} AS INTEGER)] - 1)"


@query(
    f"""WITH a AS (SELECT p_partkey AS id, p_type || ' ' || p_name AS line, {_ANCHOR} AS anchor, p_size % 3 AS start FROM part)
SELECT id, CAST(CASE WHEN anchor <> '' THEN coalesce({_sought("anchor")}, CASE WHEN length(replace(anchor, ' ', '')) > 3 THEN {_sought("substr(anchor, 1, 3)")} END) END AS INTEGER) AS place FROM a"""
)
def anchors(t: Tables) -> DataFrame:
    """Where anchors of a line begin: as they are, without blanks, or by their first characters."""
    line = F.concat("p_type", F.lit(" "), "p_name")
    return t.part.select(F.col("p_partkey").alias("id"), align.locate_anchor(line, F.expr(_ANCHOR), F.col("p_size") % 3).cast("int").alias("place"))
