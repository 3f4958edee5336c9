"""Names, search, audits and ingestion over the part, customer, orders and events tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.functions import text as tx
from lyrebird.operators import ingest, names, pages, reconcile, search
from lyrebird.plans.registry import Tables, query
from lyrebird.runtime import dealt
from lyrebird.sources import files

PREFIX = "P "
_RAW_SQL = """(SELECT p_partkey AS id, 'P ' || p_name || CASE p_partkey % 4 WHEN 0 THEN '/x:' WHEN 1 THEN '  . ' WHEN 2 THEN chr(9) || '?' ELSE ' ' END || CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' ...' ELSE '' END AS raw FROM part)"""
_CLEAN_SQL = r"""(SELECT id, raw, CASE WHEN c = '' THEN 'untitled' ELSE c END AS clean FROM (SELECT id, raw, regexp_replace(trim(regexp_replace(regexp_replace(CASE WHEN starts_with(raw, 'P ') THEN substr(raw, 3) ELSE raw END, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '\s+', ' ', 'g')), '[. ]+$', '') AS c FROM """ + _RAW_SQL + "))"
_NAMED_SQL = f"(SELECT id, raw, CASE WHEN count(*) OVER (PARTITION BY lower(clean)) > 1 THEN clean || '_' || id ELSE clean END AS name FROM {_CLEAN_SQL})"


def raw_titles(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, "/x:").when(k % 4 == 1, "  . ").when(k % 4 == 2, "\t?").otherwise(" ")
    raw = F.concat(F.lit(PREFIX), "p_name", tail, F.when(k % 3 == 0, F.upper("p_type")).otherwise(""), F.when(k % 5 == 0, " ...").otherwise(""))
    return dealt(t.part.select("p_partkey", "p_name", "p_type"), "p_partkey").select(k.alias("id"), raw.alias("raw"))


@query(f"SELECT id, clean AS name FROM {_CLEAN_SQL}")
def clean_names(t: Tables) -> DataFrame:
    return raw_titles(t).select("id", tx.clean_name(F.col("raw"), PREFIX).alias("name"))


@query(f"SELECT id, name FROM {_NAMED_SQL}")
def disambiguated_names(t: Tables) -> DataFrame:
    return names.disambiguate(raw_titles(t), "id", "raw", PREFIX).select("id", "name")


@query(f"SELECT lower(clean) AS name_lower, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM {_CLEAN_SQL} GROUP BY 1 HAVING count(*) > 1")
def name_collisions(t: Tables) -> DataFrame:
    found = names.collision_report(raw_titles(t), "id", "raw", PREFIX)
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query(f"SELECT id, name, id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48) AS has_text FROM {_NAMED_SQL}")
def slim_catalogue(t: Tables) -> DataFrame:
    with_text = t.lineitem.where("l_quantity >= 48").select(F.col("l_partkey").alias("id"))
    return names.slim_catalogue(raw_titles(t), with_text, "id", "raw", PREFIX)


@query("SELECT p_partkey AS id, CASE WHEN length(p_name || p_type || '.webp') <= 16 THEN p_name || p_type || '.webp' ELSE substr(p_name || p_type, 1, 16 - length('_' || p_partkey || '.webp')) || '_' || p_partkey || '.webp' END AS file FROM part")
def capped_file_names(t: Tables) -> DataFrame:
    name = F.concat("p_name", "p_type")
    return t.part.select(F.col("p_partkey").alias("id"), tx.capped_file_name(name, F.col("p_partkey"), F.lit(".webp"), 16).alias("file"))


@query(r"""WITH s AS (SELECT id, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '[\s_]+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS g FROM """ + _RAW_SQL + ") SELECT id, CASE WHEN g = '' THEN 'song' ELSE g END AS slug FROM s")
def slugs(t: Tables) -> DataFrame:
    return raw_titles(t).select("id", tx.slugify(F.col("raw")).alias("slug"))


@query(r"""SELECT doc_id, CASE WHEN g = '' THEN 'song' ELSE g END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\s_]+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS g FROM documents)""")
def document_slugs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("SELECT id, replace(url_encode(raw), '%2A', '*') AS encoded, replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM " + _RAW_SQL)
def encoded_titles(t: Tables) -> DataFrame:
    return raw_titles(t).select("id", tx.encode_uri(F.col("raw")).alias("encoded"), tx.xml_escape(F.col("raw")).alias("escaped"))


_SLUG_OF = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s_]+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT ((row_number() OVER (ORDER BY id) - 1) // 100) + 1 AS part, id, 'https://songs.example/song/' || id || '/' || {_SLUG_OF} AS loc FROM {_NAMED_SQL} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def sitemap_chunks(t: Tables) -> DataFrame:
    return names.sitemap(slim_catalogue(t), "https://songs.example", 100)


@query(f"SELECT part, 'https://songs.example/sitemaps/songs-' || part || '.xml' AS loc, count(*) AS n FROM (SELECT ((row_number() OVER (ORDER BY id) - 1) // 100) + 1 AS part FROM {_NAMED_SQL} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)) GROUP BY part")
def sitemap_index(t: Tables) -> DataFrame:
    return names.sitemap_index(sitemap_chunks(t), "https://songs.example")


@query(r"SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]|[^\P{Zs} ]')) AS odd FROM documents GROUP BY lang")
def character_audit(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(tx.odd_characters(F.col("text"))).alias("odd"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) = 'therwh.example.org' AS own FROM pages")
def host_filter(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.same_host(F.col("url"), "therwh.example.org").alias("own"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_custkey % 1000000 AS VARCHAR), 6, '0') END AS room, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END AS song, CASE WHEN o_orderkey % 3 = 1 THEN 'a-b' END AS slug FROM orders")
def routes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    room = F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0")
    path = F.when(k % 3 == 0, F.concat(F.lit("/"), room, F.lit("/"), k)).when(k % 3 == 1, F.concat(F.lit("/song/"), k, F.lit("/a-b"))).otherwise("/about")
    return t.orders.select(k.alias("id"), tx.route(path).alias("r")).select("id", "r.*")


def _keyed_parts(t: Tables, nfc: bool = False) -> DataFrame:
    named = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws("  ", "p_name", F.upper("p_type"), "p_brand").alias("name"))
    return search.with_search_key(named, "name", nfc)


_KEYED_SQL = r"(SELECT p_partkey AS id, p_name || '  ' || upper(p_type) || '  ' || p_brand AS name, trim(regexp_replace(lower(p_name || '  ' || upper(p_type) || '  ' || p_brand), '\s+', ' ', 'g')) AS k FROM part)"


@query(f"SELECT id, name FROM {_KEYED_SQL} WHERE contains(k, 'wid') AND contains(k, 'o') AND contains(k, '#1') ORDER BY id LIMIT 500")
def search_tokens(t: Tables) -> DataFrame:
    return search.search(_keyed_parts(t), "O  Wid #1").select("id", "name")


@query(f"SELECT id, nfc_normalize(k) AS search_key FROM {_KEYED_SQL}")
def search_keys(t: Tables) -> DataFrame:
    return _keyed_parts(t, nfc=True).select("id", "search_key")


@query(f"SELECT id, name FROM {_KEYED_SQL} WHERE contains(lower(name), 'widget  promo')")
def search_contiguous(t: Tables) -> DataFrame:
    return search.search_within(_keyed_parts(t), " Widget  PROMO ").select("id", "name")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'licen') AND contains(lower(text), 'apache')")
def search_documents(t: Tables) -> DataFrame:
    return t.documents.where(tx.has_all(F.lower("text"), "Apache licen the")).select("doc_id")


_RECENT_SQL = "(SELECT item, row_number() OVER (ORDER BY seen DESC, item) - 1 AS pos FROM (SELECT event_id % 200 + 1 AS item, max(event_id) AS seen FROM events WHERE user_id = 3 GROUP BY 1) ORDER BY seen DESC, item LIMIT 30)"


def _opens(t: Tables) -> DataFrame:
    return t.events.select("user_id", (F.col("event_id") % 200 + 1).alias("item"), F.col("event_id").alias("at"))


@query(f"SELECT p.p_partkey AS id, row_number() OVER (ORDER BY r.pos NULLS LAST, p.p_partkey) - 1 AS place FROM part p LEFT JOIN {_RECENT_SQL} r ON r.item = p.p_partkey")
def pinned_order(t: Tables) -> DataFrame:
    from lyrebird.operators.collections import recent_lists

    recents = recent_lists(_opens(t).where("user_id = 3")).select(F.col("item").alias("id"), "pos")
    return search.pinned(t.part.select(F.col("p_partkey").alias("id")), recents).select("id", "place")


@query("""WITH s AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, list_distinct(list_filter(string_split_regex(lower(p_name || '_' || p_type), '[\\s_-]+'), lambda x: length(x) >= 2)) AS w FROM part WHERE p_size <= 5),
n AS (SELECT count(*) AS c FROM s), tok AS (SELECT id, unnest(w) AS token FROM s),
sh AS (SELECT DISTINCT a.id, b.id AS other FROM tok a JOIN tok b ON a.token = b.token AND a.id <> b.id),
shr AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS r FROM sh),
ring AS (SELECT a.id, b.id AS other, 1000 + st.k AS r FROM s a CROSS JOIN n CROSS JOIN (SELECT unnest(range(1, 24)) AS k) st JOIN s b ON b.idx = (a.idx + st.k) % n.c WHERE st.k < n.c),
al AS (SELECT id, other, min(r) AS r FROM (SELECT * FROM shr WHERE r <= 12 UNION ALL SELECT * FROM ring) GROUP BY id, other)
SELECT id, CAST(rank AS INTEGER) AS rank, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY r) AS rank FROM al) WHERE rank <= 12""")
def related_items(t: Tables) -> DataFrame:
    """Related items of the parts with p_size <= 5 among each other.

    The filter plays the role of the reference's has-text condition: only songs with a text are candidates.
    The whole table is related by ``related_catalogue``.
    """
    return search.related(_titled_parts(t).where("p_size <= 5").select("id", "name"), 12)


@query()
def related_catalogue(t: Tables) -> DataFrame:
    """Related items of all parts; without SQL, as its self-join by tokens gets dear on the whole table."""
    return search.related(_titled_parts(t).select("id", "name"), 12)


def _titled_parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.concat_ws("_", "p_name", "p_type").alias("name"), "p_size")


_THREE_SQL = "(SELECT key, bool_or(s = 0) AS expected, bool_or(s = 1) AS disk, bool_or(s = 2) AS bucket FROM (SELECT c_custkey AS key, 0 AS s FROM customer UNION ALL SELECT o_custkey + 20, 1 FROM orders UNION ALL SELECT s_suppkey * 3, 2 FROM supplier) GROUP BY key)"


def _three(t: Tables) -> DataFrame:
    disk = t.orders.select((F.col("o_custkey") + 20).alias("key"))
    bucket = t.supplier.select((F.col("s_suppkey") * 3).alias("key"))
    return reconcile.reconcile(t.customer.select(F.col("c_custkey").alias("key")), "key", disk=disk, bucket=bucket)


@query(f"SELECT report, key FROM (SELECT key, unnest([CASE WHEN expected AND NOT disk THEN 'missing_disk' END, CASE WHEN expected AND NOT bucket THEN 'missing_bucket' END, CASE WHEN NOT expected AND disk THEN 'orphan_disk' END, CASE WHEN NOT expected AND bucket THEN 'orphan_bucket' END]) AS report FROM {_THREE_SQL}) WHERE report IS NOT NULL")
def reconcile_three_way(t: Tables) -> DataFrame:
    return reconcile.discrepancies(_three(t), "disk", "bucket")


@query(f"SELECT n_expected, missing_disk, orphan_disk, missing_bucket, orphan_bucket, missing_disk + orphan_disk + missing_bucket + orphan_bucket = 0 AS in_sync FROM (SELECT count(*) FILTER (WHERE expected) AS n_expected, count(*) FILTER (WHERE expected AND NOT disk) AS missing_disk, count(*) FILTER (WHERE NOT expected AND disk) AS orphan_disk, count(*) FILTER (WHERE expected AND NOT bucket) AS missing_bucket, count(*) FILTER (WHERE NOT expected AND bucket) AS orphan_bucket FROM {_THREE_SQL})")
def reconcile_summary(t: Tables) -> DataFrame:
    return reconcile.verdict(_three(t), "disk", "bucket")


@query("SELECT a.p_name || a.p_partkey AS wanted, upper(b.p_name) || b.p_partkey AS present, (a.p_name || a.p_partkey) = (upper(b.p_name) || b.p_partkey) AS exact FROM part a JOIN part b ON lower(a.p_name || a.p_partkey) = lower(upper(b.p_name) || b.p_partkey)")
def case_join(t: Tables) -> DataFrame:
    left = t.part.select(F.concat("p_name", "p_partkey").alias("a"))
    right = t.part.select(F.concat(F.upper("p_name"), "p_partkey").alias("b"))
    return reconcile.case_mismatches(left, right, "a", "b")


@query("SELECT o_orderkey AS key, o_orderkey % 13 AS size FROM orders WHERE o_orderkey % 11 > 8 OR o_orderkey % 13 <> o_orderkey % 7")
def upload_plan(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    local = t.orders.select(k.alias("key"), (k % 13).alias("size"))
    stored = t.orders.where(k % 11 <= 8).select(k.alias("key"), (k % 7).alias("size"))
    return ingest.upload_plan(local, stored)


def event_log(t: Tables) -> DataFrame:
    """The events as an append-only log of page fetches."""
    src = F.concat(F.lit("http://h.example/"), "event_type", F.when(F.col("event_id") % 3 == 0, ".PNG/").when(F.col("event_id") % 3 == 1, ".jpg").otherwise("/"))
    return t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 7 != 0, src).alias("src"), F.col("event_type").alias("status"))


_LOG_SQL = "(SELECT user_id AS id, event_id AS line_no, CASE WHEN event_id % 7 <> 0 THEN 'http://h.example/' || event_type || CASE event_id % 3 WHEN 0 THEN '.PNG/' WHEN 1 THEN '.jpg' ELSE '/' END END AS src, event_type AS status FROM events)"
_LAST_SQL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS r FROM {_LOG_SQL}) WHERE r = 1)"
_IMAGE_SQL = "coalesce(regexp_matches(lower(regexp_replace(src, '/+$', '')), '[^/]*\\.(png|jpg|jpeg|gif|webp)$'), false)"


@query(f"SELECT id, line_no, src, status FROM {_LAST_SQL}")
def compact_log(t: Tables) -> DataFrame:
    return ingest.last_write(event_log(t), "id", "line_no")


@query(f"SELECT id, line_no, src, status FROM {_LAST_SQL} WHERE id NOT IN (SELECT s_suppkey * 2 FROM supplier) AND {_IMAGE_SQL}")
def finalized_records(t: Tables) -> DataFrame:
    return ingest.finalize(event_log(t), t.supplier.select((F.col("s_suppkey") * 2).alias("id")))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def todo_any(t: Tables) -> DataFrame:
    return ingest.todo_any(t.customer.select(F.col("c_custkey").alias("id")), event_log(t))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 5 = 0)")
def todo_settled(t: Tables) -> DataFrame:
    """The fifth of the events with line_no % 5 = 0 plays the log, so that some customers stay unsettled."""
    return ingest.todo_settled(t.customer.select(F.col("c_custkey").alias("id")), event_log(t).where("line_no % 5 = 0"), ("purchase", "signup"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey >= 40 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0) ORDER BY c_custkey LIMIT 100")
def worklist(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("id"))
    return ingest.worklist(t.customer.select(F.col("c_custkey").alias("id")), done, start=40, limit=100)


@query("SELECT status, count(*) AS n FROM " + _LOG_SQL + " GROUP BY status")
def status_tally(t: Tables) -> DataFrame:
    return ingest.status_tally(event_log(t))


@query("SELECT DISTINCT id FROM (SELECT s_suppkey * 2 AS id FROM supplier UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def merged_blocklist(t: Tables) -> DataFrame:
    return ingest.merged_blocklists(t.supplier.select((F.col("s_suppkey") * 2).alias("id")), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


@query("SELECT coalesce(max(coalesce(o_orderkey, 0)), 0) AS largest FROM orders")
def largest_id(t: Tables) -> DataFrame:
    return ingest.largest_id(t.orders, "o_orderkey")


@query("""WITH h AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey >= 5 AND (o_custkey % 4 <> 0 OR o_orderkey % 9 = 0)),
g AS (SELECT id, id - coalesce(lag(id) OVER (ORDER BY id), 4) AS gap, coalesce(lag(id) OVER (ORDER BY id), 4) AS prev FROM h)
SELECT coalesce((SELECT min(prev) FROM g WHERE gap > 4), (SELECT max(id) FROM h), 4) AS last""")
def probe_end(t: Tables) -> DataFrame:
    return ingest.probe_end(t.orders.where("o_custkey % 4 <> 0 or o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("id")), 5, 4)


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN page_id % 7 = 0 THEN '404' WHEN NOT contains(html, '<article>') THEN 'no_div' WHEN page_id % 5 = 0 THEN 'no_img' WHEN NOT coalesce(regexp_matches(lower(regexp_replace(src, '/+$', '')), '[^/]*\\.(png|jpg|jpeg|gif|webp)$'), false) THEN 'placeholder' ELSE 'ok' END AS status FROM (SELECT *, url || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '' END AS src FROM pages)) GROUP BY status")
def page_status(t: Tables) -> DataFrame:
    src = F.when(F.col("page_id") % 5 != 0, F.concat("url", F.when(F.col("page_id") % 2 == 0, ".png").otherwise("")))
    status = ingest.page_status(F.when(F.col("page_id") % 7 == 0, 404).otherwise(200), F.contains(F.col("html"), F.lit("<article>")), src)
    return ingest.status_tally(t.pages.select(status.alias("status")))


@query("SELECT report, key FROM (SELECT o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.webp' WHEN 1 THEN '.WebP' WHEN 2 THEN '.png' ELSE '' END AS key, 'stray_disk' AS report FROM orders UNION ALL SELECT s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.webp.tmp' ELSE '.webp' END, 'stray_bucket' FROM supplier) WHERE NOT regexp_matches(lower(key), '[^.].*\\.webp$')")
def stray_files(t: Tables) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    disk = t.orders.select(F.concat(k, F.when(k % 4 == 0, ".webp").when(k % 4 == 1, ".WebP").when(k % 4 == 2, ".png").otherwise("")).alias("key"))
    bucket = t.supplier.select(F.concat(s, F.when(s % 3 == 0, ".webp.tmp").otherwise(".webp")).alias("key"))
    return reconcile.strays(disk=files.by_suffix(disk)[1], bucket=files.by_suffix(bucket)[1])


@query("SELECT o_orderkey || '.png' AS name FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0")
def unconverted_files(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    present = t.orders.where((k % 3 == 0) | (k % 7 == 0)).select(F.concat(k, F.when(k % 3 == 0, ".webp").otherwise(".JPEG")).alias("name"))
    return reconcile.skip_existing(t.orders.select(F.concat(k, F.lit(".png")).alias("name")), present)


@query("SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.gz' WHEN 4 THEN '.png' ELSE '.webp' END AS suffix FROM events")
def url_suffixes(t: Tables) -> DataFrame:
    e = F.col("event_id")
    tail = F.when(e % 6 == 0, "/a.b/").when(e % 6 == 1, "/x.JPG?y=.gif").when(e % 6 == 2, "?q=a.gif").when(e % 6 == 3, "/a.tar.gz#z.bmp").when(e % 6 == 4, "/.gif").otherwise("/n.webp;v=1.2")
    return t.events.select(e.alias("id"), tx.url_suffix(F.concat(F.lit("https://h.example"), tail)).alias("suffix"))


@query("SELECT coalesce(a.key, b.key) AS key, coalesce(a.content, b.content) AS content FROM (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 <> 0 THEN 'local' END AS content FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT o_orderkey AS key, o_orderstatus AS content FROM orders WHERE o_orderkey % 3 = 0) b ON a.key = b.key")
def local_or_remote(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    local = t.orders.where(k % 2 == 0).select(k.alias("key"), F.when(k % 5 != 0, "local").alias("content"))
    return files.local_or_remote(local, t.orders.where(k % 3 == 0).select(k.alias("key"), F.col("o_orderstatus").alias("content")))


@query(f"SELECT 'https://songs.example/song/' || id || '/' || {_SLUG_OF} AS loc FROM {_NAMED_SQL} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def sitemap_locations(t: Tables) -> DataFrame:
    """The sitemap's files written out under an index, and read back from it; locations on another host go."""
    chunks = sitemap_chunks(t)
    one = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit("\n</loc></url>"))
    parts = chunks.groupBy("part").agg(F.array_join(F.collect_list(one(F.col("loc"))), "").alias("v")).select(F.concat(F.lit("https://songs.example/"), "part", F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "v", F.lit("<url><loc>https://other.example/x</loc></url></urlset>")).alias("value"))
    index = parts.agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), "").alias("v")).select(F.lit("https://songs.example/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex xmlns='x'>"), "v", F.lit("<loc>https://songs.example/sitemap.xml</loc></sitemapindex>")).alias("value"))
    return pages.sitemap_urls(parts.union(index), "https://songs.example/sitemap.xml", "songs.example")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/a.png' WHEN 1 THEN url WHEN 2 THEN 'plain.gif' END AS src, CASE page_id % 4 WHEN 0 THEN 'an \"alt\"' WHEN 1 THEN '' END AS alt FROM pages")
def block_images(t: Tables) -> DataFrame:
    """The first image of a block, with attributes in double quotes, single quotes or none; images outside don't count."""
    k = F.col("page_id")
    tag = F.when(k % 4 == 0, F.concat(F.lit("<IMG class=x ALT='an \"alt\"' src = \""), "url", F.lit("/a.png\"/>"))).when(k % 4 == 1, F.concat(F.lit("<img data-src='no' src='"), "url", F.lit("' alt=\"\">"))).when(k % 4 == 2, "<img src=plain.gif>").otherwise("")
    html = F.concat(F.lit("<img src='before.png'><div id=\"block\">"), tag, F.lit("<img src='second.png'></div><img src='after.png'>"))
    html = F.when(k % 4 == 3, F.replace(html, F.lit("<img src='second.png'>"), F.lit(""))).otherwise(html)
    found = pages.first_image(pages.region(html, '<div id="block">', ("</div>",)))
    return t.pages.select("page_id", found.alias("i")).select("page_id", F.col("i.src").alias("src"), F.col("i.alt").alias("alt"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0) ORDER BY c_custkey LIMIT 25 OFFSET 10")
def worklist_page(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("id"))
    return ingest.worklist(t.customer.select(F.col("c_custkey").alias("id")), done, skip=10, limit=25)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (3, 7, 11, 100000)")
def worklist_named(t: Tables) -> DataFrame:
    done = t.orders.select(F.col("o_custkey").alias("id"))
    return ingest.worklist(t.customer.select(F.col("c_custkey").alias("id")), done, ids=[3, 7, 11, 100000])


@query(f"SELECT lower(clean) AS name_lower, count(*) OVER (PARTITION BY lower(clean)) AS n, id FROM {_CLEAN_SQL} QUALIFY n > 1")
def name_collision_rows(t: Tables) -> DataFrame:
    return names.collisions(raw_titles(t), "id", "raw", PREFIX)


@query("SELECT l_orderkey AS list, l_linenumber AS pos, p_partkey AS id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey + 60")
def listed_songs(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") + 60).alias("id"))
    return search.in_list_order(items, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("list", "pos", "id", "name")


@query("""WITH b AS (SELECT o_custkey AS id, 0 AS k, o_orderkey AS item FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)
SELECT id, item FROM (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY k, item) AS r FROM b) WHERE r = 1""")
def own_or_others(t: Tables) -> DataFrame:
    lists = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("item"))
    return search.first_found(lists.where("item % 3 = 0"), lists.where("item % 3 <> 0"), "id", ["item"])


@query(f"SELECT id, '{{\"@context\":\"https://schema.org\",\"@type\":\"MusicComposition\",\"name\":\"' || name || '\",\"url\":\"https://songs.example/song/' || id || '/' || {_SLUG_OF} || '\",\"composer\":\"' || id % 7 || '\",\"musicalKey\":\"C\"}}' AS json FROM {_NAMED_SQL}")
def song_cards(t: Tables) -> DataFrame:
    named = names.disambiguate(raw_titles(t), "id", "raw", PREFIX).select("id", "name", (F.col("id") % 7).cast("string").alias("artist"), F.lit("C").alias("song_key"))
    return names.song_card(named, "https://songs.example")


_LINK = f"'https://songs.example/song/' || id || '/' || {_SLUG_OF}"
_GRAPH = f"""'{{"@context":"https://schema.org","@graph":[{{"@type":"MusicComposition","name":"' || name || '","url":"' || {_LINK} || '"}},{{"@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"Home","item":"https://songs.example/"}},{{"@type":"ListItem","position":2,"name":"' || name || '","item":"' || {_LINK} || '"}}]}}' || CASE WHEN id % 2 = 0 THEN ',{{"@type":"FAQPage","mainEntity":[{{"@type":"Question","name":"' || name || '","acceptedAnswer":{{"@type":"Answer","text":"C, G7"}}}}]}}' ELSE '' END || ']}}'"""


@query(f"SELECT id, {_GRAPH} AS json FROM {_NAMED_SQL}")
def song_graphs(t: Tables) -> DataFrame:
    named = names.disambiguate(raw_titles(t), "id", "raw", PREFIX)
    symbols = F.when(F.col("id") % 2 == 0, F.array(F.lit("C"), F.lit("G7"))).otherwise(F.array().cast("array<string>"))
    return names.song_graph(named.select("id", "name", symbols.alias("symbols")), "https://songs.example")


@query(f"SELECT report, count(*) AS n, '{{\"report\":\"' || report || '\",\"n\":' || count(*) || ',\"keys\":[' || array_to_string(list_slice(list(key ORDER BY key), 1, 50), ',') || ']}}' AS json FROM (SELECT key, unnest([CASE WHEN expected AND NOT disk THEN 'missing_disk' END, CASE WHEN expected AND NOT bucket THEN 'missing_bucket' END, CASE WHEN NOT expected AND disk THEN 'orphan_disk' END, CASE WHEN NOT expected AND bucket THEN 'orphan_bucket' END]) AS report FROM {_THREE_SQL}) WHERE report IS NOT NULL GROUP BY report")
def reconcile_report(t: Tables) -> DataFrame:
    return reconcile.report_json(reconcile.discrepancies(_three(t), "disk", "bucket"))
