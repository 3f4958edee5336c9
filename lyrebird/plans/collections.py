"""Collections and rooms over the events, orders and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.operators import collections as col
from lyrebird.plans.registry import ORACLES, Tables, query
from lyrebird.runtime import scratch_path
from lyrebird.sources import upserts
from lyrebird.streaming import rooms

_OPENS = "(SELECT user_id, event_id % 200 + 1 AS item, event_id AS seen FROM events)"
_RECENT = f"(SELECT user_id, item, pos FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY max(seen) DESC, item) AS pos FROM {_OPENS} GROUP BY user_id, item) WHERE pos <= 30)"
_FAVOURITES = f"(SELECT user_id, item FROM {_OPENS} WHERE seen % 3 = 0 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


def _opens(t: Tables) -> DataFrame:
    return t.events.select("user_id", (F.col("event_id") % 200 + 1).alias("item"), F.col("event_id").alias("at"))


@query(f"SELECT user_id, CAST(pos AS INTEGER) AS pos, item FROM {_RECENT}")
def recent_lists(t: Tables) -> DataFrame:
    return col.recent_lists(_opens(t))


@query(f"SELECT user_id, item FROM {_FAVOURITES}")
def favourites_toggle(t: Tables) -> DataFrame:
    """Every third event plays a press of the favourite button; the others are opens only."""
    return col.toggled(_opens(t).where("at % 3 = 0"))


@query(f"SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT item FROM {_RECENT} WHERE user_id < 9) OR p_partkey IN (SELECT item FROM {_FAVOURITES} WHERE user_id > 12)")
def prefetch_set(t: Tables) -> DataFrame:
    """Users under 9 play those whose recent items are fetched ahead, users over 12 those whose favourites are."""
    return col.prefetch_set(t.part.select(F.col("p_partkey").alias("id")), recent_lists(t).where("user_id < 9").select("item"), favourites_toggle(t).where("user_id > 12").select("item"))


def _user_data(t: Tables, side: int) -> DataFrame:
    """Each customer's lists on one of two devices."""
    k = F.col("c_custkey")
    number = lambda i: ((k * (i + 3) + side * i) % 7 + 1).cast("long")
    lists = t.customer.where(k % (5 + side) != 0).select(
        k.alias("user_id"), F.transform(F.array(*[F.lit(i) for i in range(4)]), number).alias("favorites"), F.transform(F.array(*[F.lit(i) for i in range(6)]), lambda i: number(i + 2)).alias("latest"),
        F.when(k % 3 == side, F.lpad(k.cast("string"), 6, "0")).otherwise("").alias("room_code"),
    )
    return lists.withColumn("favorites", F.array_distinct("favorites"))


def _user_sql(side: int) -> str:
    number = lambda n, s: f"list_transform(range(0, {n}), lambda i: (c_custkey * (i + {3 + s}) + {side} * (i + {s})) % 7 + 1)"
    return f"(SELECT c_custkey AS user_id, {number(4, 0)} AS f, {number(6, 2)} AS l, CASE WHEN c_custkey % 3 = {side} THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE '' END AS room FROM customer WHERE c_custkey % {5 + side} <> 0)"


def _ordered_distinct(expr: str) -> str:
    return f"list_transform(list_filter(list_zip({expr}, range(1, len({expr}) + 1)), lambda p: list_position({expr}, p[1]) = p[2]), lambda p: p[1])"


_BOTH = f"(SELECT coalesce(a.user_id, b.user_id) AS user_id, list_concat(coalesce(a.f, []), coalesce(b.f, [])) AS f, list_concat(coalesce(a.l, []), coalesce(b.l, [])) AS l, coalesce(nullif(a.room, ''), b.room) AS room_code FROM {_user_sql(0)} a FULL JOIN {_user_sql(1)} b ON a.user_id = b.user_id)"


@query(f"SELECT user_id, array_to_string({_ordered_distinct('f')}, ',') AS favorites, array_to_string({_ordered_distinct('l')}[1:5], ',') AS latest, room_code FROM {_BOTH}")
def user_merge(t: Tables) -> DataFrame:
    merged = col.merge_user_data(_user_data(t, 0), _user_data(t, 1)).withColumn("latest", F.slice("latest", 1, 5))
    joined = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return merged.select("user_id", joined("favorites"), joined("latest"), "room_code")


NOW = 400 * col.DAY_MS


def _playlists(t: Tables, side: int) -> DataFrame:
    k = F.col("o_orderkey")
    kept = k % 3 != 0 if side else k % 4 != 0
    changed = (k % 50 + F.when(k % 5 == 0, side).when(k % 5 == 1, -side).otherwise(0)) * col.DAY_MS * 8
    return t.orders.where(kept).select(
        (F.col("o_custkey") % 100).alias("owner"), k.alias("ord"), F.concat(F.lit("pl"), k).alias("id"), F.concat(F.lit("side" + str(side)), "o_orderstatus").alias("name"),
        F.array(k % 9, k % 11).alias("song_ids"), F.lit(0).cast("long").alias("created_at"), changed.cast("long").alias("updated_at"),
    )


def _tombstones(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.where(k % 7 == 0).select((F.col("o_custkey") % 100).alias("owner"), F.concat(F.lit("pl"), k).alias("id"), ((k % 50 + k % 3 - 1) * col.DAY_MS * 8).cast("long").alias("deleted_at"))


def _side_sql(side: int) -> str:
    kept = "o_orderkey % 3 <> 0" if side else "o_orderkey % 4 <> 0"
    return f"SELECT o_custkey % 100 AS owner, {side} AS side, o_orderkey AS ord, 'pl' || o_orderkey AS id, 'side{side}' || o_orderstatus AS name, (o_orderkey % 50 + CASE o_orderkey % 5 WHEN 0 THEN {side} WHEN 1 THEN -{side} ELSE 0 END) * 691200000 AS updated_at FROM orders WHERE {kept}"


_DEAD = "SELECT o_custkey % 100 AS owner, 'pl' || o_orderkey AS id, (o_orderkey % 50 + o_orderkey % 3 - 1) * 691200000 AS deleted_at FROM orders WHERE o_orderkey % 7 = 0"
_NEWEST = f"(SELECT *, row_number() OVER (PARTITION BY owner, id ORDER BY updated_at DESC, side, ord) AS v, min(side * 1000000000 + ord) OVER (PARTITION BY owner, id) AS place FROM ({_side_sql(0)} UNION ALL {_side_sql(1)}))"


@query(f"SELECT n.owner, CAST(row_number() OVER (PARTITION BY n.owner ORDER BY place) - 1 AS INTEGER) AS ord, n.id, n.name, n.updated_at FROM {_NEWEST} n LEFT JOIN ({_DEAD}) d ON n.owner = d.owner AND n.id = d.id WHERE v = 1 AND (d.deleted_at IS NULL OR d.deleted_at < n.updated_at)")
def playlist_merge(t: Tables) -> DataFrame:
    live, _ = col.merge_playlists(_playlists(t, 0), _playlists(t, 1), _tombstones(t), NOW)
    return live.select("owner", "ord", "id", "name", "updated_at")


@query(f"SELECT d.owner, d.id, d.deleted_at FROM ({_DEAD}) d LEFT JOIN (SELECT * FROM {_NEWEST} WHERE v = 1) n ON n.owner = d.owner AND n.id = d.id WHERE (n.id IS NULL OR d.deleted_at >= n.updated_at) AND d.deleted_at >= {NOW - 180 * col.DAY_MS}")
def tombstone_merge(t: Tables) -> DataFrame:
    _, kept = col.merge_playlists(_playlists(t, 0), _playlists(t, 1), _tombstones(t), NOW)
    return kept


@query(f"SELECT owner, sha256(string_agg(part, ';' ORDER BY part)) AS print FROM (SELECT owner, 'p|' || id || ':' || name || ':' || updated_at || ':' || (ord % 9) || ',' || (ord % 11) AS part FROM ({_side_sql(0)}) UNION ALL SELECT owner, 't|' || id || ':' || deleted_at FROM ({_DEAD})) GROUP BY owner")
def playlist_fingerprint(t: Tables) -> DataFrame:
    return col.fingerprint(_playlists(t, 0), _tombstones(t))


_EDITS = "(SELECT user_id AS owner, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'rename' WHEN event_id % 5 = 0 THEN 'remove' WHEN event_id % 7 = 0 THEN 'move' ELSE 'add' END AS op, 'n' || event_id AS name, event_id % 6 AS song, event_id % 3 AS place, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED {_EDITS},
f(owner, n, name, songs, updated_at) AS (SELECT DISTINCT owner, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM e
UNION ALL SELECT e.owner, e.n, CASE WHEN op = 'rename' THEN e.name ELSE f.name END,
CASE WHEN op = 'add' AND NOT list_contains(songs, song) THEN list_append(songs, song) WHEN op = 'remove' THEN list_filter(songs, lambda x: x <> song)
WHEN op = 'move' AND list_contains(songs, song) THEN list_concat(list_filter(songs, lambda x: x <> song)[1:place], [song], list_filter(songs, lambda x: x <> song)[place + 1:]) ELSE songs END,
CASE WHEN op <> 'add' OR NOT list_contains(songs, song) THEN seq ELSE updated_at END
FROM f JOIN e ON e.owner = f.owner AND e.n = f.n + 1)
SELECT owner, name, array_to_string(songs, ',') AS song_ids, updated_at, false AS deleted FROM f WHERE (owner, n) IN (SELECT (owner, max(n)) FROM e GROUP BY owner)""")
def playlist_fold(t: Tables) -> DataFrame:
    """Edits folded in order."""
    e = F.col("event_id")
    op = F.when(e % 11 == 0, "rename").when(e % 5 == 0, "remove").when(e % 7 == 0, "move").otherwise("add")
    edits = t.events.select(F.col("user_id").alias("owner"), e.alias("seq"), e.alias("at"), op.alias("op"), F.concat(F.lit("n"), e).alias("name"), (e % 6).alias("song"), (e % 3).cast("int").alias("to"))
    return col.folded_playlists(edits, ["owner"]).withColumn("song_ids", F.array_join(F.transform("song_ids", lambda s: s.cast("string")), ","))


@query("""WITH p AS (SELECT c_nationkey AS room, 'c' || (c_custkey % 4) AS client, c_custkey AS ord, c_custkey AS id, c_mktsegment AS name FROM customer),
r AS (SELECT p.*, CASE WHEN client = 'c' || (room % 5) THEN 0 WHEN client = 'c2' THEN 1 ELSE 2 END AS k FROM p)
SELECT room, CAST(row_number() OVER (PARTITION BY room ORDER BY k, client, ord) AS INTEGER) AS place, client, id, name, name || CASE WHEN row_number() OVER (PARTITION BY room, name ORDER BY k, client, ord) > 1 THEN ' (' || row_number() OVER (PARTITION BY room, name ORDER BY k, client, ord) || ')' ELSE '' END AS shown, client = 'c2' AS is_mine FROM r""")
def room_view(t: Tables) -> DataFrame:
    lists = t.customer.select(F.col("c_nationkey").alias("room"), F.concat(F.lit("c"), F.col("c_custkey") % 4).alias("client"), F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    owners = t.nation.select(F.col("n_nationkey").alias("room"), F.concat(F.lit("c"), F.col("n_nationkey") % 5).alias("owner"))
    return col.room_view(lists, owners, "c2")


@query("SELECT item, seen FROM (SELECT item, max(seen) AS seen FROM " + _OPENS + " GROUP BY item) WHERE seen >= (SELECT max(event_id) FROM events) - 150 ORDER BY seen DESC, item LIMIT 60")
def lru_keep(t: Tables) -> DataFrame:
    return col.kept_entries(_opens(t).withColumnRenamed("at", "seen"), "item", "seen", cap=60, max_age=150)


def room_events(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(
        (F.col("user_id") % 20).alias("room"), e.alias("seq"), F.when(e % 13 != 0, e % 3).alias("song"), F.concat(F.lit("c"), e % 4).alias("picked_by"), (e - e % 2).alias("picked_at"), F.when(e % 5 != 0, e % 7 < 4).alias("viewing"),
    )


_ROOM = "(SELECT user_id % 20 AS room, event_id AS seq, CASE WHEN event_id % 13 <> 0 THEN event_id % 3 END AS song, 'c' || (event_id % 4) AS picked_by, event_id - event_id % 2 AS picked_at, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 < 4 END AS viewing FROM events)"


@query(f"SELECT room, seq, song, picked_by FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY seq DESC) AS r FROM {_ROOM}) WHERE r = 1")
def room_register(t: Tables) -> DataFrame:
    return rooms.room_register(room_events(t), "room", "seq").select("room", "seq", "song", "picked_by")


@query(f"""WITH w AS (SELECT *, coalesce(viewing, true) AS v, lag(song) OVER o AS ps, coalesce(lag(coalesce(viewing, true)) OVER o, true) AS pv, coalesce(lag(picked_at) OVER o, 0) AS pp FROM {_ROOM} WINDOW o AS (PARTITION BY room ORDER BY seq)),
h AS (SELECT *, song IS NOT DISTINCT FROM ps AS same, song IS NOT NULL AND picked_by <> 'c1' AND NOT (picked_at > 0 AND picked_at < 20) AS heard FROM w)
SELECT room, seq, CASE WHEN heard AND same AND pv AND NOT v THEN 'close' WHEN heard AND (NOT same OR picked_at > pp OR (same AND NOT pv AND v)) AND v THEN 'open' END AS action FROM h""")
def edge_events(t: Tables) -> DataFrame:
    return rooms.edges(room_events(t), me="c1", mounted_at=20).select("room", "seq", "action")


@query(f"""WITH w AS (SELECT *, coalesce(viewing, true) AS v, lag(song) OVER o AS ps, coalesce(lag(coalesce(viewing, true)) OVER o, true) AS pv, coalesce(lag(picked_at) OVER o, 0) AS pp FROM {_ROOM} WINDOW o AS (PARTITION BY room ORDER BY seq)),
h AS (SELECT *, song IS NOT DISTINCT FROM ps AS same, song IS NOT NULL AND song IN (SELECT p_partkey FROM part WHERE p_partkey <> 2) AS heard FROM w)
SELECT room, seq, CASE WHEN heard AND same AND pv AND NOT v THEN 'close' WHEN heard AND (NOT same OR picked_at > pp OR (same AND NOT pv AND v)) AND v THEN 'open' END AS action FROM h""")
def edge_events_known(t: Tables) -> DataFrame:
    """Only songs of the catalogue are acted on; the others still count as what was there before."""
    return rooms.edges(room_events(t), catalogue=t.part.where("p_partkey != 2").select(F.col("p_partkey").alias("song"))).select("room", "seq", "action")


@query(f"""WITH w AS (SELECT *, coalesce(viewing, true) AS v, lag(song) OVER o AS ps, coalesce(lag(coalesce(viewing, true)) OVER o, true) AS pv, coalesce(lag(picked_at) OVER o, 0) AS pp FROM {_ROOM} WINDOW o AS (PARTITION BY room ORDER BY seq)),
a AS (SELECT room, seq, song IS NOT NULL AND NOT (song IS NOT DISTINCT FROM ps AND pv AND NOT v) AND (song IS DISTINCT FROM ps OR picked_at > pp OR (NOT pv AND v)) AND v AS opens FROM w)
SELECT room, seq FROM a WHERE opens AND seq % 3 <> 0 AND (seq % 2 <> 0 OR seq % 5 = 0)""")
def notified_events(t: Tables) -> DataFrame:
    found = rooms.edges(room_events(t))
    seq = F.col("seq")
    return found.where(rooms.notified(F.col("action"), seq % 3 != 0, seq % 2 == 0, seq % 5 == 0)).select("room", "seq")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS a, CASE WHEN event_id % 2 = 0 THEN value END AS b, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS fresh FROM events))
SELECT user_id, count(*) AS n FROM (SELECT user_id, s, arg_max(a, ts) FILTER (WHERE a IS NOT NULL) AS a FROM g GROUP BY user_id, s) GROUP BY user_id""")
def debounced_sessions(t: Tables) -> DataFrame:
    return _sessions(t).groupBy("user_id").agg(F.count("*").alias("n"))


def _sessions(t: Tables) -> DataFrame:
    deltas = t.events.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("b"))
    return rooms.debounced(deltas, "user_id", "at", ["a", "b"], "2 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN event_id % 3 <> 0 THEN event_type END AS a, CASE WHEN event_id % 2 = 0 THEN value END AS b, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS fresh FROM events))
SELECT user_id, epoch_us(min(ts)) AS start_us, arg_max(a, ts) FILTER (WHERE a IS NOT NULL) AS a, arg_max(b, ts) FILTER (WHERE b IS NOT NULL) AS b FROM g GROUP BY user_id, s""")
def debounced_fields(t: Tables) -> DataFrame:
    return _sessions(t).select("user_id", F.unix_micros("start").alias("start_us"), "a", "b")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n FROM events GROUP BY 1")
def throttled_events(t: Tables) -> DataFrame:
    windows = rooms.throttled(t.events.select(F.col("ts").cast("timestamp").alias("at")), "at", "1 day")
    return windows.select(F.unix_micros("start").alias("start_us"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id % 3 AS room, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events),
r(room, s) AS (SELECT room, min(us) FROM e GROUP BY room UNION ALL SELECT r.room, (SELECT min(us) FROM e WHERE e.room = r.room AND us >= r.s + 14400000000) FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.room = r.room AND us >= r.s + 14400000000))
SELECT r.room, r.s AS start_us, count(*) AS n FROM r JOIN e ON e.room = r.room AND e.us >= r.s AND e.us < r.s + 14400000000 GROUP BY r.room, r.s""")
def throttled_rooms(t: Tables) -> DataFrame:
    """Windows of four hours, each opened by the first event after the one before."""
    return rooms.throttled_from_first(t.events.select((F.col("user_id") % 3).alias("room"), F.col("ts").cast("timestamp").alias("at")), "room", "at", 14_400_000_000)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE event_type IS DISTINCT FROM was")
def without_echoes(t: Tables) -> DataFrame:
    return rooms.without_echoes(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id").select("user_id", "event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id % 20 AS room, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'disconnect' ELSE 'claim' END AS op, 'c' || (event_id % 3) AS client, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n FROM events),
f(room, n, seq, owner) AS (SELECT room, n, seq, CASE WHEN op = 'claim' THEN client END FROM e WHERE n = 1 UNION ALL
SELECT e.room, e.n, e.seq, CASE WHEN op = 'claim' AND f.owner IS NULL THEN client WHEN op <> 'claim' AND f.owner = client THEN NULL ELSE f.owner END FROM f JOIN e ON e.room = f.room AND e.n = f.n + 1)
SELECT room, seq, owner FROM f""")
def ownership(t: Tables) -> DataFrame:
    return rooms.ownership(ownership_events(t)).select("room", "seq", "owner")


def ownership_events(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select((F.col("user_id") % 20).alias("room"), e.alias("seq"), F.when(e % 4 == 0, "release").when(e % 4 == 1, "disconnect").otherwise("claim").alias("op"), F.concat(F.lit("c"), e % 3).alias("client"))


def _in_batches(df: DataFrame, n: int = 3) -> list[DataFrame]:
    """The events in batches that don't follow their order."""
    return [df.where((F.col("seq") * 7 + 3) % n == k) for k in range(n)]


@query(ORACLES["room_register"])
def register_upserts(t: Tables) -> DataFrame:
    """Each room's last event, kept in a table that batches rewrite bucket by bucket."""
    path = scratch_path(t.spark, "register")
    for k, batch in enumerate(_in_batches(room_events(t).select("room", "seq", "song", "picked_by"))):
        upserts.upsert(batch, path, "room", lambda both: rooms.room_register(both, "room", "seq"), k, 8)
    return upserts.read_upserted(t.spark, path)


@query("SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 <> 0) AS kind, arg_max(value, event_id) FILTER (WHERE event_id % 2 = 0) AS value FROM events GROUP BY user_id")
def field_upserts(t: Tables) -> DataFrame:
    """Deltas that come out of order, merged field by field into a table."""
    path, e = scratch_path(t.spark, "users"), F.col("event_id")
    deltas = t.events.select("user_id", e.alias("seq"), F.when(e % 3 != 0, F.col("event_type")).alias("kind"), F.when(e % 2 == 0, F.col("value")).alias("value"))
    timed, step = rooms.with_field_times(deltas, "user_id", "seq", ["kind", "value"])
    for k, batch in enumerate(_in_batches(timed)):
        upserts.upsert(batch, path, "user_id", step, k, 16)
    return upserts.read_upserted(t.spark, path).select("user_id", "seq", "kind", "value")


_UNTRUSTED = """concat('[{"id":"a', c_custkey, '","name":"', c_mktsegment, '","songIds":[', c_custkey, ',"x",', c_nationkey, '],"createdAt":', c_custkey % 9, '}, 7, ', CASE WHEN c_custkey % 3 = 0 THEN '{"songIds":null,"updatedAt":5}' ELSE '"text"' END, ']')"""


@query(
    """SELECT c_custkey AS owner, 'a' || c_custkey AS id, c_mktsegment AS name, c_custkey || ' ' || c_nationkey AS songs, c_custkey % 9 AS created_at, c_custkey % 9 AS updated_at FROM customer
UNION ALL SELECT c_custkey, 'list-1', 'Playlist', '', 99, 5 FROM customer WHERE c_custkey % 3 = 0"""
)
def normalised_lists(t: Tables) -> DataFrame:
    """Playlists from untrusted JSON."""
    found = col.normalised_playlists(t.customer.select(F.col("c_custkey").alias("owner"), F.expr(_UNTRUSTED).alias("j")), "j", ["owner"], 99)
    return found.select("owner", "id", "name", F.array_join(F.transform("song_ids", lambda x: x.cast("string")), " ").alias("songs"), "created_at", "updated_at")


@query(
    """SELECT c_custkey AS owner, 'a' AS id, CAST(c_nationkey AS BIGINT) AS deleted_at FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, 'k' || c_custkey, CAST(c_custkey * 1000 AS BIGINT) FROM customer WHERE c_custkey % 5 <> 0"""
)
def sane_tombstones(t: Tables) -> DataFrame:
    """Deletions from untrusted JSON: entries of objects whose values are numbers."""
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"a":'), "c_nationkey", F.lit(',"b":"x","k'), k, F.lit('":'), k, F.lit('000,"n":null,"o":{"p":1}}'))
    raw = F.when(k % 10 == 0, F.lit("[1,2]")).when(k % 5 == 0, F.lit('{"a":')).otherwise(body)
    return col.sanitised_tombstones(t.customer.select(k.alias("owner"), raw.alias("j")), "j", ["owner"])
