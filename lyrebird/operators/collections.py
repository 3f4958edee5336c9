"""What users gather: recents, favourites, playlists, and merging these between devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: How long a deletion is remembered.
TOMBSTONE_DAYS = 180
PLAYLIST = "struct<id:string,name:string,song_ids:array<bigint>,created_at:bigint,updated_at:bigint>"


def recent_lists(opens: DataFrame, user: str = "user_id", item: str = "item", at: str = "at", cap: int = 30) -> DataFrame:
    """(user, pos, item): each user's last opened items, newest first, each once. Opens are reduced to one row an item first."""
    last = opens.groupBy(user, item).agg(F.max(at).alias("at"))
    pos = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("at"), item))
    return last.withColumn("pos", pos).where(F.col("pos") <= cap).select(user, "pos", item)


def toggled(toggles: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    """(user, item) pairs that have been toggled an odd number of times."""
    return toggles.groupBy(user, item).agg((F.count("*") % 2).alias("odd")).where("odd = 1").select(user, item)


def prefetch_set(catalogue: DataFrame, *lists: DataFrame, item: str = "item") -> DataFrame:
    """The catalogue's ids that any of the lists has."""
    wanted = lists[0].select(item)
    for more in lists[1:]:
        wanted = wanted.union(more.select(item))
    return catalogue.join(wanted.distinct().withColumnRenamed(item, "id"), "id", "left_semi")


def merged_recents(local: Column, remote: Column, cap: int = 30) -> Column:
    return F.slice(F.array_distinct(F.concat(local, remote)), 1, cap)


def merged_favourites(local: Column, remote: Column) -> Column:
    return F.array_union(local, remote)


def merge_user_data(local: DataFrame, remote: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, favorites, latest, room_code): local first; the remote room counts only if there is no local one."""
    none = F.array().cast("array<bigint>")
    l, r = local.alias("l"), remote.alias("r")
    both = l.join(r, user, "full")
    pick = lambda c: (F.coalesce(F.col(f"l.{c}"), none), F.coalesce(F.col(f"r.{c}"), none))
    room = F.coalesce(F.nullif(F.col("l.room_code"), F.lit("")), F.col("r.room_code"))
    return both.select(user, merged_favourites(*pick("favorites")).alias("favorites"), merged_recents(*pick("latest")).alias("latest"), room.alias("room_code"))


def sanitised_tombstones(df: DataFrame, json_col: str, id_cols: list[str]) -> DataFrame:
    """(id_cols..., id, deleted_at) from untrusted JSON: only entries of an object whose values are numbers count."""
    held = F.try_parse_json(F.col(json_col)).try_cast("map<string,variant>")
    entries = df.select(*id_cols, F.explode(held).alias("id", "v"))
    number = F.regexp_like(F.schema_of_variant("v"), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return entries.where(number).select(*id_cols, "id", F.col("v").cast("double").alias("deleted_at")).where(F.abs("deleted_at") < float("inf")).withColumn("deleted_at", F.col("deleted_at").cast("long"))


def merge_tombstones(*parts: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, id, deleted_at): the latest deletion of each id."""
    both = parts[0].select(owner, "id", "deleted_at")
    for more in parts[1:]:
        both = both.union(more.select(owner, "id", "deleted_at"))
    return both.groupBy(owner, "id").agg(F.max("deleted_at").alias("deleted_at"))


def merge_playlists(local: DataFrame, remote: DataFrame, tombstones: DataFrame, now: int, owner: str = "owner") -> tuple[DataFrame, DataFrame]:
    """(playlists, tombstones): of each id the strictly newest version, local on ties, unless deleted since.

    Playlists are (owner, ord, id, name, song_ids, created_at, updated_at); the result's ``ord`` is the order
    of first appearance, local lists first. A deletion at or after the newest version removes it; an older one
    is dropped, as the list lives again. Deletions older than 180 days before ``now`` go.
    """
    fields = ["name", "song_ids", "created_at", "updated_at"]
    both = local.select(owner, F.lit(0).alias("side"), "ord", "id", *fields).union(remote.select(owner, F.lit(1).alias("side"), "ord", "id", *fields))
    newest = both.groupBy(owner, "id").agg(
        F.min(F.struct("side", "ord")).alias("place"),
        F.max_by(F.struct(*fields), F.struct("updated_at", (-F.col("side")).alias("s"), (-F.col("ord")).alias("o"))).alias("v"),
    )
    dead = merge_tombstones(tombstones, owner=owner)
    met = newest.join(dead, [owner, "id"], "full")
    gone = F.col("deleted_at").isNotNull() & (F.col("v").isNull() | (F.col("deleted_at") >= F.col("v.updated_at")))
    place = F.row_number().over(Window.partitionBy(owner).orderBy("place")) - 1
    live = met.where(F.col("v").isNotNull() & ~gone).select(owner, place.alias("ord"), "id", *[F.col(f"v.{f}").alias(f) for f in fields])
    kept = met.where(gone & (F.col("deleted_at") >= now - TOMBSTONE_DAYS * DAY_MS)).select(owner, "id", "deleted_at")
    return live, kept


def fingerprint(playlists: DataFrame, tombstones: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, print): the same for the same playlists and deletions, in whatever order they come."""
    lists = F.concat_ws(":", "id", "name", F.col("updated_at").cast("string"), F.array_join(F.transform("song_ids", lambda s: s.cast("string")), ","))
    a = playlists.select(owner, F.concat(F.lit("p|"), lists).alias("part"))
    b = tombstones.select(owner, F.concat(F.lit("t|"), F.concat_ws(":", "id", F.col("deleted_at").cast("string"))).alias("part"))
    joined = F.array_join(F.array_sort(F.collect_list("part")), ";")
    return a.union(b).groupBy(owner).agg(F.sha2(joined, 256).alias("print"))


def normalised_playlists(df: DataFrame, json_col: str, id_cols: list[str], as_of: int) -> DataFrame:
    """Playlists from untrusted JSON, one row each: what is no object goes, and so do ids that are no numbers.

    Missing ids and names get defaults by place, times fall back on one another and then on ``as_of``.
    """
    text = F.col(json_col)
    listed = F.coalesce(F.from_json(text, "array<string>"), F.map_values(F.from_json(text, "map<string,string>")), F.array().cast("array<string>"))
    objects = df.select(*id_cols, F.posexplode(F.filter(listed, lambda p: F.startswith(F.trim(p), F.lit("{")))).alias("ord", "body"))
    one = F.from_json("body", "id string, name string, songIds array<string>, createdAt string, updatedAt string")
    rows = objects.withColumn("p", one)
    number = lambda c: F.when(F.rlike(c, F.lit(r"^-?[0-9]+$")), c.try_cast("bigint"))
    created, updated = number(F.col("p.createdAt")), number(F.col("p.updatedAt"))
    songs = F.filter(F.transform(F.coalesce(F.col("p.songIds"), F.array().cast("array<string>")), number), lambda s: s.isNotNull())
    return rows.select(
        *id_cols, "ord", F.coalesce("p.id", F.concat(F.lit("list-"), F.col("ord").cast("string"))).alias("id"), F.coalesce("p.name", F.lit("Playlist")).alias("name"), songs.alias("song_ids"),
        F.coalesce(created, F.lit(as_of)).alias("created_at"), F.coalesce(updated, created, F.lit(as_of)).alias("updated_at"),
    )


def folded_playlists(events: DataFrame, key: list[str]) -> DataFrame:
    """(key..., name, song_ids, updated_at, deleted): edits of playlists applied in their order.

    events: key columns, seq, at, op (create, rename, add, remove, move, delete), name, song, to. Adding a
    song that is there changes nothing; removing marks the list as updated even if the song isn't there.
    """
    edits = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "op", "name", "song", "to"))).alias("e"))
    none = F.lit(None)
    start = F.struct(none.cast("string").alias("name"), F.array().cast("array<bigint>").alias("song_ids"), none.cast("bigint").alias("updated_at"), F.lit(False).alias("deleted"))

    def apply(s: Column, e: Column) -> Column:
        has = F.array_contains(s["song_ids"], e["song"])
        without = F.filter(s["song_ids"], lambda x: x != e["song"])
        moved = F.concat(F.slice(without, F.lit(1), e["to"]), F.array(e["song"]), F.slice(without, e["to"] + 1, F.size(without) + 1))
        songs = F.when((e["op"] == "add") & ~has, F.array_append(s["song_ids"], e["song"])).when(e["op"] == "remove", without).when((e["op"] == "move") & has, moved).otherwise(s["song_ids"])
        changed = e["op"].isin("create", "rename", "remove", "move", "delete") | ((e["op"] == "add") & ~has)
        return F.struct(
            F.when(e["op"].isin("create", "rename"), e["name"]).otherwise(s["name"]).alias("name"), songs.alias("song_ids"),
            F.when(changed, e["at"]).otherwise(s["updated_at"]).alias("updated_at"), (s["deleted"] | (e["op"] == "delete")).alias("deleted"),
        )

    return edits.select(*key, F.aggregate("e", start, apply).alias("s")).select(*key, "s.*")


def room_view(playlists: DataFrame, owners: DataFrame, me: str) -> DataFrame:
    """(room, ord, client, id, name, shown, is_mine): the owner's lists first, then one's own, then by client.

    playlists: room, client, ord, id, name; owners: room, owner. Names that repeat in a room get `` (n)``.
    """
    from lyrebird.operators.names import suffixed_duplicates

    met = playlists.join(owners, "room", "left")
    rank = F.when(F.col("client").eqNullSafe(F.col("owner")), 0).when(F.col("client") == me, 1).otherwise(2)
    ranked = met.withColumn("_rank", rank)
    shown = suffixed_duplicates(ranked, ["room"], ["_rank", "client", "ord"], "name")
    place = F.row_number().over(Window.partitionBy("room").orderBy("_rank", "client", "ord"))
    return shown.select("room", place.alias("place"), "client", "id", "name", "shown", (F.col("client") == me).alias("is_mine"))


def kept_entries(uses: DataFrame, key: str, at: str, now_col: str | None = None, cap: int = 5000, max_age: int | None = None) -> DataFrame:
    """(key, at): cache entries that stay: the ``cap`` last used ones, none older than ``max_age`` before the last use of all."""
    last = uses.groupBy(key).agg(F.max(at).alias(at))
    if max_age is not None:
        newest = uses.agg(F.max(at).alias("_now"))
        last = last.join(F.broadcast(newest)).where(F.col(at) >= F.col("_now") - max_age).drop("_now")
    return last.orderBy(F.desc(at), key).limit(cap)
