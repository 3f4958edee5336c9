"""Shared rooms as event tables and streams: state, ownership, edges, and calmed-down updates.

The batch forms take whole tables. The streaming forms take streams with a ``timestamp`` column ``at`` and
give the same rows for the same events; what comes later than the watermark allows is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.operators.sweeps import chain, following
from lyrebird.runtime import spread_join, stage_table
from lyrebird.sources.upserts import upserting
from lyrebird.streaming.ordered import in_order


def room_register(events: DataFrame, room: str = "room", at: str = "at") -> DataFrame:
    """The last event of each room."""
    fields = [c for c in events.columns if c != room]
    return events.groupBy(room).agg(F.max_by(F.struct(*fields), F.struct(at, *[F.col(c) for c in fields if c != at])).alias("r")).select(room, "r.*")


def edges(events: DataFrame, room: str = "room", order: str = "seq", me: str | None = None, mounted_at: int | None = None, catalogue: DataFrame | None = None) -> DataFrame:
    """Adds ``action``: what each event of a room makes a listener do: open, close, or null.

    events: song, picked_by, picked_at, viewing. A missing ``viewing`` is true, a missing time 0. Every event
    becomes the previous one for the next, whether or not it is acted on; one's own picks, events without a
    song, songs that the ``catalogue`` (column ``song``) lacks and picks from before ``mounted_at`` are not.
    """
    if catalogue is not None:
        there = catalogue.select("song").distinct().withColumn("_known", F.lit(True))
        events = events.join(there, "song", "left").select(*events.columns, "_known")
    by = Window.partitionBy(room).orderBy(order)
    viewing, picked = F.coalesce("viewing", F.lit(True)), F.coalesce("picked_at", F.lit(0))
    was_song = F.lag("song").over(by)
    was_viewing, was_picked = F.coalesce(F.lag(viewing).over(by), F.lit(True)), F.coalesce(F.lag(picked).over(by), F.lit(0))
    same = F.col("song").eqNullSafe(was_song)
    closed = same & was_viewing & ~viewing
    again = ~same | (picked > was_picked) | (same & ~was_viewing & viewing)
    heard = F.col("song").isNotNull()
    if catalogue is not None:
        heard &= F.col("_known").isNotNull()
    if me is not None:
        heard &= ~F.col("picked_by").eqNullSafe(me)
    if mounted_at is not None:
        heard &= ~((picked > 0) & (picked < mounted_at))
    return events.withColumn("action", F.when(heard & closed, "close").when(heard & again & viewing, "open")).drop("_known")


def edge_stream(events: DataFrame, room: str = "room", order: str = "seq", me: str | None = None, mounted_at: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(room, seq, action) as ``edges`` has it, an event once the watermark has passed its time ``at``.

    Events are applied by time, equal ones by ``order``, so one that comes in a later batch still takes its
    place; what is later than ``late`` is left out. The state of a room is its last event, and ends after 30
    days without any. The known songs' events are those of a stream-static semi join.
    """

    def step(state: tuple, event: tuple) -> tuple[tuple, tuple]:
        (song, viewing, picked), (_, seq, now, by, at, view) = state, event
        at, view = at or 0, view is None or view
        heard = now is not None and (me is None or by != me) and not (mounted_at is not None and 0 < at < mounted_at)
        closed = now == song and viewing and not view
        again = now != song or at > picked or (not viewing and view)
        return (now, view, at), (seq, "close" if heard and closed else "open" if heard and again and view else None)

    fields = ["song", "picked_by", "picked_at", "viewing"]
    return in_order(events, room, order, fields, late, "seq long, action string", "song long, viewing boolean, picked long", (None, True, 0), step)


def notified(action: Column, permitted: Column, auto_open: Column, hidden: Column) -> Column:
    return (action == "open") & permitted & (~auto_open | hidden)


def ownership(events: DataFrame, room: str = "room", order: str = "seq") -> DataFrame:
    """Adds ``owner`` after each event (claim, release or disconnect, by client).

    A claim takes a room that nobody owns; only the owner's release or disconnect frees it. So of all claims
    those count that a room's first one leads to: from a claim to the client's next release, and on to the
    first claim after that. Sweeps find both, a chain the claims that count, and each event looks back to the
    last of these; a room with any share of all events goes over many tasks. ``order`` is a bigint, each once
    in a room. Events without a room are left out, and a null client claims nothing.
    """
    events = events.where(F.col(room).isNotNull())
    own = events.select(room, order, "op", "client")
    frees = F.when(F.col("op").isin("release", "disconnect"), F.col(order))
    claims = following(own, [room, "client"], [order], frees, "freed").where("op = 'claim' and client is not null").select(room, order, "client", "freed")
    claims = stage_table(claims, "claims")
    at, none = F.col(order), F.lit(None).cast("long")
    places = claims.select(room, at.alias("at"), F.lit(1).alias("kind"), none.alias("of")).unionByName(claims.where("freed is not null").select(room, F.col("freed").alias("at"), F.lit(0).alias("kind"), at.alias("of")))
    then = following(places, [room], ["at", "kind"], F.when(F.col("kind") == 1, F.col("at")), "then").where("kind = 0").select(room, F.col("of").alias(order), "then")
    counted = chain(claims.join(then, [room, order], "left"), room, order, "then")
    marks = own.select(room, order).join(counted.select(room, order, F.col(order).alias("claim")), [room, order], "left")
    back = following(marks, [room], [order], F.col("claim"), "before", backward=True).select(room, order, F.coalesce("claim", "before").alias("claim"))
    back = stage_table(back, "claimed")
    held = back.groupBy(room, "claim").agg(F.count("*").alias("n"))
    names = claims.withColumnRenamed(order, "claim").join(held, [room, "claim"])
    met = spread_join(back, names, [room, "claim"], "n", "left")
    owner = F.when(F.col("freed").isNull() | (F.col(order) < F.col("freed")), F.col("client")).alias("owner")
    return events.join(met.select(room, order, owner), [room, order], "left").select(*events.columns, "owner")


def _next_owner(owner: str | None, op: str, client: str) -> str | None:
    if op == "claim" and owner is None:
        return client
    return None if op in ("release", "disconnect") and owner == client else owner


def debounced(deltas: DataFrame, key: str, at: str, fields: list[str], silence: str = "400 milliseconds") -> DataFrame:
    """(key, start, end, fields...): deltas merged until there is silence; of each field the last value that is there.

    A delta right at the end of the silence begins a new session.
    """
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(at))).alias(f) for f in fields]
    grouped = deltas.groupBy(F.col(key), F.session_window(F.col(at), silence).alias("w")).agg(*last)
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *fields)


def throttled(events: DataFrame, at: str, every: str = "500 milliseconds") -> DataFrame:
    """(start, n): how many events each window of the clock holds."""
    return events.groupBy(F.window(at, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def throttled_from_first(events: DataFrame, key: str, at: str, every: int = 500_000) -> DataFrame:
    """(key, start_us, n): windows of ``every`` microseconds, each opened by the first event after the one before ended, and how many events it holds.

    An event's successor is the first one at least ``every`` later, found by a sweep over events and the times
    that they wait for; the windows are the chain from a key's first event. One key may have all events. Events
    of one time open a window together; those without a time or key are left out.
    """
    times = stage_table(events.where(F.col(at).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key), F.unix_micros(F.col(at)).alias("us")).agg(F.count("*").alias("m")), "times")
    us = F.col("us")
    places = times.select(key, us.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("of")).unionByName(times.select(key, (us + every).alias("at"), F.lit(0).alias("kind"), us.alias("of")))
    then = following(places, [key], ["at", "kind"], F.when(F.col("kind") == 1, F.col("at")), "then").where("kind = 0").select(key, F.col("of").alias("us"), "then")
    opened = chain(then, key, "us", "then")
    marks = times.join(opened.withColumn("start_us", us), [key, "us"], "left")
    inside = following(marks, [key], ["us"], F.col("start_us"), "before", backward=True)
    return inside.groupBy(key, F.coalesce("start_us", "before").alias("start_us")).agg(F.sum("m").alias("n"))


def without_echoes(updates: DataFrame, key: str, print_col: str, order: str) -> DataFrame:
    """Updates that change their key's fingerprint."""
    by = Window.partitionBy(key).orderBy(order)
    return updates.withColumn("_was", F.lag(print_col).over(by)).where(~F.col(print_col).eqNullSafe(F.col("_was"))).drop("_was")


def debounced_stream(deltas: DataFrame, key: str, at: str, fields: list[str], silence: str = "400 milliseconds", late: str = "10 minutes") -> DataFrame:
    return debounced(deltas.withWatermark(at, late), key, at, fields, silence)


def unique_stream(updates: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Updates whose keys haven't come before, within the time that late ones may take."""
    return updates.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def ownership_stream(events: DataFrame, room: str = "room", order: str = "seq", late: str = "10 minutes", silence: int | None = None) -> DataFrame:
    """(room, seq, at_us, owner) as ``ownership`` has it, an event once the watermark has passed its time ``at``.

    Events are applied by time, equal ones by ``order``, so one that comes in a later batch still takes its
    place; what is later than ``late`` is left out. With ``silence`` (microseconds) a room is freed whose owner
    sends nothing for so long: a row with a null seq says so. A room's state ends after 30 days without events.
    """

    def step(state: tuple, event: tuple) -> tuple[tuple, tuple]:
        (owner, seen), (at, seq, op, client) = state, event
        owner = _next_owner(owner, op, client)
        return (owner, at if owner is not None and owner == client else seen), (seq, at, owner)

    quiet = silent = None
    if silence is not None:
        quiet = lambda state: None if state[0] is None else state[1] + silence
        silent = lambda state: ((None, 0), (None, state[1] + silence, None))
    return in_order(events, room, order, ["op", "client"], late, "seq long, at_us long, owner string", "owner string, seen long", (None, 0), step, quiet, silent)


def tombstone_stream(changes: DataFrame, owner: str = "owner", order: str = "seq", late: str = "10 minutes", keep: int = 180 * 86_400_000_000) -> DataFrame:
    """(owner, seq, list, live): whether each change of a list (op edit or delete, with the time it was made, ``made`` in
    microseconds) leaves it alive: an edit counts if it was made after the list's deletion.

    Deletions are kept for ``keep`` microseconds after they were made, and then forgotten with their state; the
    newest deletion of a list counts. Changes are applied as they pass the watermark, by time ``at`` and order.
    """

    def step(state: tuple, event: tuple) -> tuple[tuple, tuple]:
        at, seq, name, op, made = event
        known = {k: v for k, v in (state[0] or {}).items() if v + keep > at}
        if op == "delete":
            known[name] = max(made, known.get(name, made))
        return (known,), (seq, name, made > known[name] if name in known else op != "delete")

    def quiet(state: tuple) -> int | None:
        return min(state[0].values()) + keep if state[0] else None

    def silent(state: tuple) -> tuple[tuple, tuple]:
        gone = min(state[0].values())
        name = min(k for k, v in state[0].items() if v == gone)
        return ({k: v for k, v in state[0].items() if k != name},), (None, name, None)

    return in_order(changes, owner, order, ["list", "op", "made"], late, "seq long, list string, live boolean", "deleted map<string,bigint>", ({},), step, quiet, silent, forget=keep)


def register_into(stream: DataFrame, path: str, room: str = "room", at: str = "at"):
    """A writer that keeps the last event of each room as a table under ``path`` (``upserts.read_upserted``)."""
    return upserting(stream, path, room, lambda both: room_register(both, room, at).select(*both.columns))


def merged(deltas: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """(key, at, fields...): one row for each key, with the last value of each field that is there, and the last time."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(at))).alias(f) for f in fields]
    return deltas.groupBy(key).agg(F.max(at).alias(at), *last)


def merged_into(stream: DataFrame, path: str, key: str, at: str, fields: list[str]):
    """A writer that merges deltas, field by field, into a table of one row for each key under ``path``.

    A field that a delta lacks keeps its value. Each field has a time of its own (field_at), so a delta that
    comes late wins for the fields that nothing newer has set, and loses for the others.
    """
    timed, step = with_field_times(stream, key, at, fields)
    return upserting(timed, path, key, step)


def with_field_times(deltas: DataFrame, key: str, at: str, fields: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The deltas with a time for each field that they have, and the step that merges such rows by key."""
    timed = deltas.select(key, at, *[c for f in fields for c in (F.col(f), F.when(F.col(f).isNotNull(), F.col(at)).alias(f"{f}_at"))])

    def step(both: DataFrame) -> DataFrame:
        return both.groupBy(key).agg(F.max(at).alias(at), *[c for f in fields for c in (F.max_by(f, f"{f}_at").alias(f), F.max(f"{f}_at").alias(f"{f}_at"))])

    return timed, step
