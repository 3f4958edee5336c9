"""Streams whose events come late and out of order give the batch forms' rows."""

import datetime as dt

from lyrebird.streaming import rooms

START = dt.datetime(2024, 1, 1)
MINUTE = 60_000_000


def arriving(spark, tmp_path, batches, kind):
    """A stream that takes one file after another."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    import os
    import shutil

    os.makedirs(f"{tmp_path}/all")
    for k in range(len(batches)):
        part = next(p for p in os.listdir(f"{tmp_path}/in/{k:03d}") if p.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/in/{k:03d}/{part}", f"{tmp_path}/all/{k:03d}.parquet")
        os.utime(f"{tmp_path}/all/{k:03d}.parquet", (1_700_000_000 + k * 10,) * 2)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")


def result(spark, stream, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


KIND = "room long, seq long, at timestamp, op string, client string"


def scrambled(n):
    """Events of two rooms, five minutes apart at most from their order; some come two files late."""
    rows = [(k % 2, k, START + dt.timedelta(seconds=20 * k), ("claim", "claim", "release", "disconnect", "claim")[k * 7 % 5], f"c{k * 5 % 3}") for k in range(n)]
    batches = [[] for _ in range(6)]
    for k, r in enumerate(rows):
        batches[min(5, k * 4 // n + (2 if k % 9 == 4 else 1 if k % 4 == 1 else 0))].append(r)
    far = [(9, n, START + dt.timedelta(days=1), "claim", "x")]
    return rows, [b[::-1] for b in batches] + [far, [(9, n + 1, START + dt.timedelta(days=2), "claim", "x")]]


def test_late_events_take_their_place(spark, tmp_path):
    rows, batches = scrambled(80)
    got = result(spark, rooms.ownership_stream(arriving(spark, tmp_path, batches, KIND), late="1 hour"), "placed")
    want = {(r.room, r.seq): r.owner for r in rooms.ownership(spark.createDataFrame(rows, KIND)).collect()}
    assert {(r.room, r.seq): r.owner for r in got if r.room != 9} == want and len(set(want.values())) > 2


def test_what_is_too_late_is_left_out(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [[(1, 1, at(0), "claim", "a")], [(1, 9, at(60), "release", "a")], [(1, 10, at(200), "claim", "b")], [(1, 2, at(1), "claim", "late")], [(1, 11, at(400), "claim", "c")], [(1, 12, at(800), "claim", "c")]]
    got = result(spark, rooms.ownership_stream(arriving(spark, tmp_path, batches, KIND), late="5 minutes"), "late")
    assert [(r.seq, r.owner) for r in sorted(got, key=lambda r: r.seq)][:3] == [(1, "a"), (9, None), (10, "b")]


def test_a_silent_owner_frees_the_room(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [
        [(1, 1, at(0), "claim", "a"), (1, 2, at(1), "claim", "b")], [(1, 4, at(9), "claim", "a")], [(1, 3, at(5), "claim", "b")], [(1, 5, at(21), "claim", "b")],
        [(2, 1, at(30), "claim", "z")], [(2, 2, at(100), "release", "z")], [(2, 3, at(200), "claim", "z")],
    ]
    got = result(spark, rooms.ownership_stream(arriving(spark, tmp_path, batches, KIND), late="6 minutes", silence=10 * MINUTE), "silent")
    us = lambda m: int(at(m).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    ones = sorted(((r.at_us, r.seq or 0, r.owner) for r in got if r.room == 1))
    assert ones == [(us(0), 1, "a"), (us(1), 2, "a"), (us(5), 3, "a"), (us(9), 4, "a"), (us(19), 0, None), (us(21), 5, "b"), (us(31), 0, None)]
    assert (us(40), None) in {(r.at_us, r.owner) for r in got if r.room == 2 and r.seq is None}


def test_late_edges(spark, tmp_path):
    rows, batches = scrambled(60)
    kind = "room long, seq long, at timestamp, song int, picked_by string, picked_at long, viewing boolean"
    fill = lambda r: (*r[:3], None if r[1] % 13 == 0 else r[1] // 8 % 3, r[4], r[1] - r[1] % 2, None if r[1] % 5 == 0 else r[1] % 7 < 4)
    got = result(spark, rooms.edge_stream(arriving(spark, tmp_path, [[fill(r) for r in b] for b in batches], kind), me="c1", mounted_at=20, late="1 hour"), "late_edges")
    want = {(r.room, r.seq): r.action for r in rooms.edges(spark.createDataFrame([fill(r) for r in rows], kind), me="c1", mounted_at=20).collect()}
    assert {(r.room, r.seq): r.action for r in got if r.room != 9} == want and {"open", "close", None} == set(want.values())


def test_deletions_are_kept_for_a_time(spark, tmp_path):
    day = 86_400_000_000
    at = lambda d: START + dt.timedelta(days=d)
    us = lambda d: int(at(d).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    kind = "owner string, seq long, at timestamp, list string, op string, made long"
    batches = [
        [("a", 1, at(0), "x", "edit", us(0)), ("a", 2, at(1), "x", "delete", us(1))], [("a", 4, at(3), "x", "edit", us(2))], [("a", 3, at(2), "x", "edit", us(0))],
        [("a", 5, at(4), "x", "delete", us(0))], [("a", 6, at(20), "x", "edit", us(0))], [("b", 7, at(60), "x", "edit", us(60))], [("b", 8, at(90), "x", "edit", us(60))],
    ]
    got = result(spark, rooms.tombstone_stream(arriving(spark, tmp_path, batches, kind), late="2 days", keep=10 * day), "dead")
    assert {r.seq: r.live for r in got if r.seq} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True}
    assert [(r.owner, r.list, r.live) for r in got if r.seq is None] == [("a", "x", None)]


def test_state_ends(spark, tmp_path):
    """A room that is forgotten starts anew."""
    at = lambda d: START + dt.timedelta(days=d)
    batches = [[(1, 1, at(0), "claim", "a")], [(2, 2, at(40), "claim", "x")], [(1, 3, at(41), "claim", "b")], [(2, 4, at(80), "claim", "x")], [(2, 5, at(81), "claim", "x")]]
    got = result(spark, rooms.ownership_stream(arriving(spark, tmp_path, batches, KIND), late="1 hour"), "forgotten")
    assert {r.seq: r.owner for r in got if r.room == 1} == {1: "a", 3: "b"}
