import json
import os

from pyspark.sql import functions as F

from lyrebird.sources import files, objects, sinks, upserts
from lyrebird.streaming import rooms

SF = "/root/testdata/sf0.001"


def test_log_round_trip(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = spark.createDataFrame([(2, "b", None, "404"), (1, "a", "x", None)], files.SCRAPE_LOG)
    sinks.append_log(rows, path)
    sinks.append_log(rows.limit(1), path)
    (tmp_path / "log" / "part-bad.json").write_text('\nnot json\n{"id": 7, "status": 404}\n')
    got = files.json_lines(spark, path)
    assert sorted((r.id, r.status) for r in got.collect()) == [(1, None), (2, "404"), (2, "404"), (7, "404")]


def test_log_is_replayed_in_the_order_of_appends(spark, tmp_path):
    """Files of unlike sizes, packed by Spark the largest first, and plain files written before and after."""
    from lyrebird.operators import ingest

    path = f"{tmp_path}/log"
    row = lambda i, n, tag: (i, f"{tag}{n}", None, None)
    for n, size in enumerate((5, 4000, 30, 900)):
        rows = [row(i % 10, n, "a") for i in range(size)] + [row(0, n, "last")]
        sinks.append_log(spark.createDataFrame(rows, files.SCRAPE_LOG).coalesce(1 if n % 2 else 3), path)
    got = {r.id: r.src for r in ingest.last_write(files.json_lines(spark, path), "id", "line_no").collect()}
    assert got == {0: "last3", **{i: "a3" for i in range(1, 10)}}
    plain = tmp_path / "plain"
    plain.mkdir()
    import os

    for n, (name, size) in enumerate((("z.json", 2000), ("a.json", 3), ("m.json", 500))):
        (plain / name).write_text("".join(json.dumps({"id": i % 3, "src": f"{n}.{i}"}) + "\n" for i in range(size)))
        os.utime(plain / name, (1_700_000_000 + n, 1_700_000_000 + n))
    got = {r.id: r.src for r in ingest.last_write(files.json_lines(spark, str(plain)), "id", "line_no").collect()}
    assert got == {0: "2.498", 1: "2.499", 2: "2.497"}


def test_arrays_lists_and_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 3, "src": "s", "alt": "t"}, {"id": 1}]))
    assert files.json_array(spark, f"{tmp_path}/a.json").count() == 2
    (tmp_path / "block.json").write_text("[1, 5]")
    assert [r.id for r in files.blocklist(spark, f"{tmp_path}/block.json").collect()] == [1, 5]
    (tmp_path / "bad.json").write_text("oops")
    assert files.blocklist(spark, f"{tmp_path}/bad.json").count() == 0
    md = tmp_path / "md"
    md.mkdir()
    (md / "12.md").write_text("hello")
    (md / "13.md").write_text("  \n")
    (md / "x.md").write_text("no id")
    listed = files.listing(spark, str(md))
    assert sorted((r.key, r["size"]) for r in listed.collect()) == [("12.md", 5), ("13.md", 3), ("x.md", 5)]
    assert sorted(r.id for r in files.ids_with_text(listed).collect()) == [12, 13]
    assert {r.id: r.text for r in files.texts(spark, str(md)).where("id is not null").collect()} == {12: "hello", 13: None}
    (tmp_path / "env").write_text("# c\nA='x'\nB=1=2\nA=y\n\n")
    assert {r.key: r.value for r in files.settings(spark, f"{tmp_path}/env").collect()} == {"A": "x", "B": "1=2"}


def test_sinks(spark, tmp_path):
    rows = spark.range(25).select((F.lit(24) - F.col("id")).alias("id"))
    sinks.write_compacted(rows, f"{tmp_path}/c")
    written = [json.loads(line)["id"] for p in sorted((tmp_path / "c").glob("part-*")) for line in p.read_text().splitlines()]
    assert written == list(range(25))
    chunks = sinks.chunked(rows, "id", 10)
    assert sorted((r.id, r.chunk) for r in chunks.collect()) == [(i, i // 10) for i in range(25)]
    sinks.write_chunks(chunks.withColumnRenamed("chunk", "part"), f"{tmp_path}/p")
    assert {r.part: r["count"] for r in spark.read.json(f"{tmp_path}/p").groupBy("part").count().collect()} == {0: 10, 1: 10, 2: 5}
    sinks.write_slim(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 25


def test_rejected_rows(spark, tmp_path):
    outcomes = spark.createDataFrame([("a.png", None), ("b.png", "TimeoutError: slow"), ("c.png", None)], "name string, error string")
    assert tuple(sinks.write_rejected(outcomes, f"{tmp_path}/r").first()) == (2, 1)
    assert [tuple(r) for r in spark.read.option("sep", "\t").csv(f"{tmp_path}/r").collect()] == [("b.png", "TimeoutError: slow")]
    sinks.write_report(outcomes, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    kept, strays = files.by_suffix(spark.createDataFrame([("a.webp",), ("b.WEBP",), (".webp",), ("c.png",), ("d",)], "key string"))
    assert sorted(r.key for r in kept.collect()) == ["a.webp", "b.WEBP"] and strays.count() == 3


def events(spark, tmp_path):
    e = F.col("event_id")
    rows = spark.read.parquet(f"{SF}/events.parquet").select(
        (F.col("user_id") % 5).alias("room"), e.alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(e % 4 == 0, "release").when(e % 4 == 1, "disconnect").otherwise("claim").alias("op"), F.concat(F.lit("c"), e % 3).alias("client"),
    )
    rows.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{tmp_path}/in")
    return rows, spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_ownership_stream(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    run(rooms.ownership_stream(stream), "owners")
    got = {(r.room, r.seq): r.owner for r in spark.table("owners").collect()}
    want = {(r.room, r.seq): r.owner for r in rooms.ownership(batch.withColumn("seq", F.unix_micros("at") * 1000 + F.col("seq") % 1000)).collect()}
    want = {(r.room, r.seq): want[r.room, r.key] for r in batch.withColumn("key", F.unix_micros("at") * 1000 + F.col("seq") % 1000).collect()}
    # the last ones wait for the watermark
    assert got.items() <= want.items() and len(got) > 0.95 * len(want)


def test_debounced_stream_closes_what_is_past(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    run(rooms.debounced_stream(stream, "room", "at", ["client"], "2 hours"), "calm")
    got = {(r.room, r.start): (r.end, r.client) for r in spark.table("calm").collect()}
    want = {(r.room, r.start): (r.end, r.client) for r in rooms.debounced(batch, "room", "at", ["client"], "2 hours").collect()}
    assert got and got.items() <= want.items() and len(got) > len(want) - 10


def test_unique_stream_and_register(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    run(rooms.unique_stream(stream, ["seq"], "at"), "uniq")
    assert spark.table("uniq").count() == batch.count()
    q = rooms.register_into(stream, f"{tmp_path}/reg", "room", "seq").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.room: r.seq for r in upserts.read_upserted(spark, f"{tmp_path}/reg").collect()}
    assert got == {r.room: r.seq for r in rooms.room_register(batch, "room", "seq").collect()}


def test_edge_stream(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    e = F.col("seq")
    as_rooms = lambda df: df.select("room", "seq", "at", F.when(e % 13 != 0, e % 3).alias("song"), F.col("client").alias("picked_by"), (e - e % 2).alias("picked_at"), F.when(e % 5 != 0, e % 7 < 4).alias("viewing"))
    run(rooms.edge_stream(as_rooms(stream), me="c1", mounted_at=20), "edges")
    got = {(r.room, r.seq): r.action for r in spark.table("edges").collect()}
    want = {(r.room, r.seq): r.action for r in rooms.edges(as_rooms(batch).withColumn("key", F.unix_micros("at") * 1000 + e % 1000), order="key", me="c1", mounted_at=20).collect()}
    assert got.items() <= want.items() and len(got) > 0.95 * len(want) and {"open", "close", None} == set(got.values())


def test_deltas_are_merged_into_a_table(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    fields = lambda df: df.select("room", "seq", F.when(F.col("seq") % 3 == 0, F.col("op")).alias("op"), F.when(F.col("seq") % 2 == 0, F.col("client")).alias("client"))
    for _ in range(2):  # the second run finds nothing new
        q = rooms.merged_into(fields(stream), f"{tmp_path}/user", "room", "seq", ["op", "client"]).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert len(list((tmp_path / "user" / "_versions").glob("*.json"))) <= 2
    got = sorted(map(tuple, upserts.read_upserted(spark, f"{tmp_path}/user").select("room", "seq", "op", "client").collect()))
    assert got == sorted(map(tuple, rooms.merged(fields(batch), "room", "seq", ["op", "client"]).collect()))


def test_own_scratch_folder_only_on_this_machine(spark, monkeypatch):
    import pytest

    from lyrebird import runtime

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return type("None_", (), {"isDefined": staticmethod(lambda: False)})

    class Session:
        sparkContext = Context
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(RuntimeError):
        runtime.scratch_dir(Session)


def test_a_common_key_is_dealt_by_the_rows_values(spark):
    from lyrebird.runtime import salt_of, spread_join

    rows = [("hot" if i % 3 else f"k{i}", i, f"v{i}") for i in range(900)]
    kind = "key string, i long, v string"
    ways = [spark.createDataFrame(r, kind).repartition(n) for r, n in ((rows, 2), (rows[::-1], 5))]
    dealt = [{(r.i, r.s) for r in w.select("i", salt_of(w, F.lit(16)).alias("s")).collect()} for w in ways]
    assert dealt[0] == dealt[1] and len({s for _, s in dealt[0]}) == 16
    table = spark.createDataFrame([("hot", 600, "h"), ("k0", 1, "z"), ("gone", 5, "g")], "key string, n long, w string")
    got = sorted((r.i, r.w) for r in spread_join(ways[0], table, ["key"], "n", most=10).collect())
    assert got == sorted([(i, "h") for k, i, _ in rows if k == "hot"] + [(0, "z")])


def test_two_writers_take_different_numbers(spark, tmp_path):
    import os
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log")
    sinks.append_log(spark.range(1), path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: sinks.append_log(spark.range(n), path), range(2, 6)))
    assert sorted(d for d in os.listdir(path) if d.startswith("batch=")) == [f"batch={n:012d}" for n in range(1, 6)]
    assert spark.read.json(path).count() == 1 + 2 + 3 + 4 + 5


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    newest = lambda both: both.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at"))
    rows = lambda r: spark.createDataFrame(r, "k long, v string, at long")
    names = lambda: {str(p.relative_to(path)) for p in (tmp_path / "t").glob("data-*/*/*.parquet")}
    read = lambda: {r.k: (r.v, r.at) for r in upserts.read_upserted(spark, path).collect()}
    assert upserts.upsert(rows([(k, "a", 1) for k in range(40)]), path, "k", newest, 0, 16) == 1
    first = names()
    assert upserts.upsert(rows([(3, "b", 2), (100, "new", 2)]), path, "k", newest, 1) == 2
    live = json.loads((tmp_path / "t" / "_versions" / f"{2:012d}.json").read_text())["files"]
    assert sum(f.startswith("data-000000000001/") for f in live.values()) >= 14 and first <= names()
    want = {k: ("a", 1) for k in range(40)} | {3: ("b", 2), 100: ("new", 2)}
    assert read() == want
    before = names()
    assert upserts.upsert(rows([(3, "again", 9)]), path, "k", newest, 1) == 2 and read() == want and names() == before  # a replayed batch
    assert upserts.upsert(rows([(3, "late", 1), (4, "c", 3)]), path, "k", newest, 2) == 3
    assert upserts.upsert(rows([]), path, "k", newest, 3) == 4
    assert read() == want | {4: ("c", 3)} and len(list((tmp_path / "t" / "_versions").glob("*.json"))) == 2
    assert upserts.upsert(rows([(4, "gone", 4)]), path, "k", lambda both: both.where("k != 4"), 4) == 5 and 4 not in read()


def test_fields_have_times_of_their_own(spark, tmp_path):
    kind = "k long, at long, a string, b string"
    for n, batch in enumerate([[(1, 10, "x", None)], [(1, 5, "old", "late")], [(1, 7, None, "later")]]):
        spark.createDataFrame(batch, kind).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        rooms.merged_into(stream, f"{tmp_path}/m", "k", "at", ["a", "b"]).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in upserts.read_upserted(spark, f"{tmp_path}/m").select("k", "at", "a", "b").collect()] == [(1, 10, "x", "later")]


class Faulty(objects.FolderStore):
    """Fails for good for some keys and once for others."""

    def put(self, key, body):
        import os

        if key.startswith("bad"):
            raise OSError(f"no room for {key}")
        if key.startswith("slow") and not os.path.exists(f"{self.root}/.tried-{key}"):
            os.makedirs(self.root, exist_ok=True)
            open(f"{self.root}/.tried-{key}", "w").close()
            raise TimeoutError("once")
        super().put(key, body)


def test_puts_that_fail_and_pages(spark, tmp_path):
    store = Faulty(f"file://{tmp_path}/store")
    rows = [(f"{('ok', 'slow', 'bad')[k % 3]}{k:03d}", b"x" * k) for k in range(90)] + [(None, b"x"), ("empty", None)]
    df = spark.createDataFrame(rows, "key string, body binary").repartition(3)
    for _ in range(2):  # a second run doubles nothing
        outcomes = objects.put_objects(df, store, pause=0.01)
        bad = {r.name: r.error for r in outcomes.where("error is not null").collect()}
        assert bad == {f"bad{k:03d}": f"OSError: no room for bad{k:03d}" for k in range(2, 90, 3)} | {None: "no key", "empty": "no body"}
        assert outcomes.count() == 92
    want = sorted((f"{('ok', 'slow')[k % 3]}{k:03d}", k) for k in range(90) if k % 3 < 2)
    for cuts, limit in (([], 7), (["ok050", "slow", "zzz", "a"], 1), (["slow040"], 1000)):
        listed = objects.paged_listing(spark, store, cuts, limit=limit).collect()
        assert sorted((r.key, r["size"]) for r in listed) == want and {r.store for r in listed} == {"store"}
    assert objects.paged_listing(spark, objects.FolderStore(f"{tmp_path}/none"), ["m"]).collect() == []


def test_texts_and_arrays_of_several_lines(spark, tmp_path):
    (tmp_path / "7.md").write_text("a\n\nb\n")
    (tmp_path / "8.md").write_text(" \n\n")
    assert {r.id: r.text for r in files.texts(spark, str(tmp_path)).collect()} == {7: "a\n\nb\n", 8: None}
    (tmp_path / "block.json").write_text("[\n  1,\n  5\n]\n")
    assert sorted(r.id for r in files.blocklist(spark, f"{tmp_path}/block.json").collect()) == [1, 5]


def test_a_folder_is_read_once_for_each_range(tmp_path, monkeypatch):
    """Not once a page: pages of a large folder would take the square of its size."""
    store, real, reads = objects.FolderStore(str(tmp_path)), os.scandir, []
    for k in range(10):
        store.put(f"k{k}", b"x" * k)
    monkeypatch.setattr(objects.os, "scandir", lambda p: reads.append(p) or real(p))
    got = []
    for low, high in (("", "k4"), ("k4", None)):
        token, more = None, True
        while more:
            found, token = store.page(low, high, token, 2)
            got, more = got + found, token is not None
    assert got == [(f"k{k}", k) for k in range(10)] and len(reads) == 2
    assert store.page("", None, "k7", 5) == ([("k8", 8), ("k9", 9)], None)


def test_puts_go_over_all_tasks(spark, tmp_path):
    """A narrow table is one file split; its puts aren't one task's."""
    df = spark.range(40).coalesce(1).selectExpr("concat('k', id) as key", "cast(id as string) as body")
    plan = []

    def kept(rows, tag):
        plan.append(rows.rdd.getNumPartitions())
        return rows

    had, objects.stage_table = objects.stage_table, kept
    try:
        objects.put_objects(df, objects.FolderStore(str(tmp_path)))
    finally:
        objects.stage_table = had
    assert plan == [4]
