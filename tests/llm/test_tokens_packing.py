import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.llm import huffman, packing, sharding
from lyrebird.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, RankEncoder, load
from tests.llm.conftest import ODD


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_is_the_librarys(path, docs):
    ours, theirs = Encoder(path), load(path)
    texts = ODD[1:] + ["a \n b", "foo\xa0 bar", "don't we'll 'S", "a\n  b", " ́a", "1234 56a7", "_a_ |b|", "trail ", "a|b!!c"] + [r.text for r in docs.select("text").limit(60).collect()]
    texts += ["a " * 10 + "b" * 5000 + " c", "x" + " " * 4000 + "y\n" * 3000]
    for own in [ours] + [RankEncoder(path)] * (path == BYTE_BPE):
        for t in texts:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_ranks_cut_every_character_alike():
    ours, theirs = RankEncoder(BYTE_BPE), load(BYTE_BPE)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x20000, 5)]]
    texts = ["".join(f"x{c} {c}{c}1 y  {c}\n" for c in points[at : at + 16]) for at in range(0, len(points), 16)]
    for t in texts:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, ascii(t)


@pytest.mark.parametrize("text", [
    "x" + " " * 5000 + "y", "x" + " " * 200_000 + "\n y", "\t" * 4096, " \u3000" * 3000 + "é", "a \x1c" * 3000 + "\x1f" * 5000 + "b", "w" * 300_000 + " " * 4095 + "z", "a " * 3000 + "<|endoftext|>" + " " * 9000, "  \r\n" * 2000 + "'s",
])
def test_ranks_cut_long_runs_alike(text):
    assert np.frombuffer(RankEncoder(BYTE_BPE).encode(text), "<u4").tolist() == load_once(BYTE_BPE).encode(text, add_special_tokens=False).ids


def test_ranks_are_the_librarys_over_the_corpus():
    """Every whole text of the larger table."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    ours = RankEncoder(BYTE_BPE)
    for t, e in zip(texts, load_once(BYTE_BPE).encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == e.ids, t[:80]


def plain_ids(path, text):
    return [*load_once(path).encode(text or "", add_special_tokens=False).ids, 0]


_LOADED = {}


def load_once(path):
    return _LOADED.setdefault(path, load(path))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_huffman_files(which, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    got = sorted(map(tuple, huffman.huffman_ids(df).select("start", "doc_id", "n_tokens", "ids_crc32").collect()), key=lambda r: r[0])
    assert [r[1] is not None for r in got] == sorted(r[1] is not None for r in got)
    ids = [r[1] for r in got if r[1] is not None]
    assert ids == sorted(ids)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    want = Counter((r.doc_id, len(i), crc(i)) for r in rows for i in [plain_ids(BYTE_BPE, r.text)])
    assert Counter(r[1:] for r in got) == want


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)"])
def test_huffman_files_with_other_ids(spark, kind):
    """A third of all rows share one id, some have none; files follow the order of the ids, whatever their type."""
    rows = [(None if i % 17 == 0 else 7 if i % 3 == 0 else i, f"text number {i} " * (i % 5)) for i in range(400)]
    key = {"string": "lpad(cast(n as string), 4, '0')", "decimal(20,2)": "cast(n / 4 as decimal(20,2))"}[kind]
    df = spark.createDataFrame(rows, "n int, text string").selectExpr(f"{key} as doc_id", "text").repartition(2)
    coded = df.select("doc_id", F.monotonically_increasing_id().alias("row"))
    bucket, n = huffman._bucket(coded, 6)
    ranges = coded.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("b").collect()
    assert n == 6 and max(r.n for r in ranges) < 130
    known = [r for r in ranges if r.lo is not None]
    assert all(a.hi <= b.lo for a, b in zip(known, known[1:]))
    got = sorted(map(tuple, huffman.huffman_ids(df).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    ids = [r[1] for r in got]
    assert ids == [None] * ids.count(None) + sorted(i for i in ids if i is not None)
    want = Counter((r.doc_id, len(i), crc(i)) for r in df.collect() for i in [plain_ids(BYTE_BPE, r.text)])
    assert Counter(r[1:] for r in got) == want
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 700):
        counts = (rng.pareto(0.6, n) * 10).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, 12)
        assert lengths.max() <= 12 and (n < 2 or np.sum(2.0 ** -lengths.astype(float)) == 1)
    # without a binding limit the code is optimal: as short as a heap's Huffman tree
    import heapq

    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 40) * counts).sum()) == total


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum((rng.pareto(0.5, 20_000)).astype(np.int64), 900)
    codec = huffman.Codec(huffman.code_lengths(np.bincount(ids, minlength=1000), 11))
    payload, starts = codec.encode(ids, 100)
    sizes = np.full(len(starts), 100)
    assert (codec.decode(payload, starts, sizes) == ids).all()
    assert (codec.decode(payload, starts[7:9], sizes[7:9]) == ids[700:900]).all()


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    got = packing.pack(packing.pieces(df)).collect()
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = plain_ids(WORD_BPE, r.text)
        want.update((r.doc_id, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) == len(best_fit([r.length for r in got]))


def best_fit(lengths, capacity=2048):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, gap in enumerate(bins) if gap >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return bins


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.sort(rng.integers(1, 50, rng.integers(1, 300)))[::-1]
        home, offset, _, opened = packing.sweep(lengths, np.zeros(len(lengths), bool), 64, True)
        used = {}
        for gap, at, length in zip(home.tolist(), offset.tolist(), lengths.tolist()):
            used.setdefault(gap, []).append((at, length))
        assert sorted(opened.tolist()) == sorted(best_fit(lengths.tolist(), 64)) and len(used) == len(opened)
        for held in used.values():
            assert all(a + n <= b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:] + [(64, 0)]))


def test_sweep_gives_a_gap_to_the_first_that_wants_it():
    size, is_gap = np.array([50, 40, 30, 29, 20, 9, 8]), np.array([True, False, True, False, False, False, False])
    home, offset, free, opened = packing.sweep(size, is_gap, 64, False)
    assert home.tolist() == [-1, 0, -1, 2, -1, 0, -1] and offset.tolist() == [0, 0, 0, 0, 0, 40, 0]
    assert free[is_gap].tolist() == [1, 1] and not len(opened)


def test_what_waits_is_dealt_to_the_nearest_gaps_above():
    edges = [(0, 0, 0, 100), (1, 40, 4, 30), (2, 60, 12, 0), (3, 80, 20, 0)]
    got = packing.dealt(edges, 8)
    spans = {k: sorted((p, a, e) for _, kind, p, a, e in got if kind == k) for k in (packing.GAP, packing.WAITING)}
    covered = {p: sum(e - a for q, a, e in spans[packing.WAITING] if q == p) for p in (1, 2, 3)}
    assert covered == {1: 40, 2: 60, 3: 80}
    assert sum(e - a for p, a, e in spans[packing.GAP] if p == 0) == 100 and sum(e - a for p, a, e in spans[packing.GAP] if p == 1) == 30
    assert sum(e - a for g, kind, _, a, e in got if g < 0) == 180 - 130


@pytest.mark.parametrize("rows", [40, 1 << 18])
def test_rounds_over_many_partitions(spark, rows):
    """Many short documents, one length that a third of all have, and mixed ones, in partitions of a few rows."""
    rng = np.random.default_rng(rows)
    lengths = np.concatenate([np.ones(300, int), rng.integers(1, 257, 300), rng.integers(60, 90, 300)])
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    bins = {}
    for r in packing.pack(df, 256, rows).collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id))
    assert sorted(i for held in bins.values() for _, _, i in held) == list(range(len(lengths)))
    for held in bins.values():
        at = 0
        for offset, n, _ in sorted(held):
            assert offset == at
            at += n
        assert at <= 256
    least = len(best_fit(lengths.tolist(), 256))
    assert len(bins) == least if rows > 1000 else len(bins) <= 1.1 * least


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert huffman.huffman_ids(none).count() == packing.pack(packing.pieces(none)).count() == sharding.hilbert_shards(none).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    got = sharding.hilbert_shards(df).collect()
    rows = df.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    by = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(24))
    last = -1
    for s in sorted(by):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        for r in sorted(by[s], key=lambda r: r.slot):
            assert r.curve >= last
            last = r.curve


@pytest.mark.parametrize("few", [4096, 10])
def test_files_cover_small_boxes(spark, tmp_path, monkeypatch, few):
    """Files along the curve: filters on any dimension skip most of them, also where values share a long beginning."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(sharding, "FEW", few)
    rng = np.random.default_rng(0)
    rows = [(i, "x", f"https://www.example.org/{rng.integers(0, 64):03d}", int(rng.integers(0, 1000)), "kept") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _cell string")
    sharding.write_runs(df, f"{tmp_path}/runs", 32, ("source", "n_chars"))
    boxes, read = [], []
    for f in sorted((tmp_path / "runs").glob("*.parquet")):
        table = pq.read_table(f)
        read += table.to_pylist()
        boxes.append(tuple((min(c), max(c)) for c in (table["source"].to_pylist(), table["n_chars"].to_pylist())))
    assert sorted(tuple(r.values()) for r in read) == sorted(rows) and len(boxes) >= 28
    for dim, values in ((0, [r[2] for r in rows[:200]]), (1, [r[3] for r in rows[:200]])):
        hit = [sum(b[dim][0] <= v <= b[dim][1] for b in boxes) for v in values]
        assert np.mean(hit) < 0.4 * len(boxes)


def test_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    for n, bits in ((1, 3), (2, 3), (3, 2), (4, 2)):
        cells = spark.range(1 << n * bits).select(*[(F.col("id") / (1 << i * bits)).cast("long").bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{i}") for i in range(n)])
        path = [r[:-1] for r in cells.withColumn("h", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()]
        assert len(set(path)) == 1 << n * bits
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))
