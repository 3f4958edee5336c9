import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lyrebird.llm import balltree, simhash, vectors
from lyrebird.llm.components import components


def smallest(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (140, 2))] + [(i, i + 1) for i in range(250, 290)] + [(7, j) for j in range(100, 140)]
    df = spark.createDataFrame([*pairs, (5, 5), (None, 3), (3, None)], "u long, v long")
    want = {i: r for i, r in enumerate(smallest(n, pairs))}
    got = {r.node: r.component for r in components(df).collect()}
    linked = {i for p in pairs if p[0] != p[1] for i in p}
    assert got == {i: want[i] for i in linked}
    assert components(df.limit(0)).count() == 0


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    groups = {}
    for i, r in enumerate(smallest(len(rows), pairs)):
        groups.setdefault(r, []).append(i)
    want = []
    for members in groups.values():
        least = min((rows[i].doc_id for i in members if rows[i].doc_id is not None), default=None)
        want += [(rows[i].doc_id, f"{prints[i]:016x}", least) for i in members]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and key
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    leasts = {min((rows[i].doc_id for i in m if rows[i].doc_id is not None), default=None) for m in groups.values()}
    assert {r.doc_id for r in kept.collect()} == leasts
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_trie_walk_finds_every_near_pair(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 1 << 63, 150, dtype=np.int64).astype(np.uint64)
    near = base[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    far = base[:40] ^ np.uint64(0b11110000)
    keys = np.unique(np.concatenate([base, near, far, near ^ np.uint64(1)]))
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if bin(int(keys[i] ^ keys[j])).count("1") <= 3}
    trie = simhash.Trie(keys)
    n = len(trie.level(depth)) - 1
    a, b = np.triu_indices(n)
    got = [tuple(sorted(p)) for i, j in simhash.walk(trie, depth, a, b, 3) for p in zip(i.tolist(), j.tolist())]
    assert sorted(got) == sorted(want)


def test_links_over_many_subtrees(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 62), 1 << 62, 400)
    keys = np.unique(np.concatenate([base, base ^ 1, base ^ (1 << 61), base ^ ((1 << 60) | (1 << 30) | 4)]))
    monkeypatch.setattr(simhash, "SUBTREE", 4)
    edges = simhash.near_links(spark.createDataFrame(pd.DataFrame({"fp": keys}))).toPandas()
    at = {int(k): i for i, k in enumerate(keys)}
    pairs = [(i, j) for i in range(len(keys)) for j in range(i) if bin(int(keys[i] ^ keys[j]) & (1 << 64) - 1).count("1") <= 3]
    assert smallest(len(keys), [(at[u], at[v]) for u, v in zip(edges.u, edges.v)]) == smallest(len(keys), pairs)


def clusters(rng, n, dim=24):
    centres = rng.standard_normal((n // 8, dim))
    x = np.concatenate([centres[rng.integers(0, len(centres), n // 2)] + 0.12 * rng.standard_normal((n // 2, dim)), rng.standard_normal((n - n // 2, dim))])
    x[:5] = x[9]
    return x.astype(np.float32)


@pytest.mark.parametrize("tile", [2048, 16])
def test_embedding_links(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BUCKET", 32)
    x = clusters(np.random.default_rng(tile), 400)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = u @ u.T
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if cos[i, j] >= 0.95]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] + [1.0] * 23), (1004, []), (1005, [float("inf")] * 24)]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(i, v, "b") for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    links = np.bincount(np.array(pairs).ravel(), minlength=len(x))
    want = smallest(len(x), pairs)
    assert len(got) == len(rows) and len(pairs) > 100
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_embedding_ids(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (2, [1e-30, 0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, 2, False), (5, 3, 2, False), (None, 3, 2, False), (None, 0, None, False), (2, 3, 2, True), (3, 0, 3, True)], key=str)


def test_misses_are_rare():
    for n in (100, 10_000, 10**6, 10**9):
        bits, tables = vectors.tables_for(n)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= vectors.MISS and bits <= 30


def top_k(ids, x, k=20):
    q = np.floor(64 * x.astype(float))
    out = []
    for i, own in zip(ids, q):
        if i % 20 == 0:
            s = (q @ own).astype(int)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out += [(i, r + 1, ids[j], s[j]) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("shard, leaf, block", [(1 << 14, 512, 4096), (64, 8, 5)])
def test_top_k(spark, monkeypatch, shard, leaf, block):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = clusters(rng, 300, 8) * 0.3
    x[40:70] = np.round(x[40:70])  # ties
    ids = np.arange(300) * 5
    rows = [(int(i), v.tolist(), "c") for i, v in zip(ids, x)] + [(1500, None, ""), (1501, [float("nan")] * 8, ""), (1520, [1.0, None] + [0.0] * 6, ""), (None, [9.0] * 8, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in balltree.exact_top_k(df).collect())
    assert got == sorted(top_k(ids, x))
    assert balltree.exact_top_k(df.limit(0)).count() == 0


def test_tree_search_is_exact():
    rng = np.random.default_rng(6)
    x = np.floor(20 * clusters(rng, 500, 6)).astype(float)
    ids = rng.permutation(500)
    tree = balltree.BallTree(ids, x, leaf=16)
    place, found, scores = tree.search(ids[:40], x[:40], 7, np.full(40, balltree.NONE, float))
    for i in range(40):
        s = (x @ x[i]).astype(int)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:7]
        assert found[place == i].tolist() == ids[order].tolist() and scores[place == i].tolist() == s[order].tolist()


def tight(rng, n, dim=32, centres=40):
    """Vectors in a few tight clusters, far from one another."""
    at = rng.standard_normal((centres, dim))
    return (at[rng.integers(0, centres, n)] + 0.02 * rng.standard_normal((n, dim))).astype(np.float32)


def test_tree_search_prunes():
    x = np.floor(64 * tight(np.random.default_rng(3), 8000).astype(float))
    tree = balltree.BallTree(np.arange(8000), x, leaf=64)
    held = balltree.BallTree.unpack(32, tree.pack())
    for q in (x[:1] + 1, x[7:9]):
        place, found, scores = held.search(np.full(len(q), -1), q, 20, np.full(len(q), balltree.NONE, float))
        for i in range(len(q)):
            s = (x @ q[i]).astype(int)
            assert found[place == i].tolist() == np.lexsort((np.arange(8000), -s))[:20].tolist()
    assert held.computed < 0.3 * 3 * 8000


def test_top_k_leaves_out_shards(spark, monkeypatch):
    """Over 50,000 clustered vectors most pairs of a block and a shard are never searched, and nothing is lost."""
    monkeypatch.setattr(balltree, "SHARD", 2000)
    x = tight(np.random.default_rng(5), 50_000)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(8)
    seen = []
    hits, blocks = balltree._searched(df, 20, 64, 20, "vec_id", "embedding", seen)
    pairs, every = sum(p.count() for p in seen), blocks.count() * 32
    assert hits.count() >= 20 * 2500 and blocks.count() >= 16 and pairs < 0.5 * every
    got = balltree.exact_top_k(df).where("query_id % 2000 = 0").collect()
    q = np.floor(64 * x.astype(float))
    for query in range(0, len(x), 2000):
        s = (q @ q[query]).astype(int)
        s[query] = -(1 << 40)
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])] == [(i, s[i]) for i in np.lexsort((np.arange(len(x)), -s))[:20]]


def test_embedding_links_of_many(spark):
    """50,000 vectors, half of them in clusters: at least 99 in 100 links are found, none that isn't there."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((400, 48))
    x = np.concatenate([centres[rng.integers(0, 400, 25_000)] + 0.2 * rng.standard_normal((25_000, 48)), rng.standard_normal((25_000, 48))]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(8)
    got = vectors.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = np.concatenate([(u[a : a + 1000] @ u.T >= 0.95).sum(axis=1) - 1 for a in range(0, len(u), 1000)])
    found = got.n_links.to_numpy()
    assert want.sum() > 100_000 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_screen_keeps_pairs_at_the_threshold():
    for n in (8, 60, 128):
        limit, p = vectors.screen_limit(n), np.arccos(0.95) / np.pi
        from math import comb

        assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(limit + 1, n + 1)) <= 1.01 * vectors.SCREEN_MISS


def test_columns_pass_unchanged(spark, odd_docs):
    clash = odd_docs.withColumn("_body", F.lit("keep")).withColumn("k1", F.lit(1)).withColumn("_k1", F.lit(2)).withColumn("_stay_id", F.lit(3))
    kept = simhash.first_of_each(clash.union(clash))
    assert kept.columns == clash.columns and kept.count() == simhash.first_of_each(clash).count()
    assert {(r._body, r.k1, r._k1, r._stay_id) for r in kept.collect()} == {("keep", 1, 2, 3)}


def test_common_rows_are_spread(spark, monkeypatch):
    """A third of all rows alike, beyond what a broadcast names and a task takes."""
    from lyrebird import runtime

    monkeypatch.setattr(runtime, "SPREAD", 50)
    monkeypatch.setattr(simhash, "NAMED", 0)
    rows = [(i, "the same words in all of these", i) for i in range(300)] + [(7, "the same words in all of these", 7)] * 40 + [(1000 + i, f"other words number {i} stand here {i * i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert all(got[i] == 0 for i in range(300))
    kept = simhash.first_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c in got.values()})


def test_few_and_huge_vectors(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (20, [1e15, -1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in balltree.exact_top_k(df).collect())
    big = (1 << 63) - 1
    assert got == [(0, 1, 20, big), (0, 2, 7, 128 * 64 * 10**15 + 128 * 64), (0, 3, 7, 128 * 64 * 10**15 + 128 * 64), (20, 1, 0, big), (20, 2, 7, 128 * 64 * 10**15 - 128 * 64), (20, 3, 7, 128 * 64 * 10**15 - 128 * 64)]


def test_no_column_is_taken_by_accident(spark, odd_docs):
    clash = odd_docs.withColumn("fp", F.lit("x")).withColumn("component", F.lit(1)).withColumn("body", F.lit(2))
    assert simhash.first_of_each(clash).columns == clash.columns
