import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lyrebird.llm import resampling
from lyrebird.llm.mixing import mix, thresholds
from lyrebird.llm.resampling import resample


def mixed(spark, rows, **kw):
    return mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), **kw).collect()


def words(n):
    return "w " * n


def test_hot_source_and_stops(spark):
    rows = [(i, words(1 + i * 7 % 40), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(9000, words(30), None), (9001, None, "void"), (9002, "  ", "void")]
    out = mixed(spark, rows)
    sizes, weight = Counter(), {}
    for r in out:
        sizes[r["source"]] += r["size"]
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weight[s] = (5, 2, 1)[k % 3]
    budget, open_ = 1.5 * sum(sizes.values()), set(sizes)
    want = {}
    while True:
        part = {s: weight[s] * budget / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * sizes[s]]
        if not over:
            want |= part
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            budget -= want[s]
            open_.remove(s)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["repeats"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert len(out) == len(rows)
    again = mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_budgets_are_nested_and_a_single_bucket_is_refined(spark):
    hashed = [("a", (5 << 48) + i * 3, 2) for i in range(500)] + [("b", 7, 100), ("b", 7, 100), ("b", 9, 10)]
    rows = spark.createDataFrame(hashed, "source_key string, hash long, size long")
    needs = spark.createDataFrame([("a", 1.0), ("a", 400.0), ("a", 999.5), ("a", 2000.0), ("b", 90.0), ("b", 120.0), ("b", 205.5)], "source_key string, need double")
    cut = {(r["source_key"], r["need"]): r["below"] for r in thresholds(rows, needs).collect()}
    held = {k: sum(size for s, h, size in hashed if s == k[0] and h < below) for k, below in cut.items()}
    assert held == {("a", 1.0): 0, ("a", 400.0): 400, ("a", 999.5): 1000, ("a", 2000.0): 1000, ("b", 90.0): 0, ("b", 120.0): 200, ("b", 205.5): 210}


def test_mix_of_odd_rows(spark, odd_docs):
    out = mix(odd_docs).collect()
    assert len(out) == odd_docs.count() and {r["source"] for r in out} == {None, "s0", "s1", "s2"}
    assert mix(odd_docs.limit(0)).collect() == []
    empty = mix(odd_docs.where("text is null or trim(text) = ''")).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in empty} == {(0, 0.0, 0)}
    long = mixed(spark, [(1, words(900_000), "a"), (2, words(10), "b")])
    assert {r["doc_id"]: (r["target"], r["taken"]) for r in long} == {1: (1_349_995.0, 900_000), 2: (20.0, 20)}  # a second time would be 5 words farther off


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, n=3):
    found = WORD.findall(lower(text))
    return len(found), [zlib.crc32(" ".join(found[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(found) - k + 1)]


def brute(docs, target, percent=5, least=20):
    have = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x % 10000 for _, _, f in have for x in f), Counter(x % 10000 for text in target for x in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in have:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x % 10000] for x in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], -1 if r[0] is None else r[0]) for r in out if r[1] >= least)
    rank = {x: k + 1 for k, x in reversed(list(enumerate(able[: len(able) * percent // 100])))}
    return [(*r, rank.get((-r[4], -1 if r[0] is None else r[0])) if r[1] >= least else None) for r in out]


COLUMNS = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_resampling_is_the_plain_version(spark, sf, docs):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    got = [tuple(r[c] for c in COLUMNS) for r in resample(docs, target).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[5] is not None for r in got) == sum(r[1] >= 20 for r in want) * 5 // 100 > 0


def test_resampling_odd_rows(spark, odd_docs):
    kinds = "doc_id long, text string"
    target = spark.createDataFrame([(1, None), (2, "Same text HERE again"), (3, "")], "item_id long, text string")
    held = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in resample(odd_docs, target, percent=50, least=1).collect()]
    want = brute(held, [None, "Same text HERE again", ""], 50, 1)
    assert sorted(map(str, [r[:5] for r in got])) == sorted(map(str, [r[:5] for r in want]))
    assert sorted(r[5] for r in got if r[5]) == list(range(1, sum(r[1] >= 1 for r in want) // 2 + 1))
    assert resample(odd_docs.limit(0), target).collect() == []
    assert {r["weight"] for r in resample(spark.createDataFrame([(1, ""), (2, None)], kinds), target.limit(0)).collect()} == {0}


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join("é" * int(n) if n % 5 == 0 else "Ab9" * int(n) for n in rng.integers(1, 60, 4000)) + " " + "x" * 9000 + " end"
    for block in (1, 7, 300, 5000, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK", block)
        got = [int(v) for _, parts in resampling._blocks([text.encode(), b"", b"one", None], 3) for _, sums in resampling.n_grams(parts, 3)[1] for v in sums]
        assert sorted(got) == sorted(features(text)[1] + features("one")[1])
        if block < 300:
            text = text[:4000]


def test_shift_is_the_checksum_of_more_zeros():
    n = np.array([0, 1, 5, 63, 64, 65, 1000, 70_000])
    sums = np.array([zlib.crc32(b"abc")] * len(n), np.uint32)
    # a checksum of a text and zeros is the shifted one and that of the zeros alone
    assert [int(a) ^ zlib.crc32(bytes(int(k))) for a, k in zip(resampling.shifted(sums, n), n, strict=True)] == [zlib.crc32(b"abc" + bytes(int(k))) for k in n]


def test_the_target_draws(spark):
    rng = np.random.default_rng(9)
    near, far = [f"apple{i}" for i in range(30)], [f"pear{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(near if i % 20 == 0 else far, 40))) for i in range(2000)]
    target = spark.createDataFrame([(i, " ".join(rng.choice(near, 40))) for i in range(50)], "item_id long, text string")
    drawn = [r["doc_id"] for r in resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 20 == 0 for i in drawn) >= 95
