import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lyrebird.llm.contraction import subtree_totals
from lyrebird.llm.conversations import prefix_trie, running

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, 20))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out, totals, children = [], defaultdict(lambda: [0, 0]), defaultdict(int)
    for p in members:
        children[p[:-1]] += bool(p)
    for p, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            totals[p[:d]][0] += children[p] == 0
            totals[p[:d]][1] += saved
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(spark.createDataFrame(rows, KIND + ", node int, k1 string").repartition(3)).collect()), key=str)


def extended(rows):
    return [(*r, 1, "x") for r in rows]


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert built(spark, extended(rows)) == plain(rows)


def test_shared_turns_copies_and_a_long_chain(spark):
    rng = np.random.default_rng(2)
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"w{rng.integers(2)} {'x ' * int(rng.integers(3))}") for c in range(300) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1200) for t in range(5)]  # a group of copies
    rows += [(5000, t, "user", f"long {t}") for t in range(700)] + [(5017, t, "user", f"long {t}") for t in range(300)]
    rows += [(-c, t, "a", f"minus {c % 3} {t}") for c in range(1, 60) for t in range(3)]
    assert built(spark, extended(rows)) == plain(rows)


def test_odd_turns(spark):
    rows = [
        (40, 1, None, "b"), (40, None, "user", "first"), (40, 0, "user", None), (40, 0, "bot", "tie"), (40, 2, "user", "\x1c two\twords\n"),
        (41, 0, "", "b"), (41, 0, "", "b"), (45, 0, "user", ""), (63, 3, "user", "no base"), (64, 0, None, None), (None, 0, "user", "nobody"), (48, 0, "x" * 70, "y " * 400_000),
        (66, 0, "a", "b"), (67, 0, "ab", ""), (68, 0, "", "ab"), (80, 0, "1:", "c"), (81, 0, "u", "w " * 40 + "b"), (81, 0, "u", "w " * 40 + "a"), (81, 1, "u", "after"),
    ]
    got = built(spark, extended(rows))
    want = plain(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want] and got == want
    assert built(spark, extended([(None, 1, "a", "b")])) == []
    assert prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    assert {r[0] for r in got if r[1] == 0} == {40}
    # 63 has no family and loses its first turns: it ends at the root
    assert next(r for r in got if r[1] == 0)[7] != hashlib.sha256(b"").hexdigest() or zlib.crc32(b"63") % 4 == 0


@pytest.mark.parametrize("kind", ["chain", "crossed chain", "comb", "bush", "forest"])
def test_contraction(spark, kind):
    rng = np.random.default_rng(4)
    n = 60 if kind in ("crossed chain", "bush") else 300
    parent = {
        "chain": lambda k: k - 1, "crossed chain": lambda k: k - 1, "comb": lambda k: k - 1 if k % 2 else max(k - 2, 0), "bush": lambda k: int(rng.integers(max(0, k - 9), k)),
        "forest": lambda k: int(rng.integers(0, k)) if k % 50 else None,
    }[kind]
    up = [None] + [parent(k) for k in range(1, n)]
    name = rng.permutation(n) if kind in ("crossed chain", "bush") else np.arange(n)
    value = rng.integers(0, 100, n)
    want = [int(v) for v in value]
    for k in range(n - 1, 0, -1):
        if up[k] is not None:
            want[up[k]] += want[k]
    count = [0] * n
    for p in up:
        if p is not None:
            count[p] += 1
    rows = [(int(name[k]), None if up[k] is None else int(name[up[k]]), count[k], int(value[k]), None) for k in range(n)]
    tree = spark.createDataFrame(rows, "node long, parent long, n long, value long, empty long")
    got = {r["node"]: (r["value"], r["empty"]) for r in subtree_totals(tree, ["value", "empty"]).collect()}
    assert got == {int(name[k]): (want[k], 0) for k in range(n)}
    assert subtree_totals(tree.limit(0), ["value"]).collect() == []


def test_running_sums_cross_partitions(spark):
    rows = [(7, i, 3) for i in range(500)] + [(k, 0, 1) for k in (1, 9, 12)] + [(8, i, 2**62) for i in range(6)]
    out = running(spark.createDataFrame(rows, "k long, i long, v long").repartition(5), "k", ["i"], ["v"]).collect()
    assert {(r["i"], r["v_before"], r["v_after"]) for r in out if r["k"] == 7} == {(i, 3 * i, 3 * i + 3) for i in range(500)}
    assert [r["v_after"] % 2**64 for r in sorted(out, key=lambda r: r["i"]) if r["k"] == 8] == [(i + 1) * 2**62 % 2**64 for i in range(6)]
    assert len(out) == len(rows)
