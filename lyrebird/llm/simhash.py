"""SimHash near-duplicates: 64-bit fingerprints and a self-join of their binary trie.

Equal fingerprints are one leaf, so copies cost nothing. The trie is cut at a depth; each pair of subtrees
whose prefixes differ in no more bits than the budget is one piece of work, dealt to tasks by a hash of the
pair. A task walks the node pairs of its subtrees together from the top, adds up the bits in which the two
paths differ, and drops a pair of nodes as soon as the sum exceeds the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.components import components
from lyrebird.runtime import ship, spread_join, stage_table, unused

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 3
#: Fingerprints that a subtree holds at about most; the cut's depth follows from their number.
SUBTREE = 1 << 14
#: Bits of the cut at most.
DEEPEST = 24
#: Rows that are named by a broadcast at most; more of them are met by a shuffle.
NAMED = 1 << 18
#: Node pairs that are walked at once.
WAVE = 1 << 18


def fingerprint(text: str | None) -> int:
    """Bit b is set if it is set in over half of the hashes of the text's word shingles, repeats included."""
    if not text:
        return 0
    flat = b" ".join(text.encode("utf-8").lower().split())
    if not flat:
        return 0
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    k = SHINGLE - 1
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(flat)]
    view, digest = memoryview(flat), xxhash.xxh64_intdigest
    pairs = zip(starts, ends[k:], strict=False) if len(ends) > k else [(0, len(flat))]
    counts, n = np.zeros(BITS, np.int64), 0
    held = [digest(view[s:e], SEED) for s, e in pairs]
    for at in range(0, len(held), 1 << 16):
        part = np.array(held[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """docs with the fingerprint of each whole text, as a signed 64-bit number. No shuffle."""
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(text_col)))


class Trie:
    """The nodes of a sorted array of distinct fingerprints: at each depth, runs of a common prefix."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self._levels: dict[int, np.ndarray] = {}

    def level(self, depth: int) -> np.ndarray:
        """Where the runs of equal first ``depth`` bits begin, and the end."""
        if depth not in self._levels:
            prefix = self.keys >> np.uint64(BITS - depth) if depth else np.zeros(len(self.keys), np.uint64)
            self._levels[depth] = np.concatenate([[0], np.flatnonzero(np.diff(prefix)) + 1, [len(self.keys)]])
        return self._levels[depth]

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node at this depth its 0-child and 1-child at the next, or -1."""
        here, below = self.level(depth)[:-1], self.level(depth + 1)[:-1]
        parent = np.searchsorted(here, below, side="right") - 1
        bit = (self.keys[below] >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        out = np.full((2, len(here)), -1)
        out[bit.astype(np.int64), parent] = np.arange(len(below))
        return out[0], out[1]


def walk(trie: Trie, depth: int, a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of keys, in pairs, that differ in at most ``budget`` bits, below the node pairs (a, b).

    A node pairs with itself once. Waves of node pairs are kept on a stack, so memory stays bounded.
    """
    kids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    prefix = trie.keys[trie.level(depth)[:-1]] >> np.uint64(BITS - depth) if depth else np.zeros(1, np.uint64)
    stack = [(depth, a, b, np.bitwise_count(prefix[a] ^ prefix[b]).astype(np.int8))]
    while stack:
        depth, a, b, wrong = stack.pop()
        if len(a) > WAVE:
            stack += [(depth, a[i : i + WAVE], b[i : i + WAVE], wrong[i : i + WAVE]) for i in range(0, len(a), WAVE)]
            continue
        runs = trie.level(depth)
        single = (runs[a + 1] - runs[a] == 1) & (runs[b + 1] - runs[b] == 1)
        if single.any():  # two leaves: the rest of their paths at once
            i, j = runs[a[single]], runs[b[single]]
            near = (i != j) & (np.bitwise_count(trie.keys[i] ^ trie.keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            a, b, wrong = a[~single], b[~single], wrong[~single]
        if not len(a):
            continue
        if depth not in kids:
            kids[depth] = trie.children(depth)
        low, high = kids[depth]
        same = a == b
        parts = [(low[a], low[b], wrong), (high[a], high[b], wrong), (low[a], high[b], wrong + np.int8(1)), (high[a][~same], low[b][~same], wrong[~same] + np.int8(1))]
        a, b, wrong = (np.concatenate([p[i] for p in parts]) for i in range(3))
        kept = (a >= 0) & (b >= 0) & (wrong <= budget)
        stack.append((depth + 1, a[kept], b[kept], wrong[kept]))


class Forest:
    """Union-find over the places of an array; what is left are edges to each group's first place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        while True:
            i, j = self.roots(i), self.roots(j)
            apart = i != j
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))

    def roots(self, i: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            above = up[i]
            if (above == i).all():
                return i
            up[i] = up[above]
            i = up[i]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.roots(np.arange(len(self.up)))
        child = np.flatnonzero(root != np.arange(len(root)))
        return child, root[child]


def near_links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints (column fp) differing in at most ``budget`` bits.

    Every near pair is found by the walk; of those that a task finds, a spanning forest is returned, which
    has the same components. Each subtree goes to the tasks of the pairs that it is part of, packed: at
    depth d to at most sum(d over i, i to budget) of them, whatever the number of rows.
    """
    ship(prints.sparkSession)
    n = prints.count()
    depth = max(4, min(DEEPEST, int(np.ceil(np.log2(max(n, 1) / SUBTREE)))))
    flips = np.array([sum(1 << b for b in held) for k in range(budget + 1) for held in combinations(range(depth), k)], np.int64)
    packed = "owner long, fps binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy().astype(np.int64) for b in batches]
        if not held:
            return
        keys = np.sort(np.concatenate(held).view(np.uint64))
        node = (keys >> np.uint64(BITS - depth)).astype(np.int64)
        runs = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(keys)]])
        for lo, hi in zip(runs[:-1], runs[1:], strict=True):
            own = int(node[lo])
            owners = owner_of(np.int64(own), own ^ flips)
            body = keys[lo:hi].tobytes()
            owners = np.unique(owners)
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array([body] * len(owners), pa.binary())], ["owner", "fps"])

    def owner_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of two nodes does the pair's work: each one that of about half of its pairs."""
        low, high = np.minimum(p, q), np.maximum(p, q)
        return np.where((low * 31 + high * 17 >> 1) & 1 == 1, low, high)

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = int(key[0])
        keys = np.sort(np.frombuffer(b"".join(group["fps"]), np.uint64))
        trie = Trie(keys)
        nodes = (keys[trie.level(depth)[:-1]] >> np.uint64(BITS - depth)).astype(np.int64)
        here = np.flatnonzero(nodes == own)
        forest = Forest(len(keys))
        if len(here):
            mine = (np.bitwise_count(nodes ^ own) <= budget) & (owner_of(np.int64(own), nodes) == own)
            b = np.flatnonzero(mine)
            for i, j in walk(trie, depth, np.full(len(b), here[0]), b, budget):
                forest.join(i, j)
        u, v = forest.edges()
        return pd.DataFrame({"u": keys[u].view(np.int64), "v": keys[v].view(np.int64)})

    return prints.select("fp").mapInArrow(deal, packed).groupBy("owner").applyInPandas(join, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id that links lead to) of each row.

    Null, empty and blank texts have the fingerprint zero and link like any other; a null id never names a
    component that has another id; repeated rows each show; an empty table gives none. Other columns are
    not read. Texts, of any length, are read whole and never leave their tasks; a fingerprint that very many rows share is first reduced to
    one row in each task.
    """
    rows, named = _classes(docs, id_col, text_col, budget)
    met = spread_join(rows.select("doc_id", "fp"), named.select("fp", "n", "component_id"), ["fp"], "n")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    parts = [F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(id_col), F.col(text_col)]
    return [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]


def _classes(docs: DataFrame, id_col: str, text_col: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, fp) of each row, and (fp, n, component, component_id) of each fingerprint, n rows having it."""
    k1, k2 = _keys("doc_id", "text")
    rows = with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    rows = stage_table(rows.select("doc_id", k1.alias("k1"), k2.alias("k2"), "fp"), "prints")
    leaves = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "leaves")
    grouped = components(near_links(leaves, budget)).select(F.col("node").alias("fp"), "component")
    classes = leaves.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    return rows, spread_join(classes, names, ["component"], "fps").select("fp", "n", "component", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row of docs, whole, for each component: that of the smallest id (a null id after all others).

    Null, empty and blank texts are alike and link with one another. Of rows that agree in id and text one
    stays. An empty table gives an empty one; texts of any length and columns of any name pass unchanged. Which rows go is decided on
    ids and hashes; the rows that go are left out by a broadcast of their hashes where there are at most
    NAMED, and by one shuffle of the texts beyond that.
    """
    rows, named = _classes(docs, id_col, text_col, budget)
    met = spread_join(rows, named.select("fp", "n", "component"), ["fp"], "n").select("component", "doc_id", "k1", "k2")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("p")
    stay = met.groupBy("component").agg(pick).select("p.k1", "p.k2")
    counted = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).join(stay.withColumn("stays", F.lit(True)), ["k1", "k2"], "left")
    # all that doesn't simply stay: rows that go, and rows that stay once of several alike
    other = stage_table(counted.where("stays is null or n > 1").select(F.col("k1"), F.col("k2"), F.col("stays").isNotNull().alias("once")), "other")
    few = {r["once"]: r["n"] for r in other.groupBy("once").agg(F.count("*").alias("n")).collect()}
    if not few:
        return docs
    a, b = unused("k1", docs), unused("k2", docs)
    k1, k2 = _keys(id_col, text_col)
    marked = docs.withColumn(a, k1).withColumn(b, k2)

    def keyed(which: DataFrame, n: int) -> DataFrame:
        held = which.select(F.col("k1").alias(a), F.col("k2").alias(b))
        return F.broadcast(held) if n <= NAMED else held

    out = marked.join(keyed(other, sum(few.values())), [a, b], "left_anti").drop(a, b)
    if few.get(True):
        repeated = marked.join(keyed(other.where("once"), few[True]), [a, b], "left_semi").dropDuplicates([a, b])
        out = out.union(repeated.drop(a, b))
    return out
