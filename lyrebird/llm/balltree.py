"""Exact inner-product top-k: a ball tree for each shard of the candidates, searched by branch and bound.

A ball around c with radius r holds no candidate whose inner product with q is over q.c + |q| r. The top of the
tree is fitted on a bounded sample and cuts the space into regions; each region's rows are a shard, or several,
whose tree is built once and kept with the rows. Queries are blocked by region too. Every block first searches
its own region, so that its queries' kth scores are high early; only the balls of all shards then meet the
blocks, and of the shards that some query's bound still reaches the most promising are searched first. The kth
scores found there are shared before what is left is bounded again and searched. In a tree a block goes down
together: nodes are dropped for the queries whose kth score is over the bound, and each query takes its leaves
in the order of their bounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.runtime import ship, stage_table

K, SCALE = 20, 64
#: Candidates of a shard, of a leaf, and queries of a block, at most about.
SHARD, LEAF, BLOCK = 1 << 14, 256, 2048
#: Rows that the regions are fitted on at most, and of these the least in a region.
SAMPLE, LEAST = 1 << 16, 8
#: Shards that a block searches before the kth scores are shared again.
NEAR = 4
#: Blocks that meet a shard in one task, shards whose balls are bounded at once, and the balls' bytes that are broadcast at most.
AT_ONCE, PAGE, SENT = 16, 1024, 1 << 25
#: Sums under this are exact in double precision (those under 2**24 in single precision).
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


def cut(side: np.ndarray) -> float:
    """Where to part points along a line: in the widest gap of their middle half, so that clusters stay whole."""
    side = np.sort(side)
    first, last = len(side) // 4, max(len(side) // 4 + 1, 3 * len(side) // 4)
    gap = int(np.argmax(np.diff(side[first : last + 1]))) + first
    return float((side[gap] + side[gap + 1]) / 2)


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """An order of the rows, and nodes (first, end, left child, right child; -1: none), the root first."""
    order, nodes = np.arange(len(x)), [(0, len(x), -1, -1)]
    at = 0
    while at < len(nodes):
        first, end, _, _ = nodes[at]
        if end - first > leaf:
            rows = order[first:end]
            own = x[rows]
            far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            side = own @ (other - far)
            right = side > cut(side)
            middle = int((~right).sum()) or (end - first) // 2  # equal points are halved as they stand
            order[first:end] = rows[np.argsort(right, kind="stable")]
            nodes[at] = (first, end, len(nodes), len(nodes) + 1)
            nodes += [(first, first + middle, -1, -1), (first + middle, end, -1, -1)]
        at += 1
    return order, nodes


class Regions:
    """Regions of a space, from a sample: hyperplanes between far points halve it again and again."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.directions, self.cuts, self.children = [], [], []
        self.n = 0
        self.root = self._grow(x, leaf)
        self.directions, self.cuts, self.children = np.array(self.directions).reshape(-1, x.shape[1]), np.array(self.cuts), np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, leaf: int) -> int:
        """A node's number; a region's is negative."""
        if len(x) > leaf:
            far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
            direction = x[((x - far) ** 2).sum(1).argmax()] - far
            side = x @ direction
            at = cut(side)
            right = side > at
            if right.any() and not right.all():
                node = len(self.cuts)
                self.directions.append(direction)
                self.cuts.append(at)
                self.children.append((0, 0))
                self.children[node] = (self._grow(x[~right], leaf), self._grow(x[right], leaf))
                return node
        self.n += 1
        return -self.n

    def of(self, x: np.ndarray) -> np.ndarray:
        """The region, from 0, of each row."""
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = (x[inner] * self.directions[node]).sum(1) > self.cuts[node]
            at[inner] = self.children[node, right.astype(np.int64)]
        return -at - 1


class BallTree:
    #: Inner products that searches have computed.
    computed = 0

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order, nodes = build(x, leaf)
        self.nodes = np.array(nodes, np.int64)
        self.ids, self.x = ids[order], x[order]
        self.centres = np.array([self.x[a:b].mean(0) for a, b, _, _ in nodes])
        self.radii = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for (a, b, _, _), c in zip(nodes, self.centres, strict=True)])

    def pack(self) -> dict[str, bytes]:
        return {"ids": self.ids.astype("<i8").tobytes(), "bodies": _packed(self.x), "nodes": self.nodes.astype("<i8").tobytes(), "centres": self.centres.astype("<f8").tobytes(), "radii": self.radii.astype("<f8").tobytes()}

    @classmethod
    def unpack(cls, dim: int, held: dict[str, bytes]) -> BallTree:
        out = cls.__new__(cls)
        out.ids, out.nodes = np.frombuffer(held["ids"], "<i8"), np.frombuffer(held["nodes"], "<i8").reshape(-1, 4)
        out.x = _unpacked(held["bodies"], len(out.ids), dim)
        out.centres, out.radii = np.frombuffer(held["centres"], "<f8").reshape(-1, dim), np.frombuffer(held["radii"], "<f8")
        return out

    def bounds(self, q: np.ndarray, node: int) -> np.ndarray:
        return reach(q, self.centres[node : node + 1], self.radii[node : node + 1])[:, 0]

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of each query's k best of at least ``floor``; own: the queries' ids."""
        leaves: list[tuple[int, np.ndarray]] = []  # bounds; -inf where the walk down has dropped the query
        stack = [(0, np.ones(len(q), bool))]
        while stack:
            node, live = stack.pop()
            bound = self.bounds(q, node)
            live = live & (bound >= floor)
            if live.any():
                if self.nodes[node][2] < 0:
                    leaves.append((node, np.where(live, bound, -np.inf)))
                else:
                    stack += [(child, live) for child in self.nodes[node][2:]]
        place, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        kth = floor.astype(np.float64)
        for node, bound in sorted(leaves, key=lambda n: -n[1].max()):
            rows = np.flatnonzero((bound >= kth) & (bound > -np.inf))
            if not len(rows):
                continue
            a, b, _, _ = self.nodes[node]
            s = _products(q[rows], self.x[a:b])
            self.computed += s.size
            s[own[rows][:, None] == self.ids[None, a:b]] = NONE
            least = np.where(kth[rows] > NONE, kth[rows], NONE + 1).astype(np.int64)
            if b - a > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            i, j = np.nonzero(s >= np.maximum(least, NONE + 1)[:, None])
            if not len(i):
                continue
            # only queries with new candidates are ranked anew
            touched = np.zeros(len(q), bool)
            touched[rows[i]] = True
            old = touched[place]
            p, d, v = np.concatenate([place[old], rows[i]]), np.concatenate([ids[old], self.ids[a:b][j]]), np.concatenate([scores[old], s[i, j]])
            order = np.lexsort((d, -v, p))
            p, d, v = p[order], d[order], v[order]
            rank = np.arange(len(p)) - np.searchsorted(p, p)
            last = rank == k - 1
            kth[p[last]] = np.maximum(kth[p[last]], v[last])
            kept = rank < k
            place, ids, scores = np.concatenate([place[~old], p[kept]]), np.concatenate([ids[~old], d[kept]]), np.concatenate([scores[~old], v[kept]])
        order = np.lexsort((ids, -scores, place))
        return place[order], ids[order], scores[order]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; sums beyond a long are held at its ends."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if most < EXACT:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
    whole = q.astype(object).dot(x.astype(object).T)
    return np.array([[min(max(int(v), NONE + 1), -NONE - 1) for v in row] for row in whole], np.int64).reshape(len(q), len(x))


def reach(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball at least as large a number as any inner product inside, with room for rounding."""
    length = np.sqrt((q * q).sum(1))[:, None]
    return q @ centres.T + length * radii + 1e-9 * length * (np.abs(centres).sum(1) + radii) + 1e-6


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as 16-bit ones where these are enough, else as doubles."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<f8").tobytes()


def _unpacked(body: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(body, "<i2" if len(body) == 2 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def _stack(bodies: list[bytes], dim: int) -> np.ndarray:
    if all(len(b) == 2 * dim for b in bodies):
        return _unpacked(b"".join(bodies), len(bodies), dim)
    return np.stack([_unpacked(b, 1, dim)[0] for b in bodies])


def _regions(rows: DataFrame, n: int) -> dict[int, Regions]:
    """For each length of vectors that needs more than one shard its regions, from a sample of all rows."""
    many = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).where(f"n > {SHARD}").collect()}  # at most rows / SHARD
    if not many:
        return {}
    share = min(1.0, 1.2 * SAMPLE / n)
    picked = rows.where(F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(1 << 20)) < int(share * (1 << 20))).select("dim", "body").limit(SAMPLE).collect()
    out = {}
    for dim, total in many.items():
        own = [bytes(r["body"]) for r in picked if r["dim"] == dim]
        if own:
            out[dim] = Regions(_stack(own, dim), max(LEAST, len(own) * SHARD // total))
    return out


def _split(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``sub``: a region with more than ``most`` rows is dealt over several; only such regions are broadcast."""
    parts = F.ceil(F.col("n") / most).alias("parts")
    large = rows.groupBy("dim", "region").agg(F.count("*").alias("n")).where(F.col("n") > most).select("dim", "region", parts)
    return rows.join(F.broadcast(large), ["dim", "region"], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).drop("parts")


_TREE = "shard long, dim int, region long, sub long, ids binary, bodies binary, nodes binary, centres binary, radii binary"
_ASKED = "block long, dim int, region long, own binary, queries binary, floor binary"
_HITS = "block long, place long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest integer inner products, ties to smaller ids.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but those of the query's own id. Rows whose vector is null or holds null or non-finite components,
    or whose id is null, take no part; vectors of different lengths never meet; a repeated row counts each time;
    an empty table gives no rows; other columns are not read. A query with fewer candidates returns all. Equal
    rows, or a region with very many, are dealt over several shards.
    """
    hits, blocks = _searched(vectors, k, scale, every, id_col, vector_col)

    @F.arrow_udf("array<long>")
    def listed(owns: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(o.as_buffer(), "<i8") for o in owns], pa.list_(pa.int64()))

    names = blocks.select("block", F.posexplode(listed("own")).alias("place", "query_id")).withColumn("place", F.col("place").cast("long"))
    best = _ranked(hits).where(F.col("rank") <= k)
    return best.join(names, ["block", "place"]).select("query_id", "rank", "vec_id", "score")


def _ranked(hits: DataFrame) -> DataFrame:
    """Hits with their rank for their query; the bound on it lets each task cut its own hits before the shuffle."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")))


def _searched(vectors: DataFrame, k: int, scale: int, every: int, id_col: str, vector_col: str, seen: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The hits of all waves, and the blocks of queries. ``seen`` takes each wave's pairs of a block and a shard."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("vector").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.where(finite & (F.size("vector") > 0)).withColumn("dim", F.size("vector"))

    @F.arrow_udf("binary")
    def quantised(column: pa.Array) -> pa.Array:
        return pa.array([_packed(np.floor(scale * np.array(x.as_py(), np.float64))) for x in column], pa.binary())

    rows = stage_table(rows.select("vec_id", "dim", quantised("vector").alias("body"), F.monotonically_increasing_id().alias("row")), "vectors")
    regions = spark.sparkContext.broadcast(_regions(rows, max(1, rows.count())))

    @F.arrow_udf("long")
    def region_of(dims: pa.Array, bodies: pa.Array) -> pa.Array:
        size, out = dims.to_numpy(zero_copy_only=False), np.zeros(len(dims), np.int64)
        for dim, held in regions.value.items():
            at = np.flatnonzero(size == dim)
            if len(at):
                out[at] = held.of(_stack(bodies.take(pa.array(at)).to_pylist(), dim))
        return pa.array(out)

    rows = stage_table(rows.withColumn("region", region_of("dim", "body")), "placed")

    def plant(key: tuple, group: pa.Table) -> pa.Table:
        dim, region, sub = (part.as_py() for part in key)
        tree = BallTree(group["vec_id"].to_numpy(), _stack(group["body"].to_pylist(), dim))
        return pa.Table.from_pylist([{"dim": dim, "region": region, "sub": sub} | tree.pack()], pa.schema([("dim", pa.int32()), ("region", pa.int64()), ("sub", pa.int64()), *((c, pa.binary()) for c in ("ids", "bodies", "nodes", "centres", "radii"))]))

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        ids, x = group["vec_id"].to_numpy().astype("<i8"), _stack(group["body"].to_pylist(), key[0].as_py())
        held = {"dim": key[0].as_py(), "region": key[1].as_py(), "own": ids.tobytes(), "queries": _packed(x), "floor": np.full(len(ids), NONE, "<i8").tobytes()}
        return pa.Table.from_pylist([held], pa.schema([("dim", pa.int32()), ("region", pa.int64()), ("own", pa.binary()), ("queries", pa.binary()), ("floor", pa.binary())]))

    by = ["dim", "region", "sub"]
    number = F.monotonically_increasing_id()
    shards = stage_table(_split(rows, SHARD).groupBy(*by).applyInArrow(plant, _TREE.split(", ", 1)[1]).select(number.alias("shard"), "*"), "shards")
    blocks = stage_table(_split(rows.where(F.col("vec_id") % every == 0), BLOCK).groupBy(*by).applyInArrow(gather, _ASKED.split(", ", 1)[1]).select(number.alias("block"), "*"), "blocks")
    pages, chunks = _pages(shards)

    home = stage_table(blocks.select("block", "dim", "region").join(shards.where("sub = 0").select("shard", "dim", "region"), ["dim", "region"]).select("block", "shard"), "pairs")
    hits, done = _wave(home, blocks, shards, k), home
    if seen is not None:
        seen.append(home)
    for near in (NEAR, None):
        blocks = _raised(blocks, hits, k)
        left = _reached(blocks, pages, chunks).join(done, ["block", "shard"], "left_anti")
        if near:
            left = left.withColumn("turn", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("margin"), "shard"))).where(F.col("turn") <= near)
        pairs = stage_table(left.select("block", "shard"), "pairs")
        if seen is not None:
            seen.append(pairs)
        hits, done = hits.union(_wave(pairs, blocks, shards, k)), done.union(pairs)
    return hits, blocks


def _pages(shards: DataFrame) -> tuple[DataFrame, int]:
    """The balls of all shards, many to a row, and over how many broadcasts they must be dealt."""
    n = shards.count()
    roots = shards.select("shard", "dim", F.substring("centres", 1, F.col("dim") * 8).alias("centre"), F.substring("radii", 1, 8).alias("radius"))

    def bind(key: tuple, group: pa.Table) -> pa.Table:
        whole = {c: b"".join(group[c].to_pylist()) for c in ("centre", "radius")}
        return pa.Table.from_pylist([{"dim": key[0].as_py(), "shards": group["shard"].to_pylist(), "centres": whole["centre"], "radii": whole["radius"]}], pa.schema([("dim", pa.int32()), ("shards", pa.list_(pa.int64())), ("centres", pa.binary()), ("radii", pa.binary())]))

    page = F.pmod(F.xxhash64("shard"), F.lit(-(-n // PAGE) or 1)).alias("page")
    pages = stage_table(roots.groupBy("dim", page).applyInArrow(bind, "dim int, shards array<long>, centres binary, radii binary"), "pages")
    size = pages.agg(F.sum(F.octet_length("centres") + 16 * F.size("shards"))).first()[0] or 0
    return pages, -(-size // SENT) or 1


def _reached(blocks: DataFrame, pages: DataFrame, chunks: int) -> DataFrame:
    """(block, shard, margin): the shards whose ball some query of a block may find a better candidate in."""

    @F.arrow_udf("array<struct<shard:long,margin:double>>")
    def reached(dims: pa.Array, queries: pa.Array, floors: pa.Array, names: pa.Array, centres: pa.Array, radii: pa.Array) -> pa.Array:
        out = []
        for dim, q, floor, name, c, r in zip(*(x.to_pylist() for x in (dims, queries, floors, names, centres, radii)), strict=True):
            least = np.frombuffer(floor, "<i8").astype(np.float64)
            bound = reach(_unpacked(q, len(least), dim), np.frombuffer(c, "<f8").reshape(-1, dim), np.frombuffer(r, "<f8"))
            margin = (bound - least[:, None]).max(axis=0)
            out.append([{"shard": name[i], "margin": float(margin[i])} for i in np.flatnonzero(margin >= 0)])
        return pa.array(out, pa.list_(pa.struct([("shard", pa.int64()), ("margin", pa.float64())])))

    chunk = F.pmod(F.xxhash64(F.get("shards", F.lit(0))), F.lit(chunks))
    parts = [blocks.join(F.broadcast(pages.where(chunk == c)), "dim") for c in range(chunks)]  # a bounded part of the balls at a time
    met = reduce(DataFrame.union, parts)
    return met.select("block", F.explode(reached("dim", "queries", "floor", "shards", "centres", "radii")).alias("r")).select("block", "r.*")


def _wave(pairs: DataFrame, blocks: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """The hits of pairs of a block and a shard. A shard that many blocks want goes to several tasks."""
    copies = pairs.groupBy("shard").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("copies"))
    planted = shards.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    asked = pairs.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("block"), F.col("copies")).cast("int")).select("block", "shard", "copy").join(blocks.drop("region"), "block")

    def search(key: tuple, trees: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if trees.num_rows:
            held = trees.to_pylist()[0]
            tree = BallTree.unpack(held["dim"], held)
            for ask in asks.to_pylist():
                floor = np.frombuffer(ask["floor"], "<i8").astype(np.float64)
                place, ids, scores = tree.search(np.frombuffer(ask["own"], "<i8"), _unpacked(ask["queries"], len(floor), held["dim"]), k, floor)
                found.append((np.full(len(place), ask["block"]), place, ids, scores))
        whole = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("block", "place", "vec_id", "score"), whole, strict=True)))

    return stage_table(planted.groupBy("shard", "copy").cogroup(asked.groupBy("shard", "copy")).applyInArrow(search, _HITS), "hits")


def _raised(blocks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The blocks with each query's kth score so far as its floor; a query with fewer hits keeps the old one."""
    best = _ranked(hits).where(F.col("rank") <= k).where(F.col("rank") == k).select("block", "place", F.col("score").alias("kth"))

    def raise_floors(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        floor = np.frombuffer(left["floor"][0].as_py(), "<i8").copy()
        floor[right["place"].to_numpy()] = right["kth"].to_numpy()
        return left.set_column(left.schema.get_field_index("floor"), "floor", pa.array([floor.tobytes()], pa.binary()))

    return stage_table(blocks.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(raise_floors, _ASKED), "raised")
