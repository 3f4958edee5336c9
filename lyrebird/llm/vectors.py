"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, then exact cosines.

Equal vectors are one class first. A vector's signs against random hyperplanes are its bucket in each table;
two vectors of cosine c share a sign with probability 1 - acos(c) / pi. The number of tables follows from
that: a pair at the threshold is missed with probability MISS at most, one above it with less. Buckets are
screened on narrow rows (class and the signs of the first tables): only members that have a candidate which
they meet in no earlier table fetch their vectors, for the exact cosines. Buckets have no cap: one that is too
large for a task is dealt into tiles, and each pair of tiles is compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.components import components
from lyrebird.llm.simhash import Forest
from lyrebird.runtime import ship, spread_join, stage_table

THRESHOLD = 0.95
#: Chance that a pair right at the threshold shares no bucket.
MISS = 1e-4
#: Vectors that a bucket holds on average, and at most before it is dealt into tiles.
BUCKET, TILE = 256, 2048
SEED = 20
#: Chance that the screen of the first tables' signs loses a pair at the threshold.
SCREEN_MISS = 1e-7
#: Classes that are broadcast at most, to fetch their vectors; more of them are joined by a shuffle.
FETCHED = 1 << 19


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket and tables, for n vectors."""
    bits = max(4, min(30, math.ceil(math.log2(max(n, 1) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def screen_limit(n: int, threshold: float = THRESHOLD, miss: float = SCREEN_MISS) -> int:
    """The least number of differing signs, of n, that a pair at the threshold exceeds with probability ``miss`` at most."""
    p = math.acos(threshold) / math.pi
    beyond, k = 1.0, -1
    while beyond > miss and k < n:
        k += 1
        beyond -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows that agree in the keys, from batches that are sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None and held.num_rows else now
        if not now.num_rows:
            continue
        key = np.stack([now[k].to_numpy() for k in keys])
        bounds = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield now.slice(a, b - a)
        held = now.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held


class Signs:
    """How the buckets of all tables are packed: as many to a 64-bit number as fit, those of the first tables first."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables, self.each = bits, tables, 64 // bits
        self.columns = [f"s{k}" for k in range(-(-tables // self.each))]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Packed signs of the rows of x, one row for each column."""
        planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((self.tables * self.bits, x.shape[1])).T
        out = np.zeros((len(self.columns), len(x)), np.uint64)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            signs = (part / np.abs(part).max(axis=1, keepdims=True) @ planes >= 0).reshape(len(part), self.tables, self.bits)
            buckets = (signs @ (1 << np.arange(self.bits))).astype(np.uint64)
            for t in range(self.tables):
                out[t // self.each, at : at + 1024] |= buckets[:, t] << np.uint64(self.bits * (t % self.each))
        return out.view(np.int64)

    def bucket(self, table: int) -> Column:
        return F.shiftrightunsigned(F.col(self.columns[table // self.each]), self.bits * (table % self.each)).bitwiseAND(F.lit((1 << self.bits) - 1))

    def met(self, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
        """Whether pairs (packed signs, a column each) share a bucket in a table before this one, as far as the signs go."""
        out, mask = np.zeros(a.shape[1], bool), np.uint64((1 << self.bits) - 1)
        for t in range(min(table, self.each * len(a))):
            k, shift = t // self.each, np.uint64(self.bits * (t % self.each))
            out |= (a[k] ^ b[k]) >> shift & mask == 0
        return out


def _signed(vectors: DataFrame, signs: Signs) -> DataFrame:
    """vectors (null: none) with packed signs."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in signs.columns) + ">")
    def packed(column: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        out = np.zeros((len(signs.columns), len(column)), np.int64)
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            out[:, at] = signs.of(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
        return pa.StructArray.from_arrays([pa.array(c) for c in out], signs.columns)

    return vectors.withColumn("signs", packed("vector")).select("*", "signs.*").drop("signs")


def _pairs(n: int, tile: np.ndarray, split: bool, near: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, where a block's rows are near; of a pair of tiles only those across it."""
    for at, hit in near:
        i, j = np.nonzero(hit)
        i, j = i + at, j + at
        kept = i < j
        if split:  # pairs within a tile belong to that tile alone
            kept &= tile[i] != tile[j]
        i, j = i[kept], j[kept]
        for part in range(0, len(i), 1 << 20):
            yield i[part : part + (1 << 20)], j[part : part + (1 << 20)]


def links(classes: DataFrame, bodies: DataFrame, signs: Signs, threshold: float = THRESHOLD) -> DataFrame:
    """For classes (class, rows, dim, packed signs) and bodies (class, vector): (class, linked, root), in parts.

    Summed over the parts, ``linked`` is the number of rows of linked classes, each pair counted in the first
    table where it meets; (class, root) are edges that join what a part's links join.
    """
    shown = signs.columns[:2]
    used = min(signs.tables, signs.each * len(shown)) * signs.bits
    limit = screen_limit(used, threshold)
    # a bucket's key: its number in the low 30 bits, then the table, then the length of the vectors
    place_of = F.col("dim").cast("long") * F.lit(1 << 40)
    placed = classes.select("class", *shown, F.explode(F.array(*[signs.bucket(t) + F.lit(t << 30) + place_of for t in range(signs.tables)])).alias("key"))
    hot = stage_table(placed.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {TILE}").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "hot")
    n_hot = hot.count()
    if n_hot:
        dealt = placed.join(F.broadcast(hot) if n_hot <= FETCHED else hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "class", *shown)
    else:
        none = F.lit(0)
        dealt = placed.select("key", none.alias("low"), none.alias("high"), none.alias("tile"), "class", *shown)
    place = ["key", "low", "high"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ("key", "low", "high")):
            n = run.num_rows
            if n < 2:
                continue
            f = np.stack([run[c].to_numpy() for c in shown]).view(np.uint64)
            tile, hit = run["tile"].to_numpy(), np.zeros(n, bool)
            table = run["key"][0].as_py() >> 30 & 1023

            def near() -> Iterator[tuple[int, np.ndarray]]:
                for at in range(0, n, 512):
                    yield at, sum(np.bitwise_count(c[at : at + 512, None] ^ c[None, at:]) for c in f) <= limit

            for i, j in _pairs(n, tile, run["low"][0].as_py() != run["high"][0].as_py(), near()):
                new = ~signs.met(f[:, i], f[:, j], table)
                hit[i[new]] = hit[j[new]] = True
            if hit.any():
                yield from run.filter(pa.array(hit)).select([*place, "tile", "class"]).to_batches()

    kind = "key long, low int, high int, tile int, class long"
    members = stage_table(dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(screen, kind), "members")
    wanted = stage_table(members.select("class").distinct(), "wanted")
    if wanted.count() <= FETCHED:
        bodies = bodies.join(F.broadcast(wanted), "class", "left_semi")
    met = members.join(bodies, "class").join(classes.select("class", "rows", *signs.columns), "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ("key", "low", "high")):
            ids, rows, tile = (run[c].to_numpy() for c in ("class", "rows", "tile"))
            s = np.stack([run[c].to_numpy() for c in signs.columns]).view(np.uint64)
            x = _units(pa.concat_arrays(run["vector"].chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
            table, forest, linked = run["key"][0].as_py() >> 30 & 1023, Forest(len(ids)), np.zeros(len(ids), np.int64)
            near = ((at, x[at : at + 512] @ x[at:].T >= threshold) for at in range(0, len(ids), 512))
            for a, b in _pairs(len(ids), tile, run["low"][0].as_py() != run["high"][0].as_py(), near):
                new = ~signs.met(s[:, a], s[:, b], table)
                a, b = a[new], b[new]
                linked += np.bincount(a, rows[b], len(ids)).astype(np.int64) + np.bincount(b, rows[a], len(ids)).astype(np.int64)
                forest.join(a, b)
            shown = np.flatnonzero(linked)
            if len(shown):
                yield pa.RecordBatch.from_pydict({"class": ids[shown], "linked": linked[shown], "root": ids[forest.roots(shown)]})

    return met.repartition(*place).sortWithinPartitions(*place).mapInArrow(compare, "class long, linked long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors link with one another, and rows that repeat an id count as rows of their
    own. A null id has a component only by its links, and is not kept. An empty table gives no rows; other
    columns are not read; a vector may have any length. Links are never listed as pairs: tasks return counts and forests. Rows meet their
    class by a 128-bit hash of the vector, and a class that very many rows have is dealt over several tasks.
    """
    ship(vectors.sparkSession)
    bits, tables = tables_for(vectors.count(), threshold)
    signs = Signs(bits, tables)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    hashes = [F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(k), "vector")).alias(f"h{k}") for k in (1, 2)]
    rows = stage_table(_signed(rows.select("vec_id", "vector", F.size("vector").alias("dim"), *hashes, F.monotonically_increasing_id().alias("row")), signs), "vectors")
    good = rows.where("h1 is not null")
    one = [F.min("row").alias("class"), F.min("vec_id").alias("least"), F.count("*").alias("rows"), *[F.min(c).alias(c) for c in signs.columns]]
    classes = stage_table(good.groupBy("h1", "h2", "dim").agg(*one), "classes")
    found = stage_table(links(classes, rows.select(F.col("row").alias("class"), "vector"), signs, threshold), "links")
    counts = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    grouped = components(found.select(F.col("class").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("class"), "component")
    named = classes.select("h1", "h2", "class", "least", "rows").join(counts, "class", "left").join(grouped, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(named, least, ["component"], "n").select("h1", "h2", "rows", (F.coalesce("linked", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    linked = spread_join(good.select("vec_id", "h1", "h2"), named, ["h1", "h2"], "rows").select("vec_id", "n_links", "component_id")
    alone = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
