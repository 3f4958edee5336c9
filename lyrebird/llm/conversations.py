"""The trie of conversations' first turns: who shares how much of what, and what sharing saves.

A conversation's first d turns are known by a sum of 128-bit hashes of (place, role and text), so that running
sums over range-sorted turns name all prefixes, however long a conversation is. Rows of equal sums are a node.
Totals over subtrees come from tree contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.contraction import subtree_totals
from lyrebird.llm.mixing import WORD
from lyrebird.operators.names import numbered
from lyrebird.runtime import ship, spread_join, stage_table

#: A conversation takes fewer than TAKEN first turns from the one that begins its family of FAMILY numbers.
TAKEN, FAMILY = 4, 20
#: Characters of a text by which turns of equal number and role are ordered before their hashes.
HEAD = 32
#: Ids that are joined into one piece of text, before pieces are hashed one after another.
PIECE = 1 << 14
_NOBODY = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "k1", "k2"]


def running(rows: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """rows with, for each bigint column of ``sums``, its sum over the key's rows before this one (name_before) and with it (name_after), modulo 2**64.

    The rows are range-sorted by key and order, so that a key may go over many partitions; each partition is
    summed alone and written, and what its first key has in the partitions before is added. One row for each
    partition goes to the driver. Keys must not be null.
    """
    spark = rows.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [*rows.columns, *[f"{c}_{w}" for c in sums for w in ("before", "after")]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", {n} long" for n in names[len(rows.columns) :])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, held = TaskContext.get().partitionId(), 0, None, np.zeros(len(sums), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy()
            new = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            own = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            out = []
            for i, c in enumerate(sums):
                v = b.column(c).to_numpy().view(np.uint64)
                upto = np.cumsum(v)
                after = upto - (upto - v)[own]
                if not new[0]:
                    after[: np.argmax(new) if new.any() else len(new)] += held[i]
                held[i] = after[-1]
                out += [(after - v).view(np.int64), after.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(np.full(len(keys), part), pa.int64()), pa.array(np.arange(place, place + len(keys)))], [*names, "_part", "_place"])
            place, last = place + len(keys), keys[-1]

    placed = stage_table(rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).mapInArrow(local, kinds + ", _part long, _place long"), "running")
    ends = placed.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct("_place", F.col(key).alias("key"), *[f"{c}_after" for c in sums])).alias("end")).orderBy("_part").collect()
    carry, last, held = {}, None, [0] * len(sums)
    for r in ends:
        own = [r["end"][f"{c}_after"] for c in sums]
        goes_on = held if r["first"] == last else [0] * len(sums)
        if any(goes_on):
            carry[r["_part"]] = (r["first"], goes_on)
        held = [(x + (y if r["end"]["key"] == r["first"] else 0)) % 2**64 for x, y in zip(own, goes_on, strict=True)]
        last = r["end"]["key"]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(n) for n in names}
            part = b.column("_part").to_numpy()
            for p in np.unique(part):
                if int(p) in carry:
                    of, more = carry[int(p)]
                    at = (part == p) & (b.column(key).to_numpy() == of)
                    for c, m in zip(sums, more, strict=True):
                        for n in (f"{c}_before", f"{c}_after"):
                            v = columns[n].to_numpy().view(np.uint64).copy()
                            v[at] += np.uint64(m)
                            columns[n] = pa.array(v.view(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return placed.mapInArrow(carried, kinds)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, words, g1, g2, last) and conversations (conv_id, n_turns), each beginning with turns of its family's first one."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
    ).where("conv_id is not null")
    own = stage_table(running(stage_table(turns, "turns"), "conv_id", ["turn", "role", "head", "digest"], ["one"]).select("conv_id", F.col("one_after").alias("place"), "digest", "words"), "placed")
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < TAKEN)).withColumnRenamed("conv_id", "base")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(TAKEN)).cast("int")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumn("taken", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(first.groupBy("base").agg(F.count("*").alias("has")), "base", "left").withColumn("got", F.least("taken", F.coalesce("has", F.lit(0))).cast("long"))
    convs = stage_table(convs.withColumn("n_turns", F.col("got") + F.greatest(F.col("n_own") - F.col("taken"), F.lit(0))).drop("has"), "conversations")
    heads = convs.join(first, "base").where("place <= got").select("conv_id", F.col("place").alias("depth"), "digest", "words", "n_turns")
    n = convs.select("conv_id", "taken", "got", "n_turns", F.col("n_own").alias("n"))
    tails = spread_join(own, n, ["conv_id"], "n").where("place > taken").select("conv_id", (F.col("got") + F.col("place") - F.col("taken")).alias("depth"), "digest", "words", "n_turns")
    rows = heads.unionByName(tails)
    return rows.select(
        "conv_id", "depth", "words", F.xxhash64("digest", "depth").alias("g1"), F.xxhash64(F.lit(1), "depth", "digest").alias("g2"), (F.col("depth") == F.col("n_turns")).alias("last")
    ), convs.select("conv_id", "n_turns")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """For each node the SHA-256 of the ids that end there, ascending, joined by commas.

    Ids are joined into pieces of text where they lie, range-sorted; only a node's pieces come together, and
    pass a task one after another, as the hash has to be taken in order.
    """
    ship(ends.sparkSession)
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c).to_numpy() for c in (*_KEY, "conv_id")]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)])
            own = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            at = np.flatnonzero(own % PIECE == 0)
            ids = columns[3].tolist()
            pieces = [",".join(map(str, ids[i:j])).encode() for i, j in zip(at, [*at[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in columns], pa.array(pieces, pa.binary())], [*_KEY, "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *own, ids in zip(*[b.column(c).to_pylist() for c in (*_KEY, "ids")], strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids)
            yield of(out)
        if key is not None:
            yield of([(*key, state.hexdigest())])

    def of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], r, strict=True)) for r in rows], pa.schema([*[(c, pa.int64()) for c in _KEY], ("ends_sha256", pa.string())]))

    order = [*_KEY, "conv_id"]
    pieces = stage_table(ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(join, "depth long, k1 long, k2 long, conv_id long, ids binary"), "pieces")
    return pieces.repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c begins with the first h turns of the one that begins its family (c - c % 20; all if it has
    fewer, none if it isn't there), then come its own turns after its first h; h is crc32(c) % 4. A node is a
    distinct sequence of first turns, known by its smallest member and its depth.

    Turns are ordered by number, null first, equal numbers by role, text (its first 32 characters, then its
    hash); repeated rows are turns like others. A null or empty role or text is an empty one; a null conv_id
    names no conversation and is left out; a conversation without turns ends at the root; texts of any length
    are hashed whole; an empty table gives no nodes; other columns are not read. One conversation, first turn
    or group of equal conversations may hold any share of the rows.
    """
    rows, convs = rebuilt(conversations)
    named = running(stage_table(rows, "rebuilt"), "conv_id", ["depth"], ["g1", "g2"])
    named = named.select("conv_id", "depth", F.col("g1_after").alias("k1"), F.col("g2_after").alias("k2"), F.col("g1_before").alias("p1"), F.col("g2_before").alias("p2"), "words", "last")
    named = stage_table(named, "prefixes")
    zero = F.lit(0).cast("long")
    nodes = named.groupBy(*_KEY).agg(*[F.min(c).alias(c) for c in ("conv_id", "p1", "p2", "words")], F.count("*").alias("n_convs"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select("conv_id", "n_convs", *[zero.alias(c) for c in (*_KEY, "p1", "p2", "words")]))
    nodes = numbered(nodes, ["conv_id", "depth"], "node")  # a chain's nodes follow one another

    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    below = nodes.where("depth > 0")
    children = below.groupBy(up.alias("k")).agg(F.count("*").alias("n_children")).select("k.*", "n_children")
    nodes = stage_table(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    linked = spread_join(nodes.where("depth > 0").withColumn("up", F.col("depth") - 1), parents, ["up", "p1", "p2"], "n").drop("up")
    none = F.lit(None).cast("long")
    linked = stage_table(linked.unionByName(nodes.where("depth = 0").withColumn("parent", none).withColumn("parent_conv_id", none)), "linked")

    tree = linked.select("node", "parent", F.col("n_children").alias("n"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    ends = named.where("last").select(*_KEY, "conv_id").unionByName(convs.where("n_turns = 0").select(*[zero.alias(c) for c in _KEY], "conv_id"))
    return (
        linked.join(totals, "node").join(_end_hashes(ends), _KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"))
    )
