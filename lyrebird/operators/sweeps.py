"""Sweeps over range-sorted rows: the next or last row that counts, runs, and chains of successors.

A key may go over as many partitions as it needs: each partition is swept alone and written, and what it lacks
comes from its neighbours, of which one row for each partition goes to the driver. So no key's rows come together
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.runtime import ship, stage_table, unused


def _codes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each run of equal keys, null being a key like others."""
    new = np.zeros(rows.num_rows, bool)
    for k in keys:
        own = pc.dictionary_encode(rows[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.cumsum(new)


def _sorted(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def following(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, backward: bool = False) -> DataFrame:
    """rows with ``name``: the value (a bigint) of the first later row of the same keys that has one.

    Later is in the order of the columns ``order``, nulls first; with ``backward`` it is the nearest earlier
    row's. Null where there is none. Rows alike in keys and order come in any order.
    """
    ship(rows.sparkSession)
    v, part = unused("value", rows), unused("part", rows)
    place = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order]
    swept = _sorted(rows.withColumn(v, value.cast("long")), [*[F.col(k) for k in keys], *place])
    open_ = unused("open", rows)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        code = _codes(table, keys)
        has, n = pc.is_valid(table[v]).to_numpy(zero_copy_only=False), len(code)
        at = np.minimum.accumulate(np.where(has, np.arange(n), n)[::-1])[::-1]
        then = np.append(at[1:], n)
        safe = np.minimum(then, n - 1)
        there = (then < n) & (code[safe] == code)
        values = table[v].combine_chunks()
        head = values[int(at[0])].as_py() if at[0] < n and code[at[0]] == code[0] else None
        role = np.zeros(n, np.int8)
        role[0] |= 1
        role[-1] |= 2
        more = {
            name: pc.if_else(pa.array(there), values.take(pa.array(safe)), None), open_: pa.array(~there & (code == code[-1])), part: pa.array(np.full(n, TaskContext.get().partitionId()), pa.int64()),
            f"{open_}_head": pa.array([head] + [None] * (n - 1), pa.int64()), f"{open_}_role": pa.array(role),
        }
        out = table.drop_columns([v])
        for c, column in more.items():
            out = out.append_column(c, column)
        yield from out.to_batches()

    schema = f"{kinds}, `{name}` long, `{open_}` boolean, `{part}` long, `{open_}_head` long, `{open_}_role` byte"
    placed = stage_table(swept.mapInArrow(sweep, schema), "swept")
    ends = placed.where(F.col(f"{open_}_role") > 0).select(part, f"{open_}_role", f"{open_}_head", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")).collect()
    first = {r[0]: (r["key"], r[2]) for r in ends if r[1] & 1}
    last = {r[0]: r["key"] for r in ends if r[1] & 2}
    carry, key, known = [], None, None
    for p in sorted(first, reverse=True):
        if last[p] == key and known is not None:
            carry.append((p, known))
        whole = first[p][0] == last[p]
        if first[p][1] is not None or not whole or last[p] != key:
            known = first[p][1]
        key = first[p][0]
    spark = rows.sparkSession
    more = F.broadcast(spark.createDataFrame(carry, f"`{part}` long, `{v}` long"))
    met = placed.join(more, part, "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col(open_), F.col(v)).otherwise(F.col(name)).alias(name))


def furthest(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with ``name``: the largest value (a bigint) of the earlier rows of the same keys; null where none has one.

    Earlier is in the order of the columns ``order``, nulls first.
    """
    ship(rows.sparkSession)
    v, part, edge = (unused(c, rows) for c in ("value", "part", "edge"))
    swept = _sorted(rows.withColumn(v, value.cast("long")), [*[F.col(k) for k in keys], *[F.col(c).asc_nulls_first() for c in order]])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        code, n = _codes(table, keys), table.num_rows
        has = pc.is_valid(table[v]).to_numpy(zero_copy_only=False)
        sizes, rank = np.unique(pc.fill_null(table[v], 0).to_numpy(), return_inverse=True)
        wide = len(sizes) + 1
        # a key's rows are above all before them, so one running maximum serves every key; 0 is none
        most = np.maximum.accumulate(code * wide + np.where(has, rank + 1, 0))
        before = np.concatenate([[0], np.where(code[1:] == code[:-1], most[:-1] % wide, 0)])
        out = table.drop_columns([v])
        role = np.where(code == code[0], 1, 0).astype(np.int8)
        role[-1] += 2
        at_end = most[-1] % wide
        columns = {
            name: pa.array(sizes[np.maximum(before - 1, 0)], mask=before == 0), part: pa.array(np.full(n, TaskContext.get().partitionId()), pa.int64()),
            f"{edge}_role": pa.array(role), f"{edge}_end": pa.array([None] * (n - 1) + [int(sizes[at_end - 1]) if at_end else None], pa.int64()),
        }
        for c, column in columns.items():
            out = out.append_column(c, column)
        yield from out.to_batches()

    placed = stage_table(swept.mapInArrow(sweep, f"{kinds}, `{name}` long, `{part}` long, `{edge}_role` byte, `{edge}_end` long"), "swept")
    own = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")
    ends = {r[0]: (r["key"], r[1], r[2]) for r in placed.where(F.col(f"{edge}_role") >= 2).select(part, f"{edge}_role", f"{edge}_end", own).collect()}
    carry, last, most = [], None, None
    firsts = {r[0]: r["key"] for r in placed.where(F.col(f"{edge}_role").isin(1, 3)).groupBy(part).agg(F.min(own).alias("key")).collect()}
    for p in sorted(ends):
        key, role, here = ends[p]
        goes_on = most if firsts[p] == last else None
        if goes_on is not None:
            carry.append((p, goes_on))
        whole = role == 3  # the last row's key is the first one's
        most = max((x for x in (here, goes_on if whole else None) if x is not None), default=None)
        last = key
    more = F.broadcast(rows.sparkSession.createDataFrame(carry, f"`{part}` long, `{v}` long"))
    met = placed.join(more, part, "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col(f"{edge}_role").isin(1, 3), F.greatest(F.col(name), F.col(v))).otherwise(F.col(name)).alias(name))


def chain(rows: DataFrame, key: str, pos: str, next_: str) -> DataFrame:
    """(key, pos): the rows that a key's first one leads to, itself included, by following ``next_`` again and again.

    pos and next_ are bigints, one row for each key and pos; next_ is the pos of a later row of the key, or null.
    In each partition every row learns where its way leaves the partition; only these exits are then followed,
    by doubling jumps, so that rounds grow with the logarithm of the partitions that a key goes over.
    """
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    own = rows.select(F.col(key).alias("k"), F.col(pos).cast("long").alias("p"), F.col(next_).cast("long").alias("n"))

    def hops(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Each row's next one in the partition, or itself; and whether its next one is elsewhere."""
        code, p = _codes(table, ["k"]), table["p"].to_numpy()
        n = pc.fill_null(table["n"], -1).to_numpy()
        has = pc.is_valid(table["n"]).to_numpy(zero_copy_only=False)
        places, rank = np.unique(np.concatenate([p, n]), return_inverse=True)
        wide = len(places) + 1
        mine, wanted = code * wide + rank[: len(p)], code * wide + rank[len(p) :]
        at = np.minimum(np.searchsorted(mine, wanted), len(p) - 1)
        here = has & (mine[at] == wanted)
        return np.where(here, at, np.arange(len(p))), has & ~here

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        hop, leaves = hops(table)
        while True:
            on = hop[hop]
            if (on == hop).all():
                break
            hop = on
        out = pc.if_else(pa.array(leaves[hop]), table["n"].combine_chunks().take(pa.array(hop)), None)
        part = pa.array(np.full(len(hop), TaskContext.get().partitionId()), pa.int64())
        yield from table.append_column("exit", out).append_column("part", part).to_batches()

    placed = stage_table(_sorted(own, ["k", "p"]).mapInArrow(exits, f"k {kind}, p long, n long, exit long, part long"), "exits")
    first = placed.groupBy("k").agg(F.min("p").alias("p"))
    doors = placed.where("exit is not null").select("k", F.col("exit").alias("p")).distinct().unionByName(first).distinct()
    jumps = stage_table(placed.select("k", "p", "exit").join(doors, ["k", "p"]).where("exit is not null"), "jumps")
    reached = stage_table(first, "reached")
    while not jumps.isEmpty():
        more = reached.join(jumps, ["k", "p"]).select("k", F.col("exit").alias("p"))
        reached = stage_table(reached.unionByName(more).distinct(), "reached")
        twice = jumps.select("k", "p", F.col("exit").alias("mid")).join(jumps.select("k", F.col("p").alias("mid"), "exit"), ["k", "mid"])
        jumps = stage_table(twice.select("k", "p", "exit"), "jumps")

    def marked(of: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("p", "ascending")]).combine_chunks()
        hop, _ = hops(table)
        on = pc.fill_null(table["door"], False).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(on):
            while hop[i] != i and not on[hop[i]]:
                i = hop[i]
                on[i] = True
        return table.filter(pa.array(on)).select(["k", "p"])

    met = placed.select("k", "p", "n", "part").join(reached.withColumn("door", F.lit(True)), ["k", "p"], "left")
    return met.groupBy("part").applyInArrow(marked, f"k {kind}, p long").select(F.col("k").alias(key), F.col("p").alias(pos))
