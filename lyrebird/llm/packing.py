"""Bulk-synchronous best-fit packing of token sequences.

Documents and gaps (sequences with room left) are tables. Lengths are taken in bands, the longest first. In a
round, a band's documents and all gaps that are large enough for any of them are range-sorted together by
size, and each partition is swept from its largest size down: a document goes to its successor, the smallest
gap that is no smaller; where several want one gap, the first in the order (size, then row) has it, and what
is left of the gap is offered again to the documents that follow. What finds no partner in its partition waits.
One row for each partition then tells how many tokens wait and how many are open, and documents that wait are
dealt, in the order of their ranks, to the nearest open gaps of the partitions above; each such group is swept
in the same way, and documents that no gap is left for open sequences. The gaps are updated, and the round is
repeated until no document of the band waits. Every round ends in a table in the shared folder.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.tokens import REMEMBERED, WORD_BPE, encoder
from lyrebird.runtime import ship, stage_table

CAPACITY = 2048
#: Documents and gaps of a partition or group, about: what one task sweeps.
ROWS = 1 << 18
#: Lengths over a BANDS-th of the capacity are taken in bands that halve; all shorter ones are the last band.
BANDS = 32
PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
# What a row of a round's table is: a placed document, an open gap, a document that waits, a partition's count.
PLACED, GAP, WAITING, EDGE = range(4)
_STATE = "kind int, row long, size int, sequence long, offset int, part int, before long"
_STATE_ARROW = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("size", pa.int32()), ("sequence", pa.int64()), ("offset", pa.int32()), ("part", pa.int32()), ("before", pa.int64())])


def cut(ids: bytes, capacity: int) -> list[dict]:
    """The pieces of a document's ids: whole if it fits, else cut at multiples of the capacity."""
    width = 4 * capacity
    return [{"piece": k, "start": k * capacity, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for k, part in enumerate(ids[at : at + width] for at in range(0, len(ids), width))]


def pieces(docs: DataFrame, path: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece of each row of docs (its ids and the end id). remembered: as for ``tokens.Encoder``.

    A null or empty text is the end id alone; null and repeated ids and repeated rows give pieces like any
    others; an empty table gives none; a text of any length is encoded whole and cut into as many pieces as it
    needs; other columns are not read. No shuffle.
    """
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    @F.arrow_udf(PIECES)
    def cut_texts(texts: pa.Array) -> pa.Array:
        encode = encoder(path, remembered).encode
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return pa.array([cut(encode(t.as_py()) + end, capacity) for t in texts], kind)

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(cut_texts(F.col(text_col))).alias("p")).select("doc_id", "p.*")


def sweep(sizes: np.ndarray, is_gap: np.ndarray, capacity: int, may_open: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit over rows in descending order of size, a gap before a document of its size.

    Returns, by row: the gap's row that a document goes to (-1: it waits; len(sizes) + k: the k-th sequence
    opened here), the document's offset from that gap's first free place, each gap's free places in the end,
    and the free places of what was opened.
    """
    n = len(sizes)
    home, offset, free = np.full(n, -1, np.int64), np.zeros(n, np.int64), sizes.astype(np.int64)
    opened: list[int] = []
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = 0  # bit s: there is a gap of size s
    size_of, gap_at = sizes.tolist(), is_gap.tolist()
    left: dict[int, int] = {}
    for i in range(n):
        size = size_of[i]
        if gap_at[i]:
            by_size[size].append(i)
            held |= 1 << size
            continue
        fits = held >> size
        if fits:
            at = size + (fits & -fits).bit_length() - 1
            gap = by_size[at].pop()
            if not by_size[at]:
                held ^= 1 << at
        elif may_open:
            at, gap = capacity, n + len(opened)
            opened.append(capacity)
        else:
            continue
        home[i] = gap
        offset[i] = (size_of[gap] if gap < n else capacity) - at
        at -= size
        left[gap] = at
        if at:
            by_size[at].append(gap)
            held |= 1 << at
    for gap, at in left.items():
        if gap < n:
            free[gap] = at
        else:
            opened[gap - n] = at
    return home, offset, free, np.array(opened, np.int64)


def _swept(rows: pa.Table, part: int, capacity: int, may_open: bool) -> pa.Table:
    """A partition's or group's rows after a sweep, and a row of counts.

    What waits, and the gaps that are still as large as the smallest row here, get the tokens before them, in
    the order in which they are dealt: waiting documents from the largest down, gaps from the smallest up.
    """
    size, row, sequence, offset = (rows[c].to_numpy() for c in ("size", "row", "sequence", "offset"))
    is_gap = rows["kind"].to_numpy() == GAP
    home, place, free, opened = sweep(size, is_gap, capacity, may_open)
    n = len(size)
    # an opened sequence is named after the row that opens it
    first = np.full(len(opened), -1, np.int64)
    new = np.flatnonzero(home >= n)
    first[home[new][::-1] - n] = row[new][::-1]
    sequences = np.concatenate([sequence, first])
    offsets = np.concatenate([offset, np.zeros(len(opened), np.int64)])
    out = []

    def emit(kind: int, **columns: np.ndarray) -> None:
        count = len(next(iter(columns.values())))
        out.append(pa.table([pa.array(columns.get(f.name, np.full(count, {"kind": kind, "part": part}.get(f.name, 0))), f.type) for f in _STATE_ARROW], schema=_STATE_ARROW))

    placed = np.flatnonzero(home >= 0)
    emit(PLACED, row=row[placed], size=size[placed], sequence=sequences[home[placed]], offset=offsets[home[placed]] + place[placed])
    gaps = np.flatnonzero(is_gap & (free > 0))
    room = np.concatenate([free[gaps], opened[opened > 0]])
    owner = np.concatenate([sequence[gaps], first[opened > 0]])
    order = np.lexsort((owner, room))
    room, owner = room[order], owner[order]
    # those under the smallest size here are of no use to the partitions below, or rather they stand among these next time
    usable = room >= (size.min() if n else 0)
    before = np.full(len(room), -1, np.int64)
    before[usable] = np.cumsum(room[usable]) - room[usable]
    emit(GAP, size=room, sequence=owner, offset=capacity - room, before=before)
    waiting = np.flatnonzero(~is_gap & (home < 0))
    tokens = np.cumsum(size[waiting], dtype=np.int64)
    emit(WAITING, row=row[waiting], size=size[waiting], before=tokens - size[waiting])
    emit(EDGE, row=np.array([tokens[-1] if len(tokens) else 0]), before=np.array([room[usable].sum()]), size=np.array([len(waiting)]))
    return pa.concat_tables(out)


def dealt(edges: list[tuple[int, int, int, int]], rows: int) -> list[tuple[int, int, int, int, int]]:
    """(group, kind, part, first token, end) from each partition's (part, tokens that wait, documents, open tokens).

    Partitions come from the largest sizes down. What waits in one takes the nearest open gaps above it, as
    in matching brackets, as many tokens as it has; a group has about ``rows`` documents at most. Groups for
    which no gap is left are negative.
    """
    out: list[tuple[int, int, int, int, int]] = []
    above: list[list[int]] = []  # (part, first open token, end), the nearest last
    numbers = {True: 0, False: 0}  # the group that is being filled, with gaps and without
    filled = {True: 0.0, False: 0.0}
    for part, wait, n, free in edges:
        at, each = 0, wait / max(n, 1)
        while at < wait:
            met = bool(above)
            if not numbers[met] or filled[met] >= rows:
                numbers[met], filled[met] = max(numbers.values()) + 1, 0.0
            taken = min(wait - at, max(1, math.ceil((rows - filled[met]) * each)))
            group = numbers[met] if met else -numbers[met]
            if met:
                top = above[-1]
                taken = min(taken, top[2] - top[1])
                out.append((group, GAP, top[0], top[1], top[1] + taken))
                top[1] += taken
                if top[1] == top[2]:
                    above.pop()
            out.append((group, WAITING, part, at, at + taken))
            filled[met] += taken / each
            at += taken
        if free:
            above.append([part, 0, free])
    return out


def _in_order(df: DataFrame, parts: int) -> DataFrame:
    gap_first = F.when(F.col("kind") == GAP, 0).otherwise(1)
    order = [F.desc("size"), gap_first, F.col("row"), F.col("sequence")]
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def pack(parts: DataFrame, capacity: int = CAPACITY, rows: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Null ids, repeated ids and repeated rows are pieces like any others; an empty table gives an empty one.
    Rows of one length are told apart by a number, so a length that a third of all rows share is dealt over
    many partitions. To the driver go counts of lengths (at most ``capacity``) and one row for each partition
    of a round; back go the groups, about as many. ``rows``: documents and gaps of a task.
    """
    rows = rows or ROWS
    spark = parts.sparkSession
    narrow = stage_table(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in narrow.groupBy("length").agg(F.count("*").alias("n")).collect()}
    zero = F.lit(0)
    documents = narrow.select(F.lit(WAITING).alias("kind"), "row", F.col("length").cast("int").alias("size"), zero.cast("long").alias("sequence"), zero.alias("offset"), zero.alias("part"), F.lit(-1).cast("long").alias("before"))
    gaps, n_gaps = spark.createDataFrame([], _STATE), 0
    rounds: list[DataFrame] = []
    for low, high in bands(capacity):
        n = sum(c for size, c in counts.items() if low < size <= high)
        band = documents.where((F.col("size") > low) & (F.col("size") <= high))
        while n:
            partitions = -(-(n + n_gaps) // rows)
            swept = _round(_in_order(band.unionByName(gaps.where(F.col("size") > low)), partitions), capacity, partitions == 1)
            aside = gaps.where(F.col("size") <= low).withColumn("before", F.lit(-1).cast("long"))
            table = stage_table(swept.unionByName(aside), "round")
            rounds.append(table)
            edges, n, n_gaps = _tally(table)
            if n:  # there are several partitions
                marked = _marked(table, dealt(edges, rows))
                untouched = marked.where((F.col("kind") == GAP) & F.col("group").isNull()).select(*table.columns)
                table = stage_table(_grouped(marked, capacity).unionByName(untouched), "round")
                rounds.append(table)
                _, n, n_gaps = _tally(table)
            gaps, band = table.where(F.col("kind") == GAP), table.where(F.col("kind") == WAITING)
    placed = spark.createDataFrame([], "row long, sequence_id long, offset long")
    for table in rounds:
        placed = placed.unionByName(table.where(F.col("kind") == PLACED).select("row", F.col("sequence").alias("sequence_id"), F.col("offset").cast("long").alias("offset")))
    return narrow.join(placed, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high]: the bands of lengths, from the longest down."""
    out, high = [], capacity
    while high > capacity // BANDS and high > 1:
        out.append((high // 2, high))
        high //= 2
    return [*out, (0, high)]


def _round(ordered: DataFrame, capacity: int, may_open: bool) -> DataFrame:
    """One sweep over each range-sorted partition."""
    ship(ordered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield from _swept(rows, rows["part"][0].as_py(), capacity, may_open).to_batches()

    return ordered.mapInArrow(run, _STATE)


def _tally(table: DataFrame) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """What each partition of a round has left, and how many documents wait and gaps are open."""
    held = table.where(F.col("kind") != PLACED).groupBy("kind", F.when(F.col("kind") == EDGE, F.col("part")).alias("part"))
    found = held.agg(F.count("*").alias("n"), F.sum("row").alias("wait"), F.sum("size").alias("documents"), F.sum("before").alias("free")).collect()
    edges = sorted((r["part"], r["wait"], r["documents"], r["free"]) for r in found if r["kind"] == EDGE)
    n = {r["kind"]: r["n"] for r in found if r["kind"] != EDGE}
    return edges, n.get(WAITING, 0), n.get(GAP, 0)


def _marked(table: DataFrame, groups: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The table's rows with the group that each is dealt to, or null; the groups are a few rows for each partition."""
    known = table.sparkSession.createDataFrame(groups, "group long, g_kind int, g_part int, g_first long, g_end long")
    inside = (F.col("kind") == F.col("g_kind")) & (F.col("part") == F.col("g_part")) & (F.col("before") >= F.col("g_first")) & (F.col("before") < F.col("g_end"))
    return table.join(F.broadcast(known), inside, "left")


def _grouped(marked: DataFrame, capacity: int) -> DataFrame:
    """One sweep over each group of waiting documents and the open gaps that were dealt to them.

    A group to which no gap fell, as a larger one reaches over all its tokens, opens sequences.
    """
    ship(marked.sparkSession)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(_STATE_ARROW.names)
        is_gap = rows["kind"].to_numpy() == GAP
        order = np.lexsort((rows["sequence"].to_numpy(), rows["row"].to_numpy(), ~is_gap, -rows["size"].to_numpy()))
        return _swept(rows.take(pa.array(order)), 0, capacity, key[0].as_py() < 0 or not is_gap.any())

    return marked.where("group is not null").groupBy("group").applyInArrow(run, _STATE)
