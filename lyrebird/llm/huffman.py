"""Token-id files under a canonical, length-limited Huffman code from the corpus's own counts.

A file row (segment) holds whole documents in ascending order of their ids. Each document's ids are coded in
blocks; the bit at which each block begins is kept, so that blocks decode independently of one another, and
a reader decodes many at once, one table look-up for each id.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyrebird.llm.tokens import BYTE_BPE, encoder, rank_encoder
from lyrebird.runtime import ship, stage_table

#: Longest code in bits: the decoding table has 2**LIMIT entries.
LIMIT = 18
#: Ids of a block, about so many of a segment, and so many that are counted or coded at once.
BLOCK, SEGMENT, AT_ONCE = 512, 1 << 19, 1 << 18
#: Ids that are sampled for each range of ids.
SAMPLED = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    ranked = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[ranked].astype(np.float64)
    levels, row, is_leaf = [], leaves, np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        row, is_leaf = both[order], order < len(leaves)
    take, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    lengths[ranked] = bits
    return lengths


def canonical(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in the order of (length, id), which is that of the codes; where each code begins among the
    ``limit``-bit numbers, and how many of these it covers."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    covers = np.int64(1) << limit - lengths[order].astype(np.int64)
    return order, np.cumsum(covers) - covers, covers


class Codec:
    """Coding and decoding under one table of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(lengths.max(initial=1)))
        self._table: np.ndarray | None = None
        self._order, first, self._covers = canonical(lengths, self.limit)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self._order] = first >> self.limit - self.lengths[self._order]
        self._coded = self.codes << np.uint64(5) | self.lengths.astype(np.uint64)

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The bits, from a byte's highest down and filled up to a byte, and the bit where each block begins."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        (payload,), (starts,) = self.encode_all(ids, np.array([len(ids)]), block)
        return payload, starts

    def encode_all(self, ids: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[np.ndarray]]:
        """The same for many documents at once: each has sizes[k] (at least one) ids, and begins at a byte."""
        both = self._coded[ids]
        n = both & np.uint64(31)
        ends = np.cumsum(n, dtype=np.int64)
        last = np.cumsum(sizes)
        bits_before = np.concatenate([[0], ends[last - 1]])
        size = np.diff(bits_before) + 7 >> 3
        byte = np.concatenate([[0], np.cumsum(size)])
        ends += np.repeat(8 * byte[:-1] - bits_before[:-1], sizes)
        at = ends.astype(np.uint64) - n
        word = at >> np.uint64(5)
        both >>= np.uint64(5)
        both <<= np.uint64(64) - n - (at & np.uint64(31))
        runs = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out = np.zeros((8 * int(byte[-1]) + 31 >> 5) + 1, np.uint32)
        halves = np.bitwise_or.reduceat(both, runs)
        to = word[runs].astype(np.int64)
        out[to] |= (halves >> np.uint64(32)).astype(np.uint32)
        out[to + 1] |= halves.astype(np.uint32)
        whole = (out.byteswap() if sys.byteorder == "little" else out).tobytes()
        payloads = [whole[a:b] for a, b in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]
        starts = [at[e - s : e : block].astype(np.int64) - 8 * a for s, e, a in zip(sizes.tolist(), last.tolist(), byte[:-1].tolist(), strict=True)]
        return payloads, starts

    def table(self) -> np.ndarray:
        """The id (from bit 5 on) and the code's length (below) for whatever the next ``limit`` bits are."""
        out = np.ones(1 << self.limit, np.uint32)
        n = int(self._covers.sum())
        out[:n] = np.repeat((self._order << 5 | self.lengths[self._order]).astype(np.uint32), self._covers)
        return out

    def decode(self, payload: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of all blocks, one after another: block k has sizes[k] ids from bit starts[k] on."""
        if self._table is None:
            self._table = self.table()
        longest = int(sizes.max(initial=0))
        words = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.uint64)
        windows = words[:-1] << np.uint64(32) | words[1:]
        order = np.argsort(-sizes, kind="stable")  # blocks still at work are always the first ones
        at = starts[order].astype(np.uint64)
        out = np.zeros((longest, len(order)), np.uint32)
        working = len(order) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        top, low, mask = np.uint64(64 - self.limit), np.uint64(31), np.uint64((1 << self.limit) - 1)
        for step, n in enumerate(working):
            p = at[:n]
            found = self._table[windows[p >> np.uint64(5)] >> (top - (p & low)) & mask]
            out[step, :n] = found
            p += found & np.uint32(31)
        inside = np.arange(longest) < sizes[order][:, None]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        rows = np.ascontiguousarray(out.T)[back]
        return rows[inside[back]] >> np.uint32(5)


@lru_cache(maxsize=2)
def _codec(lengths: bytes) -> Codec:
    return Codec(np.frombuffer(lengths, np.uint8))


def _width(path: str) -> str:
    return "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str = BYTE_BPE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a number of the row, and the packed ids of each whole text and its end id."""
    ship(docs.sparkSession)
    width = _width(path)

    @F.arrow_udf("binary")
    def ids_of(texts: pa.Array) -> pa.Array:
        own = rank_encoder(path) if path == BYTE_BPE else encoder(path)
        encode, end = own.encode, end_id.to_bytes(4, "little")
        return pa.array((np.frombuffer(encode(t.as_py()) + end, "<u4").astype(width).tobytes() for t in texts), pa.binary())

    return docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), ids_of(F.col(text_col)).alias("ids"))


def _spans_of(column: pa.Array, width: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed ids of neighbouring documents, about AT_ONCE of them at a time, and how many each document has."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2], width, (ends[-1] - ends[0]) // np.dtype(width).itemsize, ends[0])
    ends = (ends - ends[0]) // np.dtype(width).itemsize
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + AT_ONCE, side="right")) - 1)
        yield ids[ends[first] : ends[last]], np.diff(ends[first : last + 1])
        first = last


def id_counts(coded: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs in all documents; tasks add up their own first."""
    width, size = _width(path), encoder(path).tokenizer.get_vocab_size() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids, _ in _spans_of(batch.column(0), width):
                total += np.bincount(ids, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]  # at most one row for each id of the vocabulary
    return out


def _bucket(df: DataFrame, n: int) -> tuple[Column, int]:
    """Ascending ranges of doc_id, of any type that has an order, that hold about equal counts of documents.

    The cut points are quantiles of a sample of ids of a bounded size. An id that so many rows share that it
    is several cut points is dealt, by the rows' numbers, over all ranges that these bound. Null comes first.
    """
    total = df.count()
    if n < 2 or total < 2:
        return F.lit(0), 1
    share = min(1.0, SAMPLED * n / total)
    drawn = df.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("doc_id").limit(2 * SAMPLED * n).orderBy("doc_id").collect()
    cuts = [drawn[len(drawn) * i // n]["doc_id"] for i in range(1, n)] if drawn else []
    kind = df.schema["doc_id"].dataType
    known = F.array(*[F.lit(c).cast(kind) for c in cuts if c is not None]).cast(T.ArrayType(kind))
    nulls = sum(c is None for c in cuts)
    own = F.col("doc_id")
    first = F.when(own.isNull(), 0).otherwise(nulls + F.size(F.filter(known, lambda c: c < own)))
    last = F.when(own.isNull(), nulls).otherwise(nulls + F.size(F.filter(known, lambda c: c <= own)))
    return (first + F.pmod(F.xxhash64("row", F.lit(1)), last - first + 1)).cast("int"), len(cuts) + 1


def write_files(coded: DataFrame, lengths: Broadcast, width: str, parts: int) -> DataFrame:
    """Code the documents of a tokenised table, bring them into ascending order and write segments."""
    kind = coded.schema["doc_id"].dataType

    @F.arrow_udf("struct<n:long,starts:binary,payload:binary>")
    def code(column: pa.Array) -> pa.Array:
        codec = _codec(lengths.value)
        n, starts, payload = [], [], []
        for ids, sizes in _spans_of(column, width):
            bits, at = codec.encode_all(ids, sizes)
            n += sizes.tolist()
            starts += [a.astype("<u8").tobytes() for a in at]
            payload += bits
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(starts, pa.binary()), pa.array(payload, pa.binary())], ["n", "starts", "payload"])

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("doc_sizes", T.ArrayType(T.LongType())),
        T.StructField("starts", T.BinaryType()), T.StructField("payload", T.BinaryType()),
    ])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, part = 0, [], 0, 0

        def close() -> pa.RecordBatch:
            bits, starts, payload = 0, [], []
            for _, _, at, body in held:
                starts.append(np.frombuffer(at, "<u8") + np.uint64(bits))
                payload.append(body)
                bits += 8 * len(body)
            columns = [[part], [first], [size], [[h[0] for h in held]], [[h[1] for h in held]], [np.concatenate(starts).astype("<u8").tobytes()], [b"".join(payload)]]
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, columns, strict=True)), schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                key = batch.schema.field("doc_id").type
                arrow = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(key)), ("doc_sizes", pa.list_(pa.int64())), ("starts", pa.binary()), ("payload", pa.binary())])
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "starts", "payload", "bucket")), strict=True):
                part = row[4]
                if held and size + row[1] > SEGMENT:
                    yield close()
                    first, held, size = first + size, [], 0
                held.append(row[:4])
                size += row[1]
        if held:
            yield close()

    bucket, n = _bucket(coded, parts)
    rows = coded.select("doc_id", bucket.alias("bucket"), code("ids").alias("c")).select("doc_id", "bucket", "c.*")
    ordered = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("doc_id", "n", "payload")
    return stage_table(ordered.mapInArrow(segments, schema), "ids")


def read_files(files: DataFrame, lengths: Broadcast) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the segments."""
    spark = files.sparkSession
    found = pa.list_(pa.struct([("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    @F.arrow_udf("array<struct<start:long,n_tokens:long,ids_crc32:long>>")
    def checked(sizes: pa.Array, starts: pa.Array, payloads: pa.Array) -> pa.Array:
        codec, out = _codec(lengths.value), []
        for size, at, payload in zip(sizes, starts, payloads, strict=True):
            docs = size.values.to_numpy()
            blocks = -(-docs // BLOCK)
            counts = np.full(int(blocks.sum()), BLOCK)
            counts[np.cumsum(blocks) - 1] = docs - (blocks - 1) * BLOCK
            ids = codec.decode(payload.as_py(), np.frombuffer(at.as_buffer(), "<u8"), counts).astype("<u4")
            ends = np.cumsum(docs).tolist()
            out.append([{"start": e - n, "n_tokens": n, "ids_crc32": zlib.crc32(ids[e - n : e])} for e, n in zip(ends, docs.tolist(), strict=True)])
        return pa.array(out, found)

    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, total = [], 0
    for part, n in totals:  # one row for each file
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    rows = files.select("part", "first", F.arrays_zip("doc_ids", checked("doc_sizes", "starts", "payload").alias("found")).alias("docs"))
    rows = rows.join(offsets, "part").select((F.col("before") + F.col("first")).alias("at"), F.explode("docs").alias("d"))
    return rows.select(F.col("d.doc_ids").alias("doc_id"), (F.col("at") + F.col("d.found.start")).alias("start"), "d.found.n_tokens", "d.found.ids_crc32")


def huffman_ids(docs: DataFrame, path: str = BYTE_BPE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write and read back: doc_id, start, n_tokens, ids_crc32 from the files.

    Null and empty texts are the end id alone; ids may be of any type that has an order; null ids come first,
    repeated ids stand beside one another in no particular order, and one that very many rows share is dealt
    over several files; an empty table gives no rows. A text of any length is encoded whole, and its ids go over
    as many blocks as they need. Other columns are not read.
    """
    spark = docs.sparkSession
    coded = stage_table(tokenised(docs, path, end_id, id_col, text_col), "tokenised")
    lengths = spark.sparkContext.broadcast(code_lengths(id_counts(coded, path)).tobytes())
    files = write_files(coded, lengths, _width(path), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_files(files, lengths)
