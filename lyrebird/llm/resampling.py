"""Importance resampling towards a target: hashed n-grams by prefix checksums, and a draw with seeded noise.

A document, its words joined by single spaces, is scanned once; the checksum (CRC-32) of everything before each
word's ends is kept. A checksum is linear over GF(2), so that of any run of words follows from two of these: the
one at the run's end, from which the one at its start, shifted by the run's length, cancels what came before.
Each n-gram costs a few table lookups, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.operators.names import numbered
from lyrebird.runtime import ship, stage_table

#: Fixed value: the polynomial of CRC-32, lowest power first.
POLYNOMIAL = 0xEDB88320
#: Bytes of text that are worked on at once; a longer text is cut before a word.
BLOCK = 1 << 20
#: Shifts by fewer bytes have a table each, longer ones take some of these and some by powers of two.
NEAR = 64

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z, and all that is no part of a word to a blank.
_NORMAL = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What one byte adds; shifts by 0 to NEAR - 1 bytes, flat; shifts by NEAR * 2**j bytes. Four lookups, one for each byte of a checksum, make a shift."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    at = np.arange(256, dtype=np.uint32)[None] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    near = []
    for _ in range(NEAR):
        near.append(at)
        at = step[at & 255] ^ (at >> 8)
    far = []
    for _ in range(48):
        far.append(at)
        at = _looked_up(at.ravel(), at.ravel(), 0).reshape(4, 256)
    return step, np.concatenate(near).ravel(), far


def _looked_up(table: np.ndarray, sums: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    out = table[at + (sums & 255)]
    for k in (1, 2, 3):
        out ^= table[at + (256 * k + ((sums >> 8 * k) & 255))]
    return out


def shifted(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums as they stand after as many more zero bytes."""
    _, near, far = _tables()
    out = _looked_up(near, sums, (lengths % NEAR) * 1024)
    rest, j = lengths // NEAR, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _looked_up(far[j].ravel(), out[odd], 0)
        rest, j = rest >> 1, j + 1
    return out


def cut(text: bytes, n: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about BLOCK bytes, normal bytes, each beginning with the last n - 1 words before it, and how many these are."""
    text = text.translate(_NORMAL)
    begin, carried = 0, []
    while begin < len(text) or begin == 0:
        end = len(text) if len(text) - begin <= BLOCK else text.find(b" ", begin + BLOCK)
        end = len(text) if end < 0 else end
        part = text[begin:end]
        yield b" ".join([*carried, part]), len(carried)
        if end == len(text):
            return
        carried = [*carried, *part.split()][-(n - 1) :] if n > 1 else []
        begin = end


def n_grams(parts: list[tuple[bytes, int]], n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of each part, without those carried over, and for runs of 1 to n words the word where each ends with the run's checksum.

    Words are numbered through all parts; the first array has where each part's words begin, and their end.
    """
    text = b" ".join([p for p, _ in parts])
    is_word = np.frombuffer(b" " + text + b" ", np.uint8) != 0x20
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    part_at = np.cumsum([0, *[len(p) + 1 for p, _ in parts]])
    bounds = np.searchsorted(starts, part_at)
    total, held = 0, []
    keep = held.append
    for word in text.split():
        total = crc32(word, total)
        keep(total)
        total = crc32(b" ", total)
    after = np.array(held, np.uint32)
    step = _tables()[0]
    before = np.zeros(len(after), np.uint32)
    register = ~after[:-1]  # a checksum is its register's complement; this adds the blank
    before[1:] = ~(step[(register ^ 0x20) & 255] ^ (register >> 8))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    place = np.arange(len(after)) - np.repeat(bounds[:-1], np.diff(bounds))
    fresh = place >= np.repeat([c for _, c in parts], np.diff(bounds))
    out = []
    for k in range(n):
        at = np.flatnonzero(fresh & (place >= k))
        out.append((at, after[at] ^ shifted(before[at - k], ends[at] - begins[at - k])))
    return bounds, out


def _blocks(texts: Iterable[bytes | None], n: int) -> Iterator[tuple[list[int], list[tuple[bytes, int]]]]:
    """The texts' parts, some at a time, each with its text's place."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in cut(text or b"", n):
            rows.append(row)
            parts.append(part)
            size += len(part[0])
            if size >= BLOCK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (t.as_py() for t in batch.column("text").cast(pa.large_binary()))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = 10_000, n: int = 3) -> dict[int, int]:
    """How many n-grams of all texts fall into each bucket. Each task counts what it reads; at most ``buckets`` rows leave it."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, parts in _blocks(_bytes(batch), n):
                for _, sums in n_grams(parts, n)[1]:
                    held += np.bincount(sums % buckets, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains(docs: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """What one n-gram of each bucket adds to a weight: thousandths of the log ratio of smoothed shares, rounded down."""
    all_docs, all_target = sum(docs.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (all_docs + buckets) / ((docs.get(b, 0) + 1) * (all_target + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row; the gains, one for each bucket, go to every task."""
    ship(docs.sparkSession)
    table = np.array(gain, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for rows, parts in _blocks(_bytes(batch), n):
                bounds, found = n_grams(parts, n)
                each = np.zeros((3, bounds[-1] + 1), np.int64)
                for k, (at, sums) in enumerate(found):
                    each[0, at] += k == 0
                    each[1, at] += 1
                    each[2, at] += table[sums % len(table)]
                upto = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(each, axis=1)], axis=1)[:, bounds]
                for m in range(3):
                    np.add.at(out[m], rows, np.diff(upto[m]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(weigh, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, buckets: int = 10_000, n: int = 3, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Draws ``percent`` of the documents of at least ``least`` words, likelier the more they are like the target.

    Returns for every row doc_id, n_words, n_features, weight, score (the weight and noise that the seed and
    the id decide, so that reruns agree) and rank: 1, 2, 3 and on for the drawn ones, from the highest score,
    ties by the smaller id; null for the others. Drawing without replacement by weights is taking the highest
    scores.

    A null or empty text has no features, the weight 0 and isn't drawn; a null id is hashed as an empty one and
    comes before others in ties; repeated rows each count, and of equal ones any comes first; an empty table
    gives no rows, an empty target even smoothed shares; a text of any length is read whole, in parts; other
    columns are not read. The texts are read twice, once for the counts and once for the weights; all else is
    narrow. Only bucket counts, bounded by ``buckets``, go to the driver.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, n), bucket_counts(target, target_col, buckets, n), buckets)
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = stage_table(weights(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    ranked = numbered(able.withColumn("order", -F.col("score")), ["order", "doc_id"], "place").withColumn("place", F.col("place") + 1)
    out = ranked.select(*scored.columns, F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
    return out.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
