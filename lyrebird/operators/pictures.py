"""From a picture to its rows: bands of ink, boxes around tokens, symbols by their shape, and symbols over letters.

A picture is a table of its pixel rows: id, y, width (in columns) and words, an array of bigints of 32 columns each,
the lowest bit being the leftmost; set bits are ink. Pixel rows are grouped by picture (or come so: id and pixels, an
array of y, width and words by y) and looked at once, a batch of pictures at a time; what is found there stays a row for
each picture until it is read. A group is one picture or one band, whose size a picture's height and width bound.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.operators.align import clean_sequence
from lyrebird.operators.align import snap_left as snapped
from lyrebird.operators.signals import mask_overlap
from lyrebird.runtime import ship, stage_table

#: Columns in a word.
BITS = 32
# A pixel row has ink from so many pixels or this share of the width on; bands nearer than so many rows are one.
LEAST_INK, INK_SHARE, BAND_GAP = 2, 0.003, 4
# What makes a band sung text (its height, ink of its upper third, covered columns), and the distances of a row above it and of the next one.
SUNG_HEIGHT, SUNG_TOP, SUNG_COVER, ABOVE, NEXT = 8, 0.20, 0.45, 40, 28
# Components nearer than so many columns are one token, in a row of symbols and in a row of names and strokes.
TOKEN_GAP, ROW_GAP = 6, 4
# Shapes are brought to this height and cut to this width; ink is a level above this; what another aspect costs.
SHAPE_HEIGHT, SHAPE_WIDTH, SHAPE_INK, ASPECT_COST = 24, 80, 110, 0.15
# A stroke's score and aspect beside sung text; its overlap and aspect in a row; the score of a symbol there.
STROKE, STROKE_ASPECT, ROW_STROKE, ROW_STROKE_ASPECT, ROW_SYMBOL = 0.45, 0.55, 0.35, 0.6, 0.42

#: Pixel rows of a batch are looked at in pieces of so many words; a shape of at most so many packed bytes is remembered.
PIECE, KEPT_BYTES = 1 << 18, 4096


def _inside(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """(id, y, width, words, b): the pixel rows of each band b (band, start, end)."""
    spans = bands.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("band", "start", "end"))).alias("_bands"))
    within = F.filter("_bands", lambda b: (b["start"] <= F.col("y")) & (F.col("y") < b["end"]))
    return rows.join(spans.hint("merge"), "id").select("id", "y", "width", "words", F.explode(within).alias("b"))


def _words(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Words (rows, words) of pixel rows of any widths, and how many each row has."""
    counts = np.diff(words.offsets.to_numpy())
    flat = words.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    wide = np.zeros((len(counts), max(1, int(counts.max(initial=0)))), "<u4")
    wide[np.arange(wide.shape[1]) < counts[:, None]] = flat
    return wide, counts


def runs_of(pixels: np.ndarray, widths: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of ink, each lengthened by half of ``reach`` at the left and the rest less one at the right, joined where they then meet."""
    edge = np.diff(np.pad(pixels, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.divmod(np.flatnonzero(edge == 1), edge.shape[1])
    last = np.flatnonzero(edge == -1) % edge.shape[1] - 1
    first, last = np.maximum(first - reach // 2, 0), np.minimum(last + (reach - 1) // 2, widths[row] - 1)
    if not len(row):
        return row, first, last
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)])
    at = np.flatnonzero(new)
    return row[at], first[at], last[np.concatenate([at[1:] - 1, [len(row) - 1]])]


def component_boxes(band: np.ndarray, y: np.ndarray, pixels: np.ndarray, widths: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, first, last column) of the connected components of each band's lengthened runs, by band and column.

    The pixel rows come by band and y. Runs of neighbouring rows that share a column are joined: every run takes
    the smallest number that it can reach, halving the way each time.
    """
    row, first, last = runs_of(pixels, widths, reach)
    wide = int(widths.max(initial=1)) + 1
    next_row = np.full(len(band), -1)
    follows = (band[1:] == band[:-1]) & (y[1:] == y[:-1] + 1)
    next_row[:-1][follows] = np.flatnonzero(follows) + 1
    below = next_row[row]
    has = below >= 0
    low = np.searchsorted(row * wide + last, np.where(has, below * wide + first, 0))
    high = np.searchsorted(row * wide + first, np.where(has, below * wide + last, -1), side="right")
    n = np.where(has, np.maximum(high - low, 0), 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(n.sum())
    name = np.arange(len(row))
    while True:
        least = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, name[a], least)
        np.minimum.at(new, name[b], least)
        new = new[new]
        if (new == name).all():
            break
        name = new
    used, of = np.unique(name, return_inverse=True)
    x0, x1 = np.full(len(used), wide), np.full(len(used), -1)
    np.minimum.at(x0, of, first)
    np.maximum.at(x1, of, last)
    at = band[row[used]]
    keep = np.flatnonzero(x1 > x0)
    keep = keep[np.lexsort((x1[keep], x0[keep], at[keep]))]
    return at[keep], x0[keep], x1[keep]


def bands_of(picture: np.ndarray, y: np.ndarray, width: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) pixel row of each band: rows with ink, those less than four rows apart as one. Rows come by picture and y."""
    ink = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    inked = np.flatnonzero(ink > np.maximum(LEAST_INK, np.floor(width * INK_SHARE)))
    p, at = picture[inked], y[inked]
    new = np.ones(len(inked), bool)
    new[1:] = (p[1:] != p[:-1]) | (at[1:] - at[:-1] > BAND_GAP)
    first = np.flatnonzero(new)
    return inked[first], inked[np.append(first[1:], len(inked))[: len(first)] - 1]


def profiles_of(y: np.ndarray, width: np.ndarray, words: np.ndarray, counts: np.ndarray, begins: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StructArray:
    """What band_profiles says of each band, whose pixel rows follow one another from ``begins`` on."""
    ink = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    n = np.diff(np.append(begins, len(y)))
    upper = y < np.repeat(start + np.maximum(1, (end - start) // 3), n)
    columns, wide, held = np.bitwise_or.reduceat(words, begins), np.maximum.reduceat(width, begins), np.maximum.reduceat(counts, begins)
    pixels = np.unpackbits(np.ascontiguousarray(columns).view(np.uint8), axis=1, bitorder="little")
    x0, x1, covered = pixels.argmax(axis=1), pixels.shape[1] - 1 - pixels[:, ::-1].argmax(axis=1), pixels.sum(axis=1, dtype=np.int64)
    top, cover = np.add.reduceat(np.where(upper, ink, 0), begins) / np.add.reduceat(ink, begins), covered / (x1 - x0 + 1)
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(columns[np.arange(columns.shape[1]) < held[:, None]].astype(np.int64)))
    sung = (end - start >= SUNG_HEIGHT) & (top < SUNG_TOP) & (cover > SUNG_COVER)
    own = [pa.array(c, pa.int32()) for c in (start, end, x0, x1, wide)]
    return pa.StructArray.from_arrays([*own, listed, pa.array(top), pa.array(cover), pa.array(covered / wide), pa.array(sung)], fields=list(_BAND))


@lru_cache(1 << 14)
def _kept_shape(packed: bytes, height: int, width: int) -> tuple[bytes, float] | None:
    return shape_of(np.unpackbits(np.frombuffer(packed, np.uint8), count=height * width).reshape(height, width).astype(bool))


def _shape(pixels: np.ndarray) -> tuple[bytes | None, float | None]:
    """shape_of, remembered for small ones, as letters come again and again."""
    packed = np.packbits(pixels).tobytes()
    return (_kept_shape(packed, *pixels.shape) if len(packed) <= KEPT_BYTES else shape_of(pixels)) or (None, None)


def tokens_of(y: np.ndarray, pixels: np.ndarray, widths: np.ndarray, begins: np.ndarray, reach: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The band of each token, by band and column, and its x0, x1, bits and aspect; a band's pixel rows follow one another from ``begins`` on."""
    ends = np.append(begins[1:], len(y))
    at, x0, x1 = component_boxes(np.repeat(np.arange(len(begins)), ends - begins), y, pixels, widths, reach)
    shapes = [_shape(pixels[f:e, a : b + 1]) for f, e, a, b in zip(begins[at].tolist(), ends[at].tolist(), x0.tolist(), x1.tolist(), strict=True)]
    return at, [pa.array(x0, pa.int32()), pa.array(x1, pa.int32()), pa.array([b for b, _ in shapes], pa.binary()), pa.array([a for _, a in shapes], pa.float64())]


def _starts(names: np.ndarray, n: int) -> pa.Array:
    """Offsets of n lists, given the list of each item, in order."""
    return pa.array(np.append(0, np.cumsum(np.bincount(names, minlength=n))), pa.int32())


def pieces(held: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pictures, from the i-th up to the j-th, that have about PIECE words, or are one picture; held[i]: the words before the i-th."""
    i = 0
    while i < len(held) - 1:
        j = max(i + 1, int(np.searchsorted(held, held[i] + PIECE, side="right")) - 1)
        yield i, j
        i = j


_BAND = pa.struct([*[(c, pa.int32()) for c in ("start", "end", "x0", "x1", "width")], ("columns", pa.list_(pa.int64())), ("top", pa.float64()), ("cover", pa.float64()), ("fill", pa.float64()), ("sung", pa.bool_())])
_TOKEN = pa.struct([("band", pa.int32()), ("reach", pa.int32()), ("token", pa.int32()), ("x0", pa.int32()), ("x1", pa.int32()), ("bits", pa.binary()), ("aspect", pa.float64())])
_SEEN = "struct<bands:array<struct<start:int,end:int,x0:int,x1:int,width:int,columns:array<bigint>,top:double,cover:double,fill:double,sung:boolean>>,tokens:array<struct<band:int,reach:int,token:int,x0:int,x1:int,bits:binary,aspect:double>>>"


def seen(rows: DataFrame, reaches: tuple[int, ...] = (), sung: bool = True) -> DataFrame:
    """(id, bands, tokens): each picture's bands and, for each reach, their tokens, all in one pass over its pixel rows.

    A picture's pixel rows come together in a row; rows that are dealt by id already aren't shuffled for that.
    Without ``sung`` the tokens of sung bands are left out.
    """
    ship(rows.sparkSession)

    @F.arrow_udf(_SEEN)
    def look(pictures: pa.Array) -> pa.Array:
        flat, ends = pictures.flatten(), np.concatenate([[0], np.cumsum(np.diff(pictures.offsets.to_numpy()))])
        out = [_look(flat.slice(ends[i], ends[j] - ends[i]), ends[i : j + 1] - ends[i], reaches, sung) for i, j in pieces(flat.field("words").offsets.to_numpy()[ends])]
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("bands", pa.list_(_BAND)), ("tokens", pa.list_(_TOKEN))]))

    if "pixels" in rows.columns:
        held = rows.where("id is not null")
    else:
        held = rows.where("id is not null and words is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("y", "width", "words"))).alias("pixels"))
    return held.select("id", look("pixels").alias("s")).select("id", "s.bands", "s.tokens")


def _look(rows: pa.StructArray, ends: np.ndarray, reaches: tuple[int, ...], sung: bool) -> pa.StructArray:
    y, width, listed = (c.to_numpy() if c.type != pa.list_(pa.int64()) else c for c in rows.flatten())
    words, counts = _words(listed)
    picture, n = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), len(ends) - 1
    first, last = bands_of(picture, y, width, words)
    size = last - first + 1
    begins = np.cumsum(size) - size
    own = np.repeat(first - begins, size) + np.arange(size.sum())
    y, width, words, counts, of = y[own], width[own], words[own], counts[own], picture[first]
    none = pa.array([], _BAND)
    bands = profiles_of(y, width, words, counts, begins, y[begins], y[begins + size - 1] + 1) if len(of) else none
    number = np.arange(len(of)) - np.searchsorted(of, of) + 1
    if not sung:
        plain = ~bands.field("sung").to_numpy(zero_copy_only=False)
        kept = np.repeat(plain, size)
        y, words, counts, size, of, number = y[kept], words[kept], counts[kept], size[plain], of[plain], number[plain]
        begins = np.cumsum(size) - size
    pixels = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(bool)
    met = [pa.array([], _TOKEN)]
    names = [np.zeros(0, np.int64)]
    for reach in reaches if len(of) else ():
        at, found = tokens_of(y, pixels, counts * BITS, begins, reach)
        place = np.arange(len(at)) - np.searchsorted(at, at) + 1
        met.append(pa.StructArray.from_arrays([pa.array(number[at], pa.int32()), pa.array(np.full(len(at), reach), pa.int32()), pa.array(place, pa.int32()), *found], fields=list(_TOKEN)))
        names.append(of[at])
    name = np.concatenate(names)
    order = np.argsort(name, kind="stable")
    tokens = pa.concat_arrays(met).take(pa.array(order))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(_starts(picture[first], n), bands), pa.ListArray.from_arrays(_starts(name, n), tokens)], names=["bands", "tokens"])


def seen_bands(looks: DataFrame) -> DataFrame:
    """band_profiles, of what ``seen`` gives."""
    return looks.select("id", F.posexplode("bands").alias("at", "b")).select("id", (F.col("at") + 1).alias("band"), "b.*")


def seen_tokens(looks: DataFrame, reach: int = TOKEN_GAP) -> DataFrame:
    """tokens, of what ``seen`` gives."""
    return looks.select("id", F.explode("tokens").alias("t")).where(F.col("t.reach") == reach).select("id", "t.*").drop("reach")


def band_profiles(rows: DataFrame) -> DataFrame:
    """(id, band, start, end, x0, x1, width, columns, top, cover, fill, sung) of each band from the top, the first being 1.

    x0, x1: its outermost columns with ink; columns: words with a bit for each column with ink; top: the share of
    ink in its upper third; cover: the share of columns with ink from x0 to x1; fill: of all columns; sung:
    whether it looks like a line of text whose letters stand low, as sung lines do beside names of symbols.
    """
    return seen_bands(seen(rows))


def tokens(bands: DataFrame, rows: DataFrame, reach: int = TOKEN_GAP) -> DataFrame:
    """(id, band, token, x0, x1, bits, aspect): each band's tokens from the left, the first being 1, with their shapes.

    Tokens are connected components (sides, not corners) of ink lengthened to both sides, so that what is less
    than ``reach`` columns apart is one; those of a single column are none. A token's shape is all the ink of
    the band between its columns; it is null where there is none.
    """
    ship(bands.sparkSession)
    kind = [("x0", pa.int32()), ("x1", pa.int32()), ("bits", pa.binary()), ("aspect", pa.float64())]

    @F.arrow_udf("array<struct<x0:int,x1:int,bits:binary,aspect:double>>")
    def found(bands: pa.Array) -> pa.Array:
        rows, ends = bands.flatten(), np.concatenate([[0], np.cumsum(np.diff(bands.offsets.to_numpy()))])
        out = [pa.array([], pa.list_(pa.struct(kind)))]
        for i, j in pieces(rows.field("words").offsets.to_numpy()[ends]):
            some = rows.slice(ends[i], ends[j] - ends[i])
            words, counts = _words(some.field("words"))
            pixels = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(bool)
            at, held = tokens_of(some.field("y").to_numpy(), pixels, counts * BITS, ends[i:j] - ends[i], reach)
            out.append(pa.ListArray.from_arrays(_starts(at, j - i), pa.StructArray.from_arrays(held, names=[k for k, _ in kind])))
        return pa.concat_arrays(out)

    held = _inside(rows, bands).groupBy("id", F.col("b.band").alias("band")).agg(F.array_sort(F.collect_list(F.struct("y", "words"))).alias("pixels"))
    return held.select("id", "band", F.posexplode(found("pixels")).alias("token", "t")).select("id", "band", (F.col("token") + 1).alias("token"), "t.*")


@lru_cache(4096)
def _resampler(before: int, after: int) -> np.ndarray:
    """Weights (after, before) of a windowed sinc with three lobes, widened where pixels are drawn together."""
    scale = before / after
    wide = max(scale, 1.0)
    centre = (np.arange(after) + 0.5) * scale
    at = (np.arange(before) + 0.5 - centre[:, None]) / wide
    weight = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def shape_of(pixels: np.ndarray) -> tuple[bytes, float] | None:
    """A shape's ink, cut to its box, brought to the common height and packed, and its aspect; None without ink."""
    ys, xs = np.flatnonzero(pixels.any(axis=1)), np.flatnonzero(pixels.any(axis=0))
    if not len(xs):
        return None
    cut = pixels[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    h, w = cut.shape
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(cut * 255.0 @ _resampler(w, max(1, round(w * SHAPE_HEIGHT / h))).T)
    ink = level(_resampler(h, SHAPE_HEIGHT) @ across) > SHAPE_INK
    canvas = np.zeros((SHAPE_HEIGHT, SHAPE_WIDTH), bool)
    canvas[:, : ink.shape[1]] = ink[:, :SHAPE_WIDTH]
    return np.packbits(canvas).tobytes(), w / h


def best_match(bits: np.ndarray, aspect: float, known: np.ndarray, counts: np.ndarray, aspects: np.ndarray) -> tuple[int, float, int]:
    """(which, score, compared) of the known shapes (packed, with counts of bits and aspects) that a shape is most like; of equal ones the first.

    The score is the overlap (intersection over union) less what another aspect costs. No overlap can be over
    the smaller count of bits divided by the larger: shapes are compared from the highest such bound on, until
    none that is left can win.
    """
    cost = ASPECT_COST * np.abs(np.log((aspect + 0.01) / (aspects + 0.01)))
    own = int(np.bitwise_count(bits).sum())
    bound = np.minimum(counts, own) / np.maximum(np.maximum(counts, own), 1) - cost
    best, score, compared = -1, -math.inf, 0
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] < score - 1e-12:
            break
        both = int(np.bitwise_count(known[k] & bits).sum())
        here = both / max(int(counts[k]) + own - both, 1) - cost[k]
        compared += 1
        if here > score or here == score and k < best:
            best, score = int(k), float(here)
    return best, score, compared


def matched(found: DataFrame, palettes: DataFrame) -> DataFrame:
    """found (tokens: id, bits, aspect and more) with name, score and compared: the best of the picture's palette.

    palettes: id, n (a symbol's place), name, bits, aspect. A token without ink, or of a picture without a
    palette, has no name and the score 0. A picture's palette is one row.
    """
    ship(found.sparkSession)

    @F.arrow_udf("struct<name:string,score:double,compared:int>")
    def match(bits: pa.Array, aspects: pa.Array, palettes: pa.Array) -> pa.Array:
        flat, ends = palettes.flatten(), np.concatenate([[0], np.cumsum(np.diff(palettes.offsets.to_numpy()))]).tolist()
        names, shapes, wide = (flat.field(c).to_pylist() for c in ("name", "bits", "aspect"))
        out = []
        for k, (own, aspect) in enumerate(zip(bits.to_pylist(), aspects.to_pylist(), strict=True)):
            a, b = ends[k], ends[k + 1]
            at, score, compared = _kept_match(own, aspect, tuple(shapes[a:b]), tuple(wide[a:b])) if own and b > a else (None, 0.0, 0)
            out.append((None if at is None else names[a + at], score, compared))
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int32())], names=["name", "score", "compared"])

    listed = palettes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "name", "bits", "aspect"))).alias("_palette"))
    return found.join(listed.hint("merge"), "id", "left").withColumn("_m", match("bits", "aspect", F.coalesce("_palette", F.array().cast(listed.schema["_palette"].dataType)))).select(*found.columns, "_m.*")


@lru_cache(1 << 12)
def _kept_match(own: bytes, aspect: float, shapes: tuple[bytes, ...], aspects: tuple[float, ...]) -> tuple[int, float, int]:
    """best_match, remembered, as the same symbols and palettes come again."""
    packed = np.frombuffer(b"".join(shapes), np.uint8).reshape(len(shapes), -1)
    return best_match(np.frombuffer(own, np.uint8), aspect, packed, np.bitwise_count(packed).sum(axis=1, dtype=np.int64), np.array(aspects))


def stroke_overlap(found: DataFrame, stroke: tuple[bytes, float]) -> DataFrame:
    """found (tokens) with overlap, that with a thin tall stroke's shape, and likeness, which counts its aspect too."""
    bits, aspect = stroke
    alike = F.abs(F.log((F.col("aspect") + 0.01) / F.lit(aspect + 0.01)))
    return found.withColumn("overlap", mask_overlap(F.col("bits"), F.lit(bits))).withColumn("likeness", F.col("overlap") - ASPECT_COST * alike)


@lru_cache(1 << 12)
def _kept_overlap(bits: bytes | None, stroke: bytes) -> float:
    """mask_overlap of one shape, remembered."""
    a, b = (int.from_bytes(m, "little") for m in (bits or b"", stroke))
    return (a & b).bit_count() / (a | b).bit_count() if a | b else 1.0


def _is_stroke(bits: bytes | None, aspect: float | None, stroke: tuple[bytes, float]) -> bool:
    """Whether a token is a stroke; a band that has one stands alone, not above sung text."""
    if aspect is None or aspect >= STROKE_ASPECT:
        return False
    return _kept_overlap(bits, stroke[0]) - ASPECT_COST * abs(math.log((aspect + 0.01) / (stroke[1] + 0.01))) > STROKE


def _named(bits: bytes | None, aspect: float | None, palette: list[tuple[str, bytes, float]]) -> tuple[str | None, float]:
    """What ``matched`` says of one token."""
    if not bits or not palette:
        return None, 0.0
    at, score, _ = _kept_match(bits, aspect, tuple(p[1] for p in palette), tuple(p[2] for p in palette))
    return palette[at][0], score


def sequence_of(found: list[tuple], palette: list[tuple[str, bytes, float]], stroke: tuple[bytes, float]) -> str:
    """A row of symbols in brackets and strokes, from the left; what is like neither is left out. found: its tokens (x0, bits, aspect)."""
    out = []
    for _, bits, aspect in found:
        if aspect is not None and aspect < ROW_STROKE_ASPECT and _kept_overlap(bits, stroke[0]) > ROW_STROKE:
            out.append("/")
            continue
        name, score = _named(bits, aspect, palette)
        if score > ROW_SYMBOL and name is not None:
            out.append(f"[{name}]")
    return " ".join(out)


def letters_under(line: str, widths: dict[str, int], x0: int, x1: int, lefts: list[int]) -> list[int] | None:
    """The place in the line of the letter under each column of ``lefts``; None if no letter can be set.

    The line's letters are set one after another (blanks aren't, nor letters that the font lacks) and drawn to
    the band's width. Both profiles then have as many columns, and as an alignment gives each column of the one
    a column of its own of the other, in order, each meets the one at its place: ``align.gap_align`` has no other path.
    """
    places = [k for k, c in enumerate(line) if c != " " and c in widths]
    starts = [0, *accumulate(widths[line[k]] for k in places)]
    if not starts[-1]:
        return None
    ratio = (x1 - x0 + 1) / starts[-1]
    return [places[max(0, min(bisect_right(starts, min(max(x, x0), x1) - x0, key=lambda s: s * ratio) - 1, len(places) - 1))] for x in lefts]


def read_picture(bands: list[tuple], found: list[tuple], lines: list[str], palette: list[tuple[str, bytes, float]], widths: dict[str, int], stroke: tuple[bytes, float]) -> tuple[list[tuple], list[tuple]]:
    """One picture's symbols over sung lines (sung, token, char, symbol, score) and its rows of symbols (after, n, seq).

    The k-th sung band shows the k-th sung line. The row above it is the nearest band without strokes that isn't
    sung, if no sung band is between and it is less than 40 rows away. A band that isn't sung is a row of its
    own, after so many sung bands, unless a sung band follows in less than 28 rows and it has no strokes.
    bands: (start, end, x0, x1, sung) from the top; found: tokens (band, reach, x0, bits, aspect) of bands that
    aren't sung, from the left; palette: (name, bits, aspect); widths: each letter's columns.
    """
    by: dict[tuple[int, int], list[tuple]] = {}
    for band, reach, *token in found:
        by.setdefault((band, reach), []).append(token)
    placed, rows, sung, above = [], [], 0, None
    for n, (start, end, x0, x1, is_sung) in enumerate(bands, 1):
        if is_sung:
            if above and start - above[1] < ABOVE and sung < len(lines):
                over = by.get((above[0], TOKEN_GAP), [])
                chars = letters_under(lines[sung], widths, x0, x1, [x for x, _, _ in over])
                if chars is not None:
                    placed += [(sung, k, char, *_named(bits, aspect, palette)) for k, (char, (_, bits, aspect)) in enumerate(zip(chars, over, strict=True), 1)]
            sung, above = sung + 1, None
            continue
        has_stroke = any(_is_stroke(bits, aspect, stroke) for _, bits, aspect in by.get((n, TOKEN_GAP), []))
        follows = n < len(bands) and bands[n][4] and bands[n][0] - end < NEXT
        if has_stroke or not follows:
            rows.append((sung, n, sequence_of(by.get((n, ROW_GAP), []), palette, stroke)))
        if not has_stroke:
            above = n, end
    return placed, rows


_READ = "struct<placed:array<struct<sung:int,token:int,char:int,symbol:string,score:double>>,rows:array<struct<after:bigint,n:int,seq:string>>>"
_PLACED = pa.struct([("sung", pa.int32()), ("token", pa.int32()), ("char", pa.int32()), ("symbol", pa.string()), ("score", pa.float64())])
_ROW = pa.struct([("after", pa.int64()), ("n", pa.int32()), ("seq", pa.string())])


def _listed(lists: pa.ListArray, *fields: str) -> Iterator[list[tuple]]:
    """Each list's structs as tuples of the fields."""
    flat, ends = lists.flatten(), np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()))).tolist()
    all_ = list(zip(*(flat.field(f).to_pylist() for f in fields), strict=True))
    return (all_[a:b] for a, b in zip(ends, ends[1:]))  # noqa: B905


def _as_lists(lists: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    columns = list(zip(*(x for own in lists for x in own), strict=True)) or [()] * kind.num_fields
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(own) for own in lists])), pa.int32()), flat)


def read_pictures(rows: DataFrame, lines: DataFrame, palettes: DataFrame, font: DataFrame, stroke: tuple[bytes, float], script: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What pictures show of their songs: bands, placements (id, sung, token, char, symbol, score), and rows of symbols (id, after, n, seq), for ``assemble`` and ``align_report``.

    lines: id, line_no, line, of which those with a letter of the script are sung, in the order of the picture's
    sung bands. palettes: as ``matched`` takes them. font: letter, columns (array of 0 and 1, as wide as the
    letter with its space), a row for each character at most; their widths go to all tasks. A picture is read in
    one row with its sung lines and palette, as read_picture says.
    """
    ship(rows.sparkSession)
    widths = {r["letter"]: r["n"] for r in font.select("letter", F.size("columns").alias("n")).collect()}

    @F.arrow_udf(_READ)
    def read(bands: pa.Array, found: pa.Array, lines: pa.Array, palettes: pa.Array) -> pa.Array:
        each = zip(_listed(bands, "start", "end", "x0", "x1", "sung"), _listed(found, "band", "reach", "x0", "bits", "aspect"), lines.to_pylist(), _listed(palettes, "name", "bits", "aspect"), strict=True)
        out = [read_picture(*one, widths, stroke) for one in each]
        return pa.StructArray.from_arrays([_as_lists([p for p, _ in out], _PLACED), _as_lists([r for _, r in out], _ROW)], names=["placed", "rows"])

    sung = lines.where(F.rlike("line", F.lit(f"[{script}]"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    listed = palettes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "name", "bits", "aspect"))).alias("_palette"))
    looks = seen(rows, (TOKEN_GAP, ROW_GAP), sung=False)
    met = looks.join(sung.select("id", F.transform("_l", lambda l: l["line"]).alias("lines")).hint("merge"), "id", "left").join(listed.hint("merge"), "id", "left")
    own = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("lines", "array<string>"), ("_palette", listed.schema["_palette"].dataType))]
    held = met.select("id", "bands", "tokens", *own).withColumn("_r", read("bands", "tokens", "lines", "_palette")).select("id", "bands", "lines", "_r.*")
    held = stage_table(held, "read")
    placed = held.select("id", "lines", F.explode("placed").alias("p")).select("id", "p.*", F.get("lines", F.col("p.sung")).alias("line"))
    between = held.select("id", F.explode("rows").alias("r")).select("id", "r.*").withColumn("seq", clean_sequence(F.col("seq"))).where("seq != ''")
    return seen_bands(held), placed.select("id", "sung", "token", snapped(F.col("line"), F.col("char")).alias("char"), "symbol", F.round("score", 2).alias("score")), between
