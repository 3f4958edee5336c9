"""Pictures against the plain way: flood fill, all pairs, and lines aligned by hand."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.operators import align, pictures
from lyrebird.plans.pictures import bitmap, drawn, songs
from lyrebird.plans.registry import QUERIES, Tables

ROWS = "id long, y int, width int, words array<bigint>"


def as_rows(i, ink):
    """A picture as pixel rows."""
    wide = -(-ink.shape[1] // 32)
    full = np.zeros((len(ink), wide * 32), bool)
    full[:, : ink.shape[1]] = ink
    return [(i, y, ink.shape[1], [sum(1 << k for k in range(32) if r[w * 32 + k]) for w in range(wide)]) for y, r in enumerate(full)]


def flooded(ink, reach):
    """Boxes of components by flood fill over the widened picture."""
    h, w = ink.shape
    w = -(-w // 32) * 32
    wide = np.zeros((h, w), bool)
    for y, x in zip(*np.nonzero(ink), strict=True):
        wide[y, max(0, x - reach // 2) : x + (reach - 1) // 2 + 1] = True
    seen, out = np.zeros_like(wide), []
    for start in zip(*np.nonzero(wide), strict=True):
        if seen[start]:
            continue
        stack, xs = [start], []
        seen[start] = True
        while stack:
            y, x = stack.pop()
            xs.append(x)
            for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= v < h and 0 <= u < w and wide[v, u] and not seen[v, u]:
                    seen[v, u] = True
                    stack.append((v, u))
        if max(xs) > min(xs):
            out.append((int(min(xs)), int(max(xs))))
    return sorted(out)


@pytest.mark.parametrize("reach", [1, 4, 6])
def test_boxes_are_those_of_a_flood_fill(spark, reach):
    rng = np.random.default_rng(reach)
    inks = [rng.random((int(rng.integers(1, 25)), int(rng.integers(1, 150)))) < p for p in (0.02, 0.05, 0.1, 0.2, 0.4) for _ in range(6)]
    spiral = np.zeros((21, 90), bool)
    for k in range(0, 10, 4):
        spiral[k, k * 4 : 90 - k * 4] = spiral[20 - k, k * 4 : 90 - k * 4] = True
        spiral[k : 21 - k, 89 - k * 4] = True
    inks += [spiral, np.zeros((3, 40), bool), np.ones((4, 33), bool)]
    rows = spark.createDataFrame([r for i, ink in enumerate(inks) for r in as_rows(i, ink)], ROWS).repartition(3)
    bands = spark.createDataFrame([(i, 1, 0, len(ink)) for i, ink in enumerate(inks)], "id long, band int, start int, end int")
    got = {}
    for r in pictures.tokens(bands, rows, reach).orderBy("id", "token").collect():
        got.setdefault(r.id, []).append((r.x0, r.x1))
    assert got == {i: flooded(ink, reach) for i, ink in enumerate(inks) if flooded(ink, reach)}


def test_best_match_is_that_of_all_pairs_and_skips_most():
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFG0123456789"
    words = ["".join(rng.choice(list(letters), int(n))) for n in rng.integers(1, 9, 80)]
    known = [pictures.shape_of(bitmap(w)) for w in words]
    packed = np.array([np.frombuffer(b, np.uint8) for b, _ in known])
    counts, aspects = np.bitwise_count(packed).sum(axis=1, dtype=np.int64), np.array([a for _, a in known])
    tried = 0
    for w in words + ["".join(rng.choice(list(letters), 3)) for _ in range(60)]:
        ink = bitmap(w)
        ink ^= rng.random(ink.shape) < 0.03
        bits, aspect = pictures.shape_of(ink)
        own = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        scores = []
        for b, a in known:
            other = np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool)
            scores.append((own & other).sum() / (own | other).sum() - 0.15 * abs(math.log((aspect + 0.01) / (a + 0.01))))
        k, score, compared = pictures.best_match(np.frombuffer(bits, np.uint8), aspect, packed, counts, aspects)
        assert score == pytest.approx(max(scores)) and scores[k] == pytest.approx(max(scores))
        tried += compared
    assert tried < 0.35 * 140 * len(words)


def test_bands_by_rows(spark):
    ink = np.zeros((60, 100), bool)
    ink[3:5, 10:40] = ink[8:10, 20:60] = True  # three rows between: one band
    ink[20:24, 5:9] = True
    ink[28:40, 50:99:2] = True  # four rows between: another
    ink[50, 7:9] = True  # too little ink
    (a, b, c) = pictures.band_profiles(spark.createDataFrame(as_rows(1, ink) + as_rows(2, ink[:2]), ROWS)).orderBy("start").collect()
    assert [(r.id, r.band, r.start, r.end, r.x0, r.x1) for r in (a, b, c)] == [(1, 1, 3, 10, 10, 59), (1, 2, 20, 24, 5, 8), (1, 3, 28, 40, 50, 98)]
    assert (a.top, a.cover, a.fill, a.sung) == (60 / 140, 1.0, 0.5, False) and (b.top, b.cover) == (0.25, 1.0)
    assert c.cover == pytest.approx(25 / 49) and c.top == pytest.approx(4 / 12) and not c.sung


def test_empty_pictures_and_palettes(spark):
    ink = bitmap("Am")
    rows = spark.createDataFrame(as_rows(1, ink) + as_rows(2, np.zeros((9, 40), bool)), ROWS)
    bands = pictures.band_profiles(rows)
    found = pictures.stroke_overlap(pictures.tokens(bands, rows), pictures.shape_of(np.ones((12, 1), bool)))
    none = spark.createDataFrame([], "id long, n int, name string, bits binary, aspect double")
    assert [(r.id, r.name, r.score, r.compared) for r in pictures.matched(found, none).collect()] == [(1, None, 0.0, 0)]
    assert pictures.band_profiles(rows.limit(0)).collect() == [] and pictures.tokens(bands.limit(0), rows).collect() == []


def test_a_shape_keeps_its_size_and_form():
    bits, aspect = pictures.shape_of(np.pad(np.ones((24, 10), bool), 7))
    canvas = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(24, 80).astype(bool)
    assert aspect == 10 / 24 and canvas[:, :10].all() and not canvas[:, 10:].any()
    half = np.unpackbits(np.frombuffer(pictures.shape_of(np.repeat(np.repeat(bitmap("F#"), 4, 0), 4, 1))[0], np.uint8))
    same = np.unpackbits(np.frombuffer(pictures.shape_of(bitmap("F#"))[0], np.uint8))
    assert (half & same).sum() / (half | same).sum() > 0.9
    assert pictures.shape_of(np.zeros((5, 5), bool)) is None


def test_rows_above_and_rows_between(spark):
    """A row with a stroke stands alone even right above a sung line; one too far above isn't a line's."""

    def text(ink, y, word, x=0):
        ink[y : y + 12, x : x + 8 * len(word)] |= bitmap(word)

    near, far = np.zeros((140, 200), bool), np.zeros((140, 200), bool)
    text(near, 0, "C"), text(near, 20, "G/D"), text(near, 40, "somewhat"), text(near, 60, "D"), text(near, 80, "longerword")
    near[20:32, 80:81] = True
    text(far, 0, "C"), text(far, 60, "somewhat")
    rows = spark.createDataFrame(as_rows(1, near) + as_rows(2, far), ROWS)
    lines = spark.createDataFrame([(i, n, s) for i in (1, 2) for n, s in enumerate(["somewhat", "(*)", "longerword"])], "id long, line_no int, line string")
    shapes = [(i, n, s, bytearray(pictures.shape_of(bitmap(s))[0]), pictures.shape_of(bitmap(s))[1]) for i in (1, 2) for n, s in enumerate(["C", "D", "G"])]
    palettes = spark.createDataFrame(shapes, "id long, n int, name string, bits binary, aspect double")
    letters = spark.createDataFrame([(c, [1, 1, 1, 1, 1, 0, 0, 0]) for c in "abcdefghijklmnopqrstuvwxyz"], "letter string, columns array<int>")
    bands, placed, between = pictures.read_pictures(rows, lines, palettes, letters, pictures.shape_of(np.ones((12, 1), bool)), "a-z")
    assert [r.sung for r in bands.where("id = 1").orderBy("band").collect()] == [False, False, True, False, True]
    assert sorted((r.id, r.sung, r.char, r.symbol) for r in placed.collect()) == [(1, 0, 0, "C"), (1, 1, 0, "D")]
    assert {(r.id, r.after) for r in between.collect()} >= {(2, 0)}
    assert bands.select(F.max("band")).first()[0] == 5


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_only_small_tables_are_broadcast(spark):
    """Tables with rows for each picture are joined by sorting: only the known shapes and the font go to the driver."""
    for name in ("picture_symbols", "picture_placements"):
        keys = re.findall(r"BroadcastHashJoin \[(\w+)#", _plan(QUERIES[name](spark, "/root/testdata/sf0.001")))
        assert set(keys) <= {"name", "letter"}


def test_pixel_rows_are_gathered_once(spark):
    """Parts are dealt before they are drawn, and each picture's pixel rows come together in one shuffle."""
    assert len(re.findall(r"\bExchange\b", _plan(QUERIES["picture_tokens"](spark, "/root/testdata/sf0.001")))) <= 2


def test_one_pass_gives_what_bands_and_tokens_give(spark):
    rng = np.random.default_rng(3)
    inks = [rng.random((int(rng.integers(1, 60)), int(rng.integers(1, 200)))) < p for p in (0.0, 0.01, 0.05, 0.3) for _ in range(4)]
    rows = spark.createDataFrame([r for i, ink in enumerate(inks) for r in as_rows(i, ink)], ROWS).repartition(3)
    bands, looks = pictures.band_profiles(rows), pictures.seen(rows, (4, 6))
    for reach in (4, 6):
        want = sorted(map(tuple, pictures.tokens(bands, rows, reach).collect()))
        assert want and sorted(map(tuple, pictures.seen_tokens(looks, reach).collect())) == want


def test_letters_under_columns_are_those_of_the_alignment():
    """Profiles as wide as one another have one alignment, column by column; so the letter is the one whose columns a place falls on."""
    rng = np.random.default_rng(11)
    widths = {"a": 3, "b": 8, "c": 5, "d": 0, "e": 1}
    for _ in range(60):
        line, x0, wide = "".join(rng.choice(list("abcde xy"), int(rng.integers(1, 12)))), int(rng.integers(0, 9)), int(rng.integers(1, 70))
        own = [(k, widths[c]) for k, c in enumerate(line) if c in widths]
        size = sum(w for _, w in own)
        lefts = rng.integers(0, x0 + wide + 9, 5).tolist()
        got = pictures.letters_under(line, widths, x0, x0 + wide - 1, lefts)
        if not size:
            assert got is None
            continue
        path = align._gap_path(rng.integers(0, 2, wide).astype(float), rng.integers(0, 2, wide).astype(float), 1.0)
        assert path.tolist() == list(range(wide))
        starts = np.cumsum([0, *(w for _, w in own)])
        at = [int(np.abs(path - (min(max(x, x0), x0 + wide - 1) - x0)).argmin()) for x in lefts]
        assert got == [own[max(0, min(int((starts * (wide / size) <= c).sum()) - 1, len(own) - 1))][0] for c in at]


def test_tokens_of_sung_bands_can_be_left_out(spark):
    rows = drawn(songs(Tables(spark, "/root/testdata/sf0.001")))
    looks, some = pictures.seen(rows, (4, 6)), pictures.seen(rows, (4, 6), sung=False)
    plain = pictures.seen_bands(looks).where("not sung").select("id", "band")
    for reach in (4, 6):
        want = sorted(map(tuple, pictures.seen_tokens(looks, reach).join(plain, ["id", "band"]).collect()))
        assert want and sorted(map(tuple, pictures.seen_tokens(some, reach).collect())) == want
    assert sorted(map(str, looks.select("id", "bands").collect())) == sorted(map(str, some.select("id", "bands").collect()))


def test_a_picture_is_read_in_its_row(spark):
    """What a picture shows is found in one pass: nothing is shuffled, aligned or grouped anew afterwards, and no token's shape is kept."""
    plan = _plan(QUERIES["picture_placements"](spark, "/root/testdata/sf0.001"))
    assert not re.findall(r"Exchange|Join|Aggregate|Window|EvalPython|bits", plan)


def test_pictures_are_drawn_and_looked_at_together(spark):
    """Pixel rows that are made in one array aren't taken apart and gathered again."""
    plan = _plan(pictures.seen(drawn(songs(Tables(spark, "/root/testdata/sf0.001"))), (6,)))
    assert len(re.findall(r"\bArrowEvalPython\b", plan)) == 1 and len(re.findall(r"\bExchange\b", plan)) == 1


def test_pictures_without_lines_or_palettes(spark):
    ink = np.zeros((60, 100), bool)
    ink[0:12, 0:16] |= bitmap("Am")
    ink[20:32, 0:64] |= bitmap("somewhat")
    rows = spark.createDataFrame(as_rows(1, ink) + as_rows(2, ink) + as_rows(3, ink[:0]) + as_rows(4, ink), ROWS)
    lines = spark.createDataFrame([(1, 0, "somewhat"), (2, 0, "--"), (4, 0, "somewhat")], "id long, line_no int, line string")
    bits, aspect = pictures.shape_of(bitmap("Am"))
    palettes = spark.createDataFrame([(i, 0, "Am", bytearray(bits), aspect) for i in (1, 2)], "id long, n int, name string, bits binary, aspect double")
    letters = spark.createDataFrame([(c, [1, 1, 1, 1, 1, 0, 0, 0]) for c in "abcdefghijklmnopqrstuvwxyz"], "letter string, columns array<int>")
    bands, placed, between = pictures.read_pictures(rows, lines, palettes, letters, pictures.shape_of(np.ones((12, 1), bool)), "a-z")
    assert sorted(map(tuple, placed.collect())) == [(1, 0, 1, 0, "Am", 1.0), (4, 0, 1, 0, None, 0.0)]
    assert bands.count() == 6 and between.collect() == []
