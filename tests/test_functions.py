"""Literal cases, worked out by hand."""

import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lyrebird.functions import music, text
from lyrebird.operators import collections as col
from lyrebird.operators import harmony, ingest, names, pages, search, sheets, signals


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("P A/B  C. ", "A_B C"), ("a\tb", "a_b"), ("P ", "untitled"), ("P P x", "P x"), ("...", "untitled"), (None, None), ("a  b", "a b")])
def test_clean_name(spark, raw, want):
    assert one(spark, raw, lambda c: text.clean_name(c, "P ")) == want


@pytest.mark.parametrize("raw, want", [("Big_Ass  Song!", "big-ass-song"), ("!!!", "song"), ("กำ_ไร x", "กำ-ไร-x")])
def test_slugify(spark, raw, want):
    got = one(spark, raw, text.slugify)
    assert got == "".join(c for c in want if unicodedata.category(c)[0] in "LN" or c == "-")


def test_strings(spark):
    assert one(spark, "a b*~!'()+é", text.encode_uri) == "a%20b*~!'()%2B%C3%A9"
    assert one(spark, "<a & \"b\">", text.xml_escape) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, "a.b*c", text.regex_escape) == r"a\.b\*c"
    assert one(spark, "É  X ", text.search_key) == "é x"
    assert one(spark, "a-bb_cc d", text.name_tokens) == ["bb", "cc"]
    assert one(spark, "<think>x</think>```json\n{\"a\": 1}\n```", text.clean_response) == '{"a": 1}'
    assert one(spark, 'so: {"a": 1} ok', lambda c: text.salvaged_json(c, "a int"))["a"] == 1
    assert one(spark, "http://h/x.PNG//", text.is_image) and not one(spark, "http://h.png/x", text.is_image) and one(spark, None, text.is_image) is False
    assert one(spark, b"RIFF0000WEBP", text.image_kind, "binary") == "webp" and one(spark, b"GIF89a", text.image_kind, "binary") == "gif"
    assert one(spark, "012345", text.room_code) and not one(spark, "01234", text.room_code)
    assert one(spark, "a&amp;b<br>c</p>d<i>e</i>", text.html_text) == html.unescape("a&amp;b\nc\nde")
    r = one(spark, "/song/12/x-y", text.route)
    assert (r["room"], r["song"], r["slug"]) == (None, 12, "x-y")


def test_search_differs(spark):
    df = search.with_search_key(spark.createDataFrame([(1, "Rodeo The Toy"), (2, "Rodeo The To")], "id long, name string"), "name")
    assert [r.id for r in search.search(df, "ro toy").collect()] == [1]
    assert search.search_within(df, "ro toy").count() == 0 and search.search(df, "  ").count() == 2


def test_disambiguate(spark):
    df = spark.createDataFrame([(1, "Polly"), (2, "polly"), (3, "Moon")], "id long, raw string")
    assert {r.id: r["name"] for r in names.disambiguate(df, "id", "raw").collect()} == {1: "Polly_1", 2: "polly_2", 3: "Moon"}


@pytest.mark.parametrize("symbol, delta, flats, want", [("Am7", 3, True, "Cm7"), ("G/B", 2, False, "A/C#"), ("Bb", 1, False, "B"), ("N.C.", 2, False, "N.C."), ("C/x", 2, False, "C/x"), ("H7", 1, True, "H7"), ("F#m", 0, True, "F#m"), (" ", 3, True, " ")])
def test_transpose(spark, symbol, delta, flats, want):
    assert one(spark, symbol, lambda c: music.transpose(c, F.lit(delta), F.lit(flats))) == want


@pytest.mark.parametrize("symbol, want", [("Cdim", "dim"), ("C°", "dim"), ("C°7", "maj"), ("Cm7b5", "dim"), ("Cmaj7", "maj"), ("CM7", "min"), ("Am/G", "min"), ("C7", "maj")])
def test_quality(spark, symbol, want):
    assert one(spark, symbol, music.symbol_quality) == want


@pytest.mark.parametrize("symbols, want", [(["D", "Bm", "F#m", "G", "A"], (2, "major", 1.0)), (["Am", "F", "C", "G"], (9, "minor", 1.0)), (["CM7"], (0, "minor", 1.0)), (["x"], None)])
def test_detect_key(spark, symbols, want):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(symbols)], "id long, pos long, symbol string")
    got = harmony.detect_keys(harmony.parsed_symbols(df), "id", "pos").collect()
    assert [(r.tonic, r["mode"], r.confidence) for r in got] == ([want] if want else [])


def test_parse_key(spark):
    got = {v: one(spark, v, music.parse_key) for v in ("F#m", "bb", "C minor", "x", "C lydian")}
    assert [(k and (k["tonic"], k["mode"])) for k in got.values()] == [(6, "minor"), (10, "major"), (0, "minor"), None, None]


def test_compact_and_finalize(spark):
    log = spark.createDataFrame([(1, 1, "h/a.png", None), (2, 2, None, "404"), (1, 3, "h/", "placeholder")], "id long, line_no long, src string, status string")
    assert {r.id: r.status for r in ingest.last_write(log, "id", "line_no").collect()} == {1: "placeholder", 2: "404"}
    assert ingest.finalize(log, log.limit(0).select("id")).count() == 0


def test_probe_end(spark):
    hits = spark.createDataFrame([(1,), (2,), (4,), (7,)], "id long")
    end = lambda start, misses: ingest.probe_end(hits, start, misses).first()["last"]
    assert (end(1, 2), end(1, 3), end(5, 2), end(5, 3), end(100, 2)) == (4, 7, 4, 7, 99)


def test_sheet_tokens(spark):
    line = "[C]la [G]do"
    assert [(t["type"], t["value"]) for t in one(spark, line, sheets.tokens)] == [("symbol", "C"), ("text", "la "), ("symbol", "G"), ("text", "do")]
    assert [(s["symbol"], s["text"]) for s in one(spark, "x [C]la", sheets.segments)] == [("", "x "), ("C", "la")]
    assert one(spark, "Intro: [C] / [G] (x2)", sheets.symbol_only) and not one(spark, "[C] la", sheets.symbol_only)
    assert one(spark, line, lambda c: sheets.rendered_line(c, F.lit("lyric"))) == "C  G\nla do"


def test_sheet_symbols_are_trimmed_and_blank_ones_left_out(spark):
    df = spark.createDataFrame([(1, "[ Am ]x [Am]y []z\n\t\n{c: [G]}")], "id long, text string")
    lines = sheets.parse_lines(df, "id", "text")
    r = sheets.distinct_symbols(sheets.sheet_symbols(lines, "id"), "id").first()
    assert (r.n, r["head"]) == (1, ["Am"])
    assert [x.kind for x in lines.orderBy("line_no").collect()] == ["lyric", "blank", "directive"]
    assert [(s["symbol"], s["text"]) for s in one(spark, "[ Am ]x []z", sheets.segments)] == [("Am", "x "), ("", "z")]
    assert [(t["type"], t["value"]) for t in one(spark, "a[ ]", sheets.tokens)] == [("text", "a"), ("symbol", "")]


@pytest.mark.parametrize("text, want", [
    ("/ [D]\n[E]", ["", ""]),
    ("Intro / [C]\nSolo [D]", ["", "Intro / "]),
    ("Intro / [C]\n{c: x}\n[D]\n\n[E]", ["", "Intro / ", ""]),
    ("Intro:\n[C]", ["", ""]),
    ("[C] outro\n[D]", ["", ""]),
])
def test_runs_of_symbols_are_indented_by_their_label(spark, text, want):
    lines = sheets.parse_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    assert [r.indent for r in sheets.symbol_rows(lines, "id").orderBy("line_no").collect()] == want


def test_symbol_only_rows(spark):
    rows = ["Intro:", "(2 Times) x3", "Solo [D] | [E]", "1. [C]", "la", "[C] la", "introduction [C]", "–—"]
    assert [one(spark, r, sheets.symbol_only) for r in rows] == [True, True, True, True, False, False, False, True]


def test_tombstones_from_json(spark):
    df = spark.createDataFrame([(1, '{"a": 5, "b": "7", "c": null, "d": 2.5, "e": [1]}'), (2, "[1]"), (3, None), (4, "oops"), (5, '{"z": 1e400}')], "owner long, j string")
    got = sorted((r.owner, r.id, r.deleted_at) for r in col.sanitised_tombstones(df, "j", ["owner"]).collect())
    assert got == [(1, "a", 5), (1, "d", 2)]


def test_key_values(spark):
    got = [one(spark, v, music.parse_key) for v in (" f#m ", "Bb  minor", "AB", "H", "Cmaj", "", "g min")]
    assert [k and (k["tonic"], k["mode"]) for k in got] == [(6, "minor"), (10, "minor"), (9, "major"), None, None, None, (7, "minor")]


def test_names_keep_columns_and_common_names(spark, monkeypatch):
    from lyrebird import runtime

    monkeypatch.setattr(runtime, "SPREAD", 10)
    df = spark.createDataFrame([(i, "Polly" if i % 3 else f"Song {i}", "keep", i) for i in range(120)], "id long, raw string, clean string, same_name int")
    got = names.disambiguate(df, "id", "raw").collect()
    assert {r.id: r["name"] for r in got} == {i: f"Polly_{i}" if i % 3 else f"Song {i}" for i in range(120)}
    assert {(r["clean"], r.id == r.same_name) for r in got} == {("keep", True)}


def test_regions(spark):
    cut = lambda v: one(spark, v, lambda c: pages.region(c, "<h>", ("</a>", "<f")))
    assert [cut(v) for v in ("x<h>ab</a><f", "x<h>ab<f</a>", "x<h>ab", "x")] == ["ab", "ab", "ab", None]
    of = lambda v: one(spark, v, lambda c: pages.region(c, r"<h\d>\s*Words[^<]*</h\d>", ("<f",), pattern=True))
    assert [of(v) for v in ("x<h3>\n Words of it</h3>a\nb<f", "<h2>Words</h2><h3>Words</h3>c", "<h3>Other</h3>d")] == ["a\nb", "<h3>Words</h3>c", None]
    assert one(spark, " \n\n  a \t\n\n \n\n\tb\r\n ", pages.clean_lines) == "a\n\nb"


def plain_body(html, start, end, placeholder):
    """The rules for a page's text, written out."""
    at = re.search(start, html)
    if not at:
        return None
    cut = html[at.end() :].split(end)[0]
    text = re.sub(r"<[^>]+>", "", re.sub(r"</(div|p|h3)>", "\n", re.sub(r"<br\s*/?>", "\n", cut, flags=re.I), flags=re.I))
    if placeholder in text:
        return None
    out = []
    for line in (x.strip() for x in text.split("\n")):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip("\n")


def test_placeholders_and_indented_lines(spark):
    cases = ["<h3>Words</h3><p>none</p>", "<h3> Words x</h3><br>   lo<br>\t\tla  <p> <p> </p></p>end", "<h3>Words</h3>  <div>a</div><b>no</b>ne</div>", "<h3>Words</h3>no ne", "no heading", "<h3>Words</h3>"]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = {r.page_id: (r.body, r.status) for r in pages.extract_pages(df, r"<h3>\s*Words[^<]*</h3>", ("<f",), "href", placeholder="none", pattern=True).collect()}
    want = [plain_body(c, r"<h3>\s*Words[^<]*</h3>", "<f", "none") for c in cases]
    assert got == {k: (w, "ok" if w else "no_lyrics") for k, w in enumerate(want)}
    assert want[:3] == [None, "lo\nla\n\nend", None]


def test_symbol_names_keep_other_hyphens(spark):
    norm = lambda v: v.replace("-sharp-", "#").replace("-flat-", "b").replace("-sharp", "#").replace("-flat", "b")
    for v in ("A-m-7", "C-sharp-slash-D", "C-sharp-m", "B-flat", "-flat--sharp-", "x-flat-sharp"):
        assert one(spark, v, music.norm_symbol) == norm(v)


def test_a_sheet_has_no_white_space_around_it(spark):
    df = spark.createDataFrame([(1, "la [C]x\n\n\n\n[D]\n \t"), (2, " [ ]y  [Am]z"), (3, "{key: C}\n\n")], "id long, text string")
    got = {r.id: r.sheet for r in sheets.render_sheets(sheets.parse_lines(df, "id", "text"), "id").collect()}
    assert got == {1: "C\nla x\n\nD", 2: "Am\n y  z", 3: ""}


def test_playlist_merge_cases(spark):
    kind = "owner long, ord long, id string, name string, song_ids array<long>, created_at long, updated_at long"
    row = lambda id_, name, at: (1, 0, id_, name, [1], 0, at)
    dead = "owner long, id string, deleted_at long"

    def merged(local, remote, gone):
        live, kept = col.merge_playlists(spark.createDataFrame(local, kind), spark.createDataFrame(remote, kind), spark.createDataFrame(gone, dead), 10)
        return [(r.id, r["name"]) for r in live.collect()], kept.count()

    assert merged([row("a", "l", 5)], [row("a", "r", 7)], []) == ([("a", "r")], 0)
    assert merged([row("a", "l", 5)], [row("a", "r", 5)], []) == ([("a", "l")], 0)
    assert merged([row("a", "l", 7)], [], [(1, "a", 7)]) == ([], 1)
    assert merged([row("a", "l", 7)], [], [(1, "a", 6)]) == ([("a", "l")], 0)


def test_normalised_playlists(spark):
    df = spark.createDataFrame([(1, '[{"id":"a","name":"n","songIds":[1,"x",2],"createdAt":5}, 7, {"songIds":null}]'), (2, None), (3, '{"k":{"id":"z"}}')], "owner long, j string")
    got = col.normalised_playlists(df, "j", ["owner"], 99).collect()
    assert [(r.owner, r.id, r["name"], r.song_ids, r.created_at, r.updated_at) for r in sorted(got, key=lambda r: (r.owner, r.ord))] == [(1, "a", "n", [1, 2], 5, 5), (1, "list-1", "Playlist", [], 99, 99), (3, "z", "Playlist", [], 99, 99)]


def test_playlist_fold(spark):
    events = [(1, i, i * 10, op, name, song, to) for i, (op, name, song, to) in enumerate([("create", "n", None, None), ("add", None, 5, None), ("add", None, 6, None), ("add", None, 5, None), ("move", None, 6, 0), ("remove", None, 9, None)])]
    df = spark.createDataFrame(events, "owner long, seq long, at long, op string, name string, song long, to int")
    r = col.folded_playlists(df, ["owner"]).first()
    assert (r["name"], r.song_ids, r.updated_at, r.deleted) == ("n", [6, 5], 50, False)


def test_overlap_and_bands(spark):
    df = spark.createDataFrame([(b"\x0f", b"\x3c"), (b"", b"")], "a binary, b binary").select(signals.mask_overlap("a", "b").alias("r"))
    assert sorted(r.r for r in df.collect()) == [2 / 6, 1.0]


def test_bursts(spark):
    frames = [18000, 18000, None, 18000, None, None, 18150, 18150, 19500, 18150, None, None, 18975]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(frames)], "id long, frame long, freq long")
    assert [(r.burst, r.symbol) for r in signals.bursts(df, "id").orderBy("burst").collect()] == [(1, "S"), (2, "0")]
