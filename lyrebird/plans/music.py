"""Symbols, keys and sheets over the part and lineitem tables, and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.functions import music
from lyrebird.operators import harmony, pages, sheets, signals
from lyrebird.plans.registry import Tables, query
from lyrebird.runtime import dealt

_ROOTS = ("C", "C#", "Db", "D", "Eb", "E", "F", "F#", "Gb", "A", "Bb", "H")
_ENDS = ("", "m", "7", "dim", "maj7", "m7b5", "/B", "/x", "M7", "sus4")
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_SYMBOL_SQL = f"(SELECT p_partkey AS id, {_LIST(_ROOTS)}[p_partkey % 12 + 1] || {_LIST(_ENDS)}[(p_partkey // 12) % 10 + 1] AS symbol, (p_size % 13) - 6 AS delta, p_size % 2 = 0 AS flats FROM part)"


def named_symbols(t: Tables) -> DataFrame:
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.concat(pick(_ROOTS, k % 12), pick(_ENDS, F.floor(k / 12) % 10)).alias("symbol"), (F.col("p_size") % 13 - 6).alias("delta"), (F.col("p_size") % 2 == 0).alias("flats"))


def _pitch_sql(name: str) -> str:
    letter = f"CASE substr({name}, 1, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END"
    return f"(({letter} + CASE substr({name}, 2, 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END + 12) % 12)"


def _rest_sql(name: str) -> str:
    return f"(CASE WHEN substr({name}, 2, 1) IN ('#', 'b') THEN substr({name}, 3) ELSE substr({name}, 2) END)"


def _note_sql(pitch: str) -> str:
    return f"(CASE WHEN flats THEN {_LIST(music.FLATS)} ELSE {_LIST(music.SHARPS)} END)[CAST((({pitch}) % 12 + 12) % 12 AS INTEGER) + 1]"


def _moved_sql(part: str) -> str:
    return f"{_note_sql(_pitch_sql(part) + ' + delta')} || {_rest_sql(part)}"


@query(f"""SELECT id, CASE WHEN delta = 0 OR {_pitch_sql("a")} IS NULL OR (b IS NOT NULL AND {_pitch_sql("b")} IS NULL) THEN symbol WHEN b IS NULL THEN {_moved_sql("a")} ELSE {_moved_sql("a")} || '/' || {_moved_sql("b")} END AS moved
FROM (SELECT *, split_part(symbol, '/', 1) AS a, CASE WHEN contains(symbol, '/') THEN split_part(symbol, '/', 2) END AS b FROM {_SYMBOL_SQL})""")
def transposed_symbols(t: Tables) -> DataFrame:
    return named_symbols(t).select("id", music.transpose(F.col("symbol"), F.col("delta"), F.col("flats")).alias("moved"))


_QUALITY_SQL = "CASE WHEN regexp_matches(e, '^(dim|°$|ø|m7b5)') THEN 'dim' WHEN regexp_matches(e, '^(maj|ma7)') THEN 'maj' WHEN starts_with(e, 'm') THEN 'min' ELSE 'maj' END"


@query(f"SELECT id, CAST(root AS INTEGER) AS root, {_QUALITY_SQL} AS quality FROM (SELECT id, {_pitch_sql('symbol')} AS root, lower({_rest_sql('split_part(symbol, ' + chr(39) + '/' + chr(39) + ', 1)')}) AS e FROM {_SYMBOL_SQL}) WHERE root IS NOT NULL")
def parsed_symbols(t: Tables) -> DataFrame:
    return harmony.parsed_symbols(named_symbols(t)).select("id", F.col("root").cast("int").alias("root"), "quality")


def _lines_as_symbols(t: Tables) -> DataFrame:
    quality = F.get(F.array(F.lit("maj"), F.lit("min"), F.lit("dim")), (F.col("l_suppkey") % 3).cast("int"))
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.pmod("l_partkey", F.lit(12)).cast("int").alias("root"), quality.alias("quality"))


def _score_sql(scale: tuple) -> str:
    whole = " OR ".join(f"(step = {s} AND quality = '{q}')" for s, q in scale)
    return f"CASE WHEN {whole} THEN 1.0 WHEN step IN ({', '.join(str(s) for s, _ in scale)}) THEN 0.5 ELSE 0.0 END"


_KEYS_SQL = f"""(WITH c AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey % 12 AS root, ['maj', 'min', 'dim'][l_suppkey % 3 + 1] AS quality FROM lineitem),
f AS (SELECT id, count(*) AS total, arg_min(root, pos * 1000 + root * 10 + CASE quality WHEN 'dim' THEN 0 WHEN 'maj' THEN 1 ELSE 2 END) AS fr, arg_min(quality, pos * 1000 + root * 10 + CASE quality WHEN 'dim' THEN 0 WHEN 'maj' THEN 1 ELSE 2 END) AS fq FROM c GROUP BY id),
k AS (SELECT c.id, t.tonic, m.minor, c.root, c.quality, (c.root - t.tonic + 12) % 12 AS step FROM c CROSS JOIN (SELECT unnest(range(0, 12)) AS tonic) t CROSS JOIN (SELECT unnest([false, true]) AS minor) m),
s AS (SELECT id, tonic, minor, sum(CASE WHEN minor THEN {_score_sql(music.MINOR_SCALE)} ELSE {_score_sql(music.MAJOR_SCALE)} END) AS score, sum(CASE WHEN root = tonic THEN 1 ELSE 0 END) AS as_root FROM k GROUP BY id, tonic, minor),
r AS (SELECT s.*, f.total, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, CASE WHEN tonic = fr AND minor = (fq = 'min') THEN 0 ELSE 1 END, as_root DESC, minor, tonic) AS n FROM s JOIN f ON s.id = f.id)
SELECT id, CAST(tonic AS INTEGER) AS tonic, CASE WHEN minor THEN 'minor' ELSE 'major' END AS mode, CAST(least(1.0, score / total) AS DOUBLE) AS confidence FROM r WHERE n = 1)"""


@query(f"SELECT * FROM {_KEYS_SQL}")
def detected_keys(t: Tables) -> DataFrame:
    return harmony.detect_keys(_lines_as_symbols(t), "id", "pos")


@query(f"SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'mid' ELSE 'low' END AS tier, count(*) AS n FROM {_KEYS_SQL} GROUP BY 1")
def key_tiers(t: Tables) -> DataFrame:
    return detected_keys(t).groupBy(music.confidence_tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, CAST(l_partkey % 12 AS INTEGER) AS root, count(*) AS n FROM lineitem GROUP BY 1, 2")
def root_histogram(t: Tables) -> DataFrame:
    return harmony.root_histogram(_lines_as_symbols(t), "id")


@query(f"""SELECT id, label, flats_wanted, CAST(rel AS INTEGER) AS rel, CAST(d AS INTEGER) AS d FROM (SELECT p_partkey AS id, {_LIST(music.SHARPS)}[p_partkey % 12 + 1] AS sh, {_LIST(music.FLATS)}[p_partkey % 12 + 1] AS fl,
CASE WHEN {_LIST(music.SHARPS)}[p_partkey % 12 + 1] = {_LIST(music.FLATS)}[p_partkey % 12 + 1] THEN {_LIST(music.SHARPS)}[p_partkey % 12 + 1] ELSE {_LIST(music.SHARPS)}[p_partkey % 12 + 1] || '/' || {_LIST(music.FLATS)}[p_partkey % 12 + 1] END AS label,
p_partkey % 12 IN (1, 3, 5, 8, 10) AS flats_wanted, CASE WHEN p_size % 2 = 0 THEN (p_partkey + 3) % 12 ELSE p_partkey % 12 END AS rel,
CASE WHEN (p_size - p_partkey % 12 + 120) % 12 > 6 THEN (p_size - p_partkey % 12 + 120) % 12 - 12 ELSE (p_size - p_partkey % 12 + 120) % 12 END AS d FROM part)""")
def key_facts(t: Tables) -> DataFrame:
    tonic = (F.col("p_partkey") % 12).cast("int")
    mode = F.when(F.col("p_size") % 2 == 0, "minor").otherwise("major")
    return t.part.select(
        F.col("p_partkey").alias("id"), music.key_label(tonic).alias("label"), music.prefer_flats(tonic).alias("flats_wanted"),
        music.relative_major(tonic, mode).cast("int").alias("rel"), music.signed_delta(tonic, F.col("p_size")).cast("int").alias("d"),
    )


_STEP = "[0, 2, 4, 5, 7, 9, 11]"


@query(f"""SELECT id, degree, (CASE WHEN flats THEN {_LIST(music.FLATS)} ELSE {_LIST(music.SHARPS)} END)[(tonic + {_STEP}[degree + 1]) % 12 + 1] || ['', 'm', 'm', '', '', 'm', '°'][degree + 1] AS symbol
FROM (SELECT p_partkey AS id, p_partkey % 12 AS tonic, p_partkey % 12 IN (1, 3, 5, 8, 10) AS flats, CAST(d AS INTEGER) AS degree FROM part CROSS JOIN (SELECT unnest(range(0, 7)) AS d))""")
def diatonic_symbols(t: Tables) -> DataFrame:
    tonic = (F.col("p_partkey") % 12).cast("int")
    rows = t.part.select(F.col("p_partkey").alias("id"), tonic.alias("tonic"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("degree"))
    return rows.select("id", "degree", music.diatonic_symbol(F.col("tonic"), F.col("degree"), music.prefer_flats(F.col("tonic"))).alias("symbol"))


def song_sheets(t: Tables) -> DataFrame:
    """A small sheet for each part: directives, a heading, rows of symbols and lyric rows."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("{title: "), "p_name", F.lit("}\n{key: "), F.when(k % 3 == 0, "F#m").when(k % 3 == 1, "bb").otherwise("?"), F.lit("}\n## Intro: [C] / [G7] x2\n[Am] [F]\n\n\n\n"),
        F.lit("la [C]"), "p_name", F.lit(" [G/B]"), "p_brand", F.when(k % 2 == 0, F.concat(F.lit("\n[Em](2)[D] - "), "p_type")).otherwise("\n[E] solo [A7]\n[Am7] 1."), F.lit("\n{t: last "), k.cast("string"), F.lit("}\n"),
    )
    return t.part.select(k.alias("id"), text.alias("text"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'F#m' WHEN 1 THEN 'bb' ELSE '?' END AS key, 'last ' || p_partkey AS title, CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 10 END AS tonic, CASE p_partkey % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'major' END AS mode FROM part""")
def sheet_meta(t: Tables) -> DataFrame:
    return sheets.sheet_meta(sheets.parse_lines(song_sheets(t), "id", "text"), "id").select("id", "key", "title", F.col("tonic").cast("int").alias("tonic"), "mode")


@query("""SELECT id, kind, count(*) AS n FROM (SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['directive', 'directive', 'symbols', 'symbols', 'blank', 'blank', 'blank', 'lyric', 'lyric', 'directive', 'blank'] ELSE ['directive', 'directive', 'symbols', 'symbols', 'blank', 'blank', 'blank', 'lyric', 'symbols', 'symbols', 'directive', 'blank'] END) AS kind FROM part) GROUP BY id, kind""")
def sheet_lines(t: Tables) -> DataFrame:
    return sheets.parse_lines(song_sheets(t), "id", "text").groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 9 END AS n, CASE WHEN p_partkey % 2 = 0 THEN 'C G7 Am F G/B Em D' ELSE 'C G7 Am F G/B E A7 Am7' END AS head FROM part""".replace("THEN 8 ELSE 9", "THEN 7 ELSE 8"))
def sheet_symbols(t: Tables) -> DataFrame:
    found = sheets.distinct_symbols(sheets.sheet_symbols(sheets.parse_lines(song_sheets(t), "id", "text"), "id"), "id")
    return found.select("id", F.col("n").cast("int").alias("n"), F.array_join("head", " ").alias("head"))


@query("""SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 2 = 0 THEN [2, 3] ELSE [2, 3, 8, 9] END) AS line_no, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['', 'Intro: '] ELSE ['', 'Intro: ', '', ''] END) AS indent FROM part""")
def symbol_rows(t: Tables) -> DataFrame:
    return sheets.symbol_rows(sheets.parse_lines(song_sheets(t), "id", "text"), "id").select("id", "line_no", "indent")


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN a || chr(10) || 'Em' || d || chr(10) || '(2) - ' || p_type ELSE a || chr(10) || 'E solo A7' || chr(10) || 'Am7 1.' END AS sheet FROM (SELECT p_partkey AS id, p_type, '   D' AS d, 'Intro: C / G7 x2' || chr(10) || 'Am F' || chr(10) || chr(10) || '   C' || repeat(' ', length(p_name)) || 'G/B' || chr(10) || 'la ' || p_name || ' ' || p_brand AS a FROM part)""".replace("'   D'", "' D'"))
def sheet_render(t: Tables) -> DataFrame:
    return sheets.render_sheets(sheets.parse_lines(song_sheets(t), "id", "text"), "id")


@query("""SELECT p_partkey AS id, '[C]' || substr(p_name, 1, 2) || '[Am][F]' || substr(p_name, 3) AS marked FROM part""")
def inserted_markers(t: Tables) -> DataFrame:
    marks = F.array(F.struct(F.lit(2).alias("at"), F.lit("Am").alias("symbol")), F.struct(F.lit(0).alias("at"), F.lit("C").alias("symbol")), F.struct(F.lit(2).alias("at"), F.lit("F").alias("symbol")))
    return t.part.select(F.col("p_partkey").alias("id"), sheets.insert_markers(F.col("p_name"), marks).alias("marked"))


def varied_sheets(t: Tables) -> DataFrame:
    """Sheets of the cases that parsing must tell apart, picked and ordered by the part's number.

    Blank and spaced symbols, lines of tabs, rows of a label alone, labelled and unlabelled runs, rows with a
    lead that is no label, runs that a directive interrupts, and white space at a line's end.
    """
    return t.part.select(F.col("p_partkey").alias("id"), F.expr(_VARIED).alias("text"))


_PICKS = (
    "'[ Am ]x [Am]y []z [ ]'", "'\t'", "'Intro:'", "'/ [D]' || chr(10) || '[E]'", "'Intro / [C]' || chr(10) || 'Solo [D]  ' || chr(10) || '(2 Times) x3'", "'{key: ' || p_size || '}' || chr(10) || 'la [C] la   '",
    "'Outro - [F] [G/B]' || chr(10) || '{c: between}' || chr(10) || '[A7]' || chr(10) || ' ' || chr(9) || chr(10) || '[B]'", "'  ### Hook [Em]' || chr(10) || '[D] | [D]'", "p_name || ' [' || p_brand || ']'", "'[C' || chr(10) || 'verse] [ D]'", "'{key: ' || CASE p_size % 4 WHEN 0 THEN ' f#m ' WHEN 1 THEN 'Bb minor' WHEN 2 THEN 'AB' ELSE 'c' END || ' }'",
)
_VARIED = " || chr(10) || ".join(f"CASE (p_partkey * {k + 2} + {k}) % {len(_PICKS)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PICKS)) + " END" for k in range(5))

_LABELS_SQL = r"\b(intro|verse|chorus|prechorus|bridge|outro|ending|coda|solo|interlude|instru(mental)?|hook|tag|riff)\b"
_LINES_SQL = rf"""(WITH t AS (SELECT p_partkey AS id, string_split({_VARIED}, chr(10)) AS l FROM part),
u AS (SELECT id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS line_no FROM t),
s AS (SELECT id, line_no, regexp_replace(regexp_replace(raw, '\s+$', ''), '^\s{{0,3}}#{{1,6}}[ \t]+(\S)', '\1') AS line FROM u),
k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '{_LABELS_SQL}', ' ', 'gi'), '[/|×xX*:.,\-–—\d\s]', ' ', 'g')) AS rest FROM s)
SELECT id, line_no, line, CASE WHEN regexp_matches(line, '^\{{\s*[A-Za-z_]+\s*:\s*[^}}]*\}}\s*$') THEN 'directive' WHEN line = '' THEN 'blank' WHEN rest = '' THEN 'symbols' ELSE 'lyric' END AS kind FROM k)"""


def _varied_lines(t: Tables) -> DataFrame:
    return sheets.parse_lines(varied_sheets(t), "id", "text")


@query(f"SELECT id, CAST(line_no AS INTEGER) AS line_no, line, kind FROM {_LINES_SQL}")
def varied_lines(t: Tables) -> DataFrame:
    return _varied_lines(t).select("id", F.col("line_no").cast("int").alias("line_no"), "line", "kind")


@query(rf"""WITH m AS (SELECT id, line_no, list_transform(regexp_extract_all(line, '\[([^\]]*)\]', 1), lambda x: trim(x)) AS l FROM {_LINES_SQL} WHERE kind <> 'directive'),
x AS (SELECT id, line_no, unnest(l) AS symbol, generate_subscripts(l, 1) AS k FROM m),
d AS (SELECT id, symbol, min(line_no * 1000 + k) AS pos FROM x WHERE symbol <> '' GROUP BY id, symbol)
SELECT id, CAST(count(*) AS INTEGER) AS n, array_to_string(list_slice(list(symbol ORDER BY pos), 1, 12), ' ') AS head FROM d GROUP BY id""")
def varied_symbols(t: Tables) -> DataFrame:
    found = sheets.distinct_symbols(sheets.sheet_symbols(_varied_lines(t), "id"), "id")
    return found.select("id", F.col("n").cast("int").alias("n"), F.array_join("head", " ").alias("head"))


@query(
    rf"""WITH l AS (SELECT * FROM {_LINES_SQL} WHERE kind <> 'directive'),
c AS (SELECT id, line_no, string_split_regex(line, '\[[^\]]*\]') AS t, list_transform(regexp_extract_all(line, '\[([^\]]*)\]', 1), lambda x: trim(x)) AS s FROM l WHERE kind = 'lyric'),
u AS (SELECT id, line_no, generate_subscripts(s, 1) AS k, unnest(s) AS symbol, t FROM c),
m AS (SELECT id, line_no, k, symbol, length(array_to_string(list_slice(t, 1, k), '')) AS begins FROM u WHERE symbol <> ''),
p AS (SELECT *, coalesce(sum(length(symbol) + 1) OVER (PARTITION BY id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM m),
a AS (SELECT *, filled + max(begins - filled) OVER (PARTITION BY id, line_no ORDER BY k) AS place FROM p),
g AS (SELECT *, place - coalesce(lag(place + length(symbol) + 1) OVER (PARTITION BY id, line_no ORDER BY k), 0) AS gap FROM a),
o AS (SELECT id, line_no, regexp_replace(string_agg(repeat(' ', CAST(gap AS INTEGER)) || symbol || ' ', '' ORDER BY k), '\s+$', '') AS above FROM g GROUP BY id, line_no),
x AS (SELECT l.id, l.line_no, CASE kind WHEN 'symbols' THEN trim(regexp_replace(regexp_replace(line, '\[([^\]]*)\]', '\1', 'g'), '\s+', ' ', 'g')) WHEN 'blank' THEN '' ELSE coalesce(above || chr(10), '') || regexp_replace(array_to_string(t, ''), '\s+$', '') END AS out
  FROM l LEFT JOIN c ON c.id = l.id AND c.line_no = l.line_no LEFT JOIN o ON o.id = l.id AND o.line_no = l.line_no)
SELECT id, regexp_replace(regexp_replace(regexp_replace(string_agg(out, chr(10) ORDER BY line_no), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS sheet FROM x GROUP BY id"""
)
def varied_render(t: Tables) -> DataFrame:
    return sheets.render_sheets(_varied_lines(t), "id")


@query(rf"""WITH s AS (SELECT * FROM {_LINES_SQL} WHERE kind <> 'directive'),
i AS (SELECT *, sum(CASE WHEN kind = 'symbols' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY line_no) AS island FROM s),
r AS (SELECT *, row_number() OVER w AS n, first_value(line) OVER w AS lead FROM i WHERE kind = 'symbols' WINDOW w AS (PARTITION BY id, island ORDER BY line_no)),
p AS (SELECT *, regexp_extract(lead, '^(.*?)\[[^\]]*\]', 1) AS prefix FROM r)
SELECT id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN n > 1 AND regexp_matches(prefix, '{_LABELS_SQL}', 'i') THEN prefix ELSE '' END AS indent FROM p""")
def varied_rows(t: Tables) -> DataFrame:
    return sheets.symbol_rows(_varied_lines(t), "id").select("id", F.col("line_no").cast("int").alias("line_no"), "indent")


@query(rf"""WITH d AS (SELECT id, line_no, regexp_extract(line, '^\{{\s*([A-Za-z_]+)', 1) AS name, trim(regexp_extract(line, ':\s*([^}}]*)', 1)) AS value FROM {_LINES_SQL} WHERE kind = 'directive'),
m AS (SELECT id, arg_max(value, line_no) FILTER (WHERE name = 'key') AS key, arg_max(value, line_no) FILTER (WHERE name = 'c') AS note FROM d GROUP BY id)
SELECT id, key, note, CAST(CASE key WHEN 'f#m' THEN 6 WHEN 'Bb minor' THEN 10 WHEN 'AB' THEN 9 WHEN 'c' THEN 0 END AS INTEGER) AS tonic, CAST(CASE key WHEN 'f#m' THEN 9 WHEN 'Bb minor' THEN 1 WHEN 'AB' THEN 9 WHEN 'c' THEN 0 END AS INTEGER) AS source FROM m""")
def varied_meta(t: Tables) -> DataFrame:
    meta = sheets.sheet_meta(_varied_lines(t), "id")
    return meta.select("id", "key", "note", F.col("tonic").cast("int").alias("tonic"), F.col("source").cast("int").alias("source"))


@query(r"""SELECT p_partkey AS id, regexp_replace(regexp_replace(v, '-sharp-?', '#', 'g'), '-flat-?', 'b', 'g') AS symbol
FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'C-sharp-m' WHEN 1 THEN 'b-flat-slash-d-sharp' WHEN 2 THEN 'A-m-7' WHEN 3 THEN replace(p_name, ' ', '-flat-') ELSE p_type END AS v FROM part)""")
def normed_symbols(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "C-sharp-m").when(k % 5 == 1, "b-flat-slash-d-sharp").when(k % 5 == 2, "A-m-7").when(k % 5 == 3, F.replace("p_name", F.lit(" "), F.lit("-flat-"))).otherwise(F.col("p_type"))
    return t.part.select(k.alias("id"), music.norm_symbol(raw).alias("symbol"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 12 WHEN p_size / 50.0 >= 0.5 AND p_partkey % 5 <> 0 THEN p_size % 12 ELSE 0 END AS INTEGER) AS tonic FROM part")
def default_keys(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    tonic = music.default_tonic(F.when(k % 3 == 0, k % 12), F.when(k % 5 != 0, s % 12), s / 50)
    return t.part.select(k.alias("id"), tonic.cast("int").alias("tonic"))


_TWICE = f"CASE WHEN delta = 0 OR {_pitch_sql('a')} IS NULL OR (b IS NOT NULL AND {_pitch_sql('b')} IS NULL) THEN symbol WHEN b IS NULL THEN {_moved_sql('a')} ELSE {_moved_sql('a')} || '/' || {_moved_sql('b')} END"


@query(f"""SELECT id, moved || ' ' || CASE WHEN flats THEN 'Eb' ELSE 'D#' END || ' ' || moved AS moved FROM (SELECT id, flats, {_TWICE} AS moved FROM (SELECT *, split_part(symbol, '/', 1) AS a, CASE WHEN contains(symbol, '/') THEN split_part(symbol, '/', 2) END AS b FROM (SELECT id, symbol, 3 AS delta, flats FROM {_SYMBOL_SQL})))""")
def transposed_lists(t: Tables) -> DataFrame:
    moved = music.transpose_all(F.array("symbol", F.lit("C"), "symbol"), F.lit(3), F.col("flats"))
    return named_symbols(t).select("id", F.array_join(moved, " ").alias("moved"))


_REGION = "(SELECT page_id, html, substr(html, strpos(html, '</h1>') + 5) AS rest FROM pages WHERE strpos(html, '</h1>') > 0)"
_PLAIN_SQL = r"""replace(regexp_replace(regexp_replace(regexp_replace(left(rest, least(CASE WHEN strpos(rest, '</article>') > 0 THEN strpos(rest, '</article>') ELSE length(rest) + 1 END, CASE WHEN strpos(rest, '<footer') > 0 THEN strpos(rest, '<footer') ELSE length(rest) + 1 END) - 1), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:div|p|h3)>', chr(10), 'g'), '<[^>]+>', '', 'g'), chr(160), ' ')"""


def _clean_sql(text: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split({text}, chr(10)), lambda l: regexp_replace(regexp_replace(l, '^\s+', ''), '\s+$', '')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '')"""


_BODY_SQL = _clean_sql(_PLAIN_SQL)


@query(f"SELECT page_id, {_BODY_SQL} AS body, CASE WHEN {_BODY_SQL} = '' THEN 'no_lyrics' ELSE 'ok' END AS status FROM {_REGION}")
def page_text(t: Tables) -> DataFrame:
    return pages.extract_pages(t.pages, "</h1>", ("</article>", "<footer"), "href", entities=False).select("page_id", "body", "status")


# the pages with a heading of one of three shapes or none, indented lines and a wrapped placeholder
_HEADED = "html || CASE page_id % 4 WHEN 0 THEN '<h3> Words of ' || page_id || '</h3>' WHEN 1 THEN '<h3>Words</h3>' WHEN 2 THEN '<h3>Other</h3>' ELSE '<h3>' || chr(10) || 'Words</h3>' END || '<p>  ' || chr(9) || url || ' </p>' || chr(10) || '   <br> <b>in</b> line' || CASE WHEN page_id % 5 = 0 THEN '<p>there are <i>no</i> words</p>' ELSE '' END || '<div class=end>tail'"


@query(
    rf"""WITH p AS (SELECT page_id, regexp_extract({_HEADED}, '(?s)^.*?(?:<h3>\s*Words[^<]*</h3>)(.*)$', 1) AS r FROM pages),
x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(left(r, strpos(r || '<div class=end>', '<div class=end>') - 1), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:div|p|h3)>', chr(10), 'g'), '<[^>]+>', '', 'g') AS text FROM p)
SELECT page_id, CASE WHEN text <> '' AND NOT contains(text, 'no words') THEN {_clean_sql("text")} END AS body, CASE WHEN text <> '' AND NOT contains(text, 'no words') THEN 'ok' ELSE 'no_lyrics' END AS status FROM x"""
)
def headed_pages(t: Tables) -> DataFrame:
    """Regions after a heading that a pattern tells, with a placeholder in tags."""
    found = t.pages.select("page_id", F.expr(_HEADED).alias("html"))
    return pages.extract_pages(found, r"<h3>\s*Words[^<]*</h3>", ("<div class=end>",), "href", entities=False, placeholder="no words", pattern=True).select("page_id", "body", "status")


@query("SELECT page_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]), ' ') AS palette FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def page_palette(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(pages.attributes(F.col("html"), "href"), " ").alias("palette"))


@query()
def page_entities(t: Tables) -> DataFrame:
    """Bodies with entities read; SQL has no such function, so a test holds it against Python's."""
    return pages.extract_pages(t.pages, "</h1>", ("</footer>",), "href").select("page_id", "body", "status")


@query(f"SELECT page_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blanks FROM (SELECT page_id, unnest(string_split({_BODY_SQL}, chr(10))) AS line FROM {_REGION}) GROUP BY page_id")
def page_lines(t: Tables) -> DataFrame:
    lines = pages.numbered_lines(page_text(t), "page_id", "body")
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.count_if("blank").alias("blanks"))


@query("""WITH b AS (SELECT l_orderkey AS key, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity % 15 AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e) AS n FROM m)
SELECT key, min(s) AS start, max(e) AS "end" FROM g GROUP BY key, n""")
def merged_bands(t: Tables) -> DataFrame:
    start = F.col("l_linenumber") * 10
    bands = t.lineitem.select(F.col("l_orderkey").alias("key"), start.alias("start"), (start + F.col("l_quantity") % 15).alias("end"))
    return signals.merged_bands(bands, "key")


@query("""WITH b AS (SELECT l_linenumber % 2 AS key, l_orderkey * 9 + l_linenumber AS s, CAST(l_orderkey * 9 + l_linenumber + l_quantity % 7 AS BIGINT) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e) AS n FROM m)
SELECT key, CAST(min(s) AS BIGINT) AS start, max(e) AS "end" FROM g GROUP BY key, n""")
def wide_bands(t: Tables) -> DataFrame:
    """Bands of two keys only, each of which goes over many tasks."""
    start = (F.col("l_orderkey") * 9 + F.col("l_linenumber")).cast("long")
    bands = t.lineitem.select((F.col("l_linenumber") % 2).alias("key"), start.alias("start"), (start + F.col("l_quantity") % 7).cast("long").alias("end"))
    return signals.merged_bands(bands, "key", spread=True)


def tone_frames(t: Tables) -> DataFrame:
    """For each customer three spectrum frames a symbol and two silent ones, the code being the customer's key."""
    code = F.concat(F.lit("S"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise("E"))
    symbols = dealt(t.customer.select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("id"), F.posexplode(F.filter(F.split(code, ""), lambda s: s != "")).alias("at", "s"))
    hz = F.when(F.col("s") == "S", 18000).when(F.col("s") == "E", 18975).otherwise(F.lit(18150) + F.col("s").cast("int") * 75)
    steps = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return symbols.select("id", "at", hz.alias("hz"), steps.alias("k")).select("id", (F.col("at") * 5 + F.col("k")).alias("frame"), F.when(F.col("k") < 3, F.col("hz") + F.col("id") % 30).alias("freq"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS code FROM customer")
def tone_codes(t: Tables) -> DataFrame:
    return signals.decoded_frames(signals.bursts(tone_frames(t), "id"), "id")


@query("SELECT l_orderkey AS id, round(avg(l_quantity / 64), 3) AS mean, round(avg(CASE WHEN l_quantity / 64 >= 0.6 THEN 1.0 ELSE 0.0 END), 3) AS share, count(*) FILTER (WHERE l_quantity / 64 < 0.6) > 0 AS needs_review FROM lineitem GROUP BY 1")
def score_report(t: Tables) -> DataFrame:
    scores = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") / 64).alias("score"))
    return signals.score_report(scores, "id").drop("low")
