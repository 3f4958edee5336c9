"""Song sheets with bracketed symbols: parsing, keys, symbol rows and plain rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.music import parse_key, relative_major
from lyrebird.functions.text import WHITE, trimmed
from lyrebird.runtime import dealt

# Section words that may label a row of symbols, directives with their aliases, and the patterns of
# bracketed symbols, directive lines, headings and separators.
LABELS = ("intro", "verse", "chorus", "prechorus", "bridge", "outro", "ending", "coda", "solo", "interlude", "instrumental", "instru", "hook", "tag", "riff")
DIRECTIVES = {"key": ("key",), "note": ("note", "comment", "c"), "title": ("title", "t"), "artist": ("artist", "subtitle", "st")}
_SYMBOL = r"\[([^\]]*)\]"
_DIRECTIVE = r"^\{\s*([A-Za-z_]+)\s*:\s*([^}]*)\}\s*$"
_HEADING = r"^\s{0,3}#{1,6}[ \t]+(?=\S)"
_SEPARATOR = r"[/|×xX*:.,\-–—0-9]"

_LABEL = r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(LABELS) + r")(?![A-Za-z0-9_])"


def _symbols(line: Column) -> Column:
    """What stands in brackets, trimmed; it may be blank."""
    return F.transform(F.regexp_extract_all(line, F.lit(_SYMBOL), F.lit(1)), lambda s: trimmed(s))


def tokens(line: Column) -> Column:
    """The line as (type, value): text and trimmed symbols in turn, empty texts left out; a symbol may be blank."""
    pairs = F.flatten(
        F.transform(
            F.arrays_zip(F.split(line, _SYMBOL).alias("t"), _symbols(line).alias("c")),
            lambda p: F.array(F.struct(F.lit("text").alias("type"), p["t"].alias("value")), F.struct(F.lit("symbol").alias("type"), p["c"].alias("value"))),
        )
    )
    return F.filter(pairs, lambda t: t["value"].isNotNull() & ~((t["type"] == "text") & (t["value"] == "")))


def segments(line: Column) -> Column:
    """(symbol, text): each trimmed symbol with the text after it; text before the first symbol has an empty one."""
    symbols = _symbols(line)
    opened = F.arrays_zip(F.concat(F.array(F.lit("")), symbols).alias("symbol"), F.split(line, _SYMBOL).alias("text"), F.sequence(F.lit(0), F.size(symbols)).alias("n"))
    kept = F.filter(opened, lambda s: (s["n"] > 0) | (s["text"] != ""))
    return F.transform(kept, lambda s: F.struct(s["symbol"].alias("symbol"), s["text"].alias("text")))


def symbol_only(line: Column) -> Column:
    """Whether nothing is left of a line once symbols, notes in parentheses, labels and separators go.

    The line needs no symbol: a label alone is such a row, too.
    """
    rest = F.regexp_replace(F.regexp_replace(line, _SYMBOL, " "), r"\([^)]*\)", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, _LABEL, " "), _SEPARATOR, " "), f"{WHITE}+", "") == ""


def lead_label(line: Column) -> Column:
    """What stands before a line's first symbol, if a section word is in it, else an empty string."""
    lead = F.regexp_extract(line, rf"^(.*?){_SYMBOL}", 1)
    return F.when(F.rlike(lead, F.lit(_LABEL)), lead).otherwise("")


def parse_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, kind) with kind one of directive, blank, symbols, lyric.

    White space at a line's end goes, and headings lose their marks. Sheets are dealt by id first: the lines of
    few file splits go over all tasks, and what groups them by id needs no further shuffle.
    """
    lines = dealt(df.select(id_col, text_col), id_col).select(id_col, F.posexplode(F.split(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", f"{WHITE}+$", ""), _HEADING, ""))
    kind = F.when(F.rlike("line", F.lit(_DIRECTIVE)), "directive").when(trimmed(F.col("line")) == "", "blank").when(symbol_only(F.col("line")), "symbols").otherwise("lyric")
    # a generator's output: filters on the kind stay above it, so that no line is told twice
    return lines.select(id_col, "line_no", F.explode(F.array(F.struct("line", kind.alias("kind")))).alias("_l")).select(id_col, "line_no", "_l.*")


def sheet_meta(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, key, note, title, artist, tonic, mode, source) from directive lines.

    The last of each wins, unknown ones don't count. source is the key's relative major; null without a key.
    """
    name, value = F.lower(F.regexp_extract("line", _DIRECTIVE, 1)), trimmed(F.regexp_extract("line", _DIRECTIVE, 2))
    known = reduce(lambda w, kv: w.when(name.isin(*kv[1]), F.lit(kv[0])), list(DIRECTIVES.items())[1:], F.when(name.isin(*DIRECTIVES["key"]), F.lit("key")))
    found = lines.where("kind = 'directive'").select(id_col, "line_no", known.alias("name"), value.alias("value")).where("name is not null")
    meta = found.groupBy(id_col).agg(*[F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("line_no"))).alias(n) for n in DIRECTIVES])
    key = parse_key(F.col("key"))
    return meta.withColumn("tonic", key["tonic"]).withColumn("mode", key["mode"]).withColumn("source", relative_major(F.col("tonic"), F.col("mode")))


def sheet_symbols(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, symbol): all symbols of a sheet in reading order, trimmed; blank ones and those of directives don't count."""
    marks = lines.where("kind != 'directive'").select(id_col, "line_no", F.posexplode(_symbols(F.col("line"))).alias("at", "symbol")).where("symbol != ''")
    return marks.select(id_col, (F.col("line_no").cast("long") * (1 << 20) + F.col("at")).alias("pos"), "symbol")


def distinct_symbols(symbols: DataFrame, id_col: str, head: int = 12) -> DataFrame:
    """(id, n, head): how many different symbols, and the first of them in reading order."""
    first = symbols.groupBy(id_col, "symbol").agg(F.min("pos").alias("pos"))
    listed = first.groupBy(id_col).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("all"))
    return listed.select(id_col, "n", F.slice(F.transform("all", lambda s: s["symbol"]), 1, head).alias("head"))


def symbol_rows(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, line_no, line, indent): rows of symbols.

    In a run of rows (directives don't end it) all after the first are indented by what labels the first.
    """
    from pyspark.sql import Window

    shown = lines.where("kind != 'directive'")
    by_line = Window.partitionBy(id_col).orderBy("line_no")
    island = F.sum(F.when(F.col("kind") == "symbols", 0).otherwise(1)).over(by_line)
    rows = shown.withColumn("_island", island).where("kind = 'symbols'")
    in_run = Window.partitionBy(id_col, "_island").orderBy("line_no")
    indent = F.when(F.row_number().over(in_run) == 1, "").otherwise(lead_label(F.first("line").over(in_run)))
    return rows.select(id_col, "line_no", "line", indent.alias("indent"))


def rendered_line(line: Column, kind: Column) -> Column:
    """A symbol line above its lyric line: each symbol stands where its text begins, or after the symbol before it.

    Rows of symbols (``kind`` as parse_lines gives it) lose their brackets; plain lines stay.
    """
    start = F.struct(F.lit("").alias("c"), F.lit("").alias("t"))

    def add(acc: Column, s: Column) -> Column:
        symbol = s["symbol"]
        at = F.greatest(F.length(acc["c"]), F.length(acc["t"]))
        over = F.when(symbol == "", acc["c"]).otherwise(F.concat(F.rpad(acc["c"], at, " "), symbol, F.lit(" ")))
        return F.struct(over.alias("c"), F.concat(acc["t"], s["text"]).alias("t"))

    end = r"\s+$"
    done = F.transform(F.array(F.aggregate(segments(line), start, add)), lambda d: F.struct(F.regexp_replace(d["c"], end, "").alias("c"), F.regexp_replace(d["t"], end, "").alias("t")))
    both = F.get(F.transform(done, lambda d: F.when(d["c"] == "", d["t"]).otherwise(F.concat(d["c"], F.lit("\n"), d["t"]))), F.lit(0))
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, _SYMBOL, "$1"), r"\s+", " "))
    return F.when(kind == "symbols", bare).when(kind == "blank", F.lit("")).otherwise(both)


def render_sheets(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, sheet): the plain text of each sheet, without directives; three or more line ends become two, and no white space stands before or after all."""
    shown = lines.where("kind != 'directive'").select(id_col, "line_no", rendered_line(F.col("line"), F.col("kind")).alias("out"))
    joined = shown.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("line_no", "out"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["out"]), "\n")
    return joined.select(id_col, trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("sheet"))


def insert_markers(text: Column, markers: Column) -> Column:
    """The text with [symbol] put in at offsets (code points from 0): markers is an array of (at, symbol).

    Later offsets go first, so earlier ones stay true; of markers at one place the order is kept.
    """
    numbered = F.transform(markers, lambda m, i: F.struct((-m["at"]).alias("a"), (-i).alias("i"), m["symbol"].alias("symbol")))
    put = lambda t, m: F.concat(F.substr(t, F.lit(1), -m["a"]), F.lit("["), m["symbol"], F.lit("]"), F.substr(t, 1 - m["a"]))
    return F.aggregate(F.array_sort(numbered), text, put)
