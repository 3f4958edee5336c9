"""Text functions on columns: names, search keys, slugs, URLs and escapes.

White space is spelled out where it matters, as the shorthand classes of regular expressions differ.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All that counts as white space in names and queries.
WHITE = r"[\s\u000B\u0085   -     　﻿]"


def trimmed(c: Column, white: str = WHITE) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{white}+", ""), f"{white}+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space to one space, none at either end."""
    return trimmed(F.regexp_replace(c, f"{WHITE}+", " "))


def clean_name(c: Column, prefix: str = "", empty: str = "untitled") -> Column:
    """A title that is safe as a file name.

    The prefix goes once, if it is there. Characters that file systems refuse become underscores before
    white space collapses, so a tab becomes an underscore and not a space.
    """
    cut = F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c) if prefix else c
    safe = F.regexp_replace(cut, r'[<>:"/\\|?*\u0000-\u001F]', "_")
    name = F.regexp_replace(collapsed(safe), r"[. ]+$", "")
    return F.when(name == "", F.lit(empty)).otherwise(name)


def capped_file_name(name: Column, id_: Column, extension: Column, cap: int = 180) -> Column:
    """name + extension in at most ``cap`` code points; a longer stem is cut so that ``_id`` and extension fit."""
    tail = F.concat(F.lit("_"), id_.cast("string"), extension)
    whole = F.concat(name, extension)
    return F.when(F.length(whole) <= cap, whole).otherwise(F.concat(F.substring(name, F.lit(1), F.lit(cap) - F.length(tail)), tail))


@F.pandas_udf(StringType())
def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(unescape, na_action="ignore")


def search_key(c: Column, nfc: bool = True) -> Column:
    """Lower case, composed (NFC), white space collapsed. Without ``nfc`` it stays inside the JVM."""
    low = F.lower(c)
    return collapsed(_nfc(low) if nfc else low)


def query_tokens(query: str) -> list[str]:
    return unicodedata.normalize("NFC", query.lower()).split()


def has_all(key: Column, query: str) -> Column:
    """Every token of the query is somewhere in the key, in any order; a blank query matches everything."""
    return reduce(lambda a, b: a & b, [F.contains(key, F.lit(t)) for t in query_tokens(query)], F.lit(True))


def has_run(c: Column, query: str) -> Column:
    """The trimmed query as it is, somewhere in the lower-cased text; the text's own white space counts."""
    return F.contains(F.lower(c), F.lit(query.strip().lower()))


def slugify(c: Column, empty: str = "song") -> Column:
    """Lower case, separators to hyphens, letters and numbers kept (combining marks are not), hyphens squeezed."""
    s = F.regexp_replace(F.lower(c), rf"(?:{WHITE}|_)+", "-")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}-]", "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s)


# What form encoding writes otherwise than encodeURIComponent.
_URI = (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"))


def encode_uri(c: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), _URI, F.url_encode(c))


def xml_escape(c: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), c)


def regex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def name_tokens(c: Column, least: int = 2) -> Column:
    """Parts of a name between white space, underscores and hyphens, of at least ``least`` characters."""
    return F.filter(F.split(F.lower(c), rf"(?:{WHITE}|[_-])+"), lambda t: F.length(t) >= least)


def odd_characters(c: Column) -> Column:
    """Whether a text has control, format or separator characters other than the space."""
    return F.rlike(c, F.lit(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"))


def is_image(src: Column, extensions: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".gif", ".webp")) -> Column:
    """Whether the last path segment, without trailing slashes, ends like an image; null: no."""
    last = F.substring_index(F.regexp_replace(F.lower(src), "/+$", ""), "/", -1)
    return F.coalesce(reduce(lambda a, b: a | b, [F.endswith(last, F.lit(e)) for e in extensions]), F.lit(False))


def image_kind(content: Column) -> Column:
    """The format that the first bytes name, or null."""
    head = F.hex(F.substring(content, 1, 12))
    kinds = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "474946383761"), ("gif", "474946383961"), ("bmp", "424D"))
    found = reduce(lambda w, k: w.when(F.startswith(head, F.lit(k[1])), F.lit(k[0])), kinds[1:], F.when(F.startswith(head, F.lit(kinds[0][1])), F.lit(kinds[0][0])))
    return found.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))


def only_script(c: Column, script: str = r"฀-๿") -> Column:
    """What is left of a text in one block of characters."""
    return F.regexp_replace(c, f"[^{script}]", "")


def clean_response(c: Column) -> Column:
    """A model's answer without its thinking blocks and an outer code fence."""
    s = trimmed(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    return trimmed(F.regexp_replace(F.regexp_replace(s, r"^```[A-Za-z]*[ \t]*\n?", ""), r"\n?```$", ""))


def salvaged_json(c: Column, schema: str) -> Column:
    """The JSON of a text, else of its outermost braces, else null."""
    whole = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    usable = F.rlike(trimmed(c), F.lit(r"(?s)^\{.*\}$"))
    return F.when(usable, whole).otherwise(F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"}))


def html_text(c: Column, entities: bool = True) -> Column:
    """HTML as lines: breaks and closing blocks are line ends, other tags go, entities are read."""
    lines = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:div|p|h3)>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]+>", "")
    return F.replace(_unescape(plain) if entities else plain, F.lit(" "), F.lit(" "))


def same_host(url: Column, host: str) -> Column:
    """Whether a URL is on a host; what can't be parsed is not."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")) == host, F.lit(False))


def url_suffix(url: Column, default: str = ".png") -> Column:
    """The lower-cased ending, with its dot, of a URL's path; a path without one has the default."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"^//[^/?#]*", ""), r"[?#].*$", "")
    name = F.regexp_replace(F.substring_index(F.regexp_replace(path, r";[^/]*$", ""), "/", -1), r"^\.+", "")
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(ending == "", F.lit(default)).otherwise(ending)


def room_code(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit("^[0-9]{6}$")), F.lit(False))


def route(path: Column) -> Column:
    """(room, song, slug) of /room, /room/song and /song/id/slug paths; parts that aren't there are null."""
    room = F.nullif(F.regexp_extract(path, r"^/([0-9]{6})(?:/|$)", 1), F.lit(""))
    song = F.nullif(F.coalesce(F.nullif(F.regexp_extract(path, r"^/[0-9]{6}/([0-9]+)/?$", 1), F.lit("")), F.regexp_extract(path, r"^/song/([0-9]+)(?:/|$)", 1)), F.lit(""))
    slug = F.nullif(F.regexp_extract(path, r"^/song/[0-9]+/([^/]+)/?$", 1), F.lit(""))
    return F.struct(room.alias("room"), song.try_cast("long").alias("song"), slug.alias("slug"))
