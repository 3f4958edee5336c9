"""Personal data, plain or disguised, with spans that always count the source's own code points.

Small transducers rewrite a text: look-alike characters to plain ones, spelled digits to digits, words and
brackets that stand for @ and dots to these. Each keeps where what it wrote came from. Identifiers are then
looked for in the rewritten text, and their spans are mapped back, transducer by transducer, to the source.
The identity is the first reading of every text; what it finds always stays.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.runtime import ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins within a run of digits, as it would have begun before; this keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters and signs that look like plain ones (Cyrillic, Greek, Armenian, small capitals and other Latin, dots, signs).
_LOOKS = {
    "аеорсхуіѕјԁһԛԝкмтвнӏѵѡүґпгиАВЕКМНОРСТУХІЅЈҮԌԚԜ": "aeopcxyisjdhqwkmtbhlvwyrnruABEKMHOPCTYXISJYGQW",
    "αοινρυκτωηχβγςΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "aoivpuktwnxbycABEZHIKMNOPTYX",
    "օսհոզցքյևԼՕՍ": "ouhnqgpjuLOU",
    "ᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢıɑɡɩʋøđł": "abcdeghijklmnoprtuvwyziagivodl",
    "∙•․·‧⋅。｡": "........",
    "＠﹫﹒﹢－‐‑‒–−": "@@.+------",
}
# Characters without a width, which are left out.
INVISIBLE = "​‌‍⁠﻿­"
# Words for digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for @ and for a dot; those in the second group of each are words of prose as well.
_AT_WORDS, _AT_PROSE = "arroba|arobase|klammeraffe|ät", "at"
_DOT_WORDS, _DOT_PROSE = "dot", "punkt|point|punto"
# Endings of hosts that are taken for such where only their context tells.
TOPS = frozenset("com org net edu gov info biz io co ai app dev me eu de at ch fr es it nl be pl pt se no dk fi ie uk us ca au nz mx ar br cl ru ua jp cn in example".split())
# Words that stand before "at" and a host in prose.
_NO_NAME = frozenset(
    "us me him her them it you someone anyone everyone somebody anybody everybody nobody people he she we they i one this that these those all is are be was were mail email out look looks find found available more info information online site website page pages home shop store visit here there "
    "contact reach hosted host located live lives based office blog news team support help read see check download downloads docs files file free only start now today not and or but team event events join meet meeting".split()
)


def _plain_forms() -> dict[str, str]:
    """Characters whose compatibility form is one plain character, and the decimal digits of all scripts."""
    out = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x20000)]):
        value = unicodedata.decimal(c, None)
        if value is not None:
            out[c] = str(value)
        elif not unicodedata.decomposition(c).startswith(("<super>", "<sub>")):
            form = unicodedata.normalize("NFKC", c)
            if len(form) == 1 and " " <= form <= "~":
                out[c] = form
    return out


LOOKALIKES = _plain_forms() | {c: plain for looks, plains in _LOOKS.items() for c, plain in zip(looks, plains, strict=True)}

_GLYPHS = frozenset(LOOKALIKES) | frozenset(INVISIBLE)


def _class(chars: Iterable[str]) -> str:
    """A class of characters, as ranges: a long list of single ones beyond the basic plane would be slow to match."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_GLYPH = re.compile(_class(_GLYPHS))
_NUMBER = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_FIRST = "(?=[" + "".join(sorted({w[0] for w in DIGIT_WORDS})) + "])"
# words for digits and digits, with a little between them or none
_SPELLED = re.compile(rf"(?<![\w.@])(?:{_NUMBER}|[0-9]++)(?:[ \t-]{{0,3}}(?:{_NUMBER}|[0-9]++)){{2,}}(?![\w@])", re.I)
_PARTS = re.compile(rf"{_NUMBER}|[0-9]+", re.I)
# the same after a plus, where commas and brackets may stand between
_CALLED = re.compile(rf"(?:(?<![\w.@])plus[ \t]{{1,3}}|\+[ \t]{{0,2}})(?:{_NUMBER}|[0-9]++)(?:[ \t().,-]{{0,4}}(?:{_NUMBER}|[0-9]++)){{2,}}(?![\w@])", re.I)
# four numbers of up to three digits with dots or words for these between
_OCTET = rf"(?:{_NUMBER}|[0-9]{{1,3}}+)(?:[ \t-]{{0,3}}(?:{_NUMBER}|[0-9])){{0,2}}"
_OCTET_ENDS = re.compile(rf"[ \t]+(?:{_DOT_WORDS}|{_DOT_PROSE})[ \t]+|\.", re.I)
_DOTTED = re.compile(rf"(?<![\w.@]){_OCTET}(?:(?:[ \t]{{1,3}}(?:{_DOT_WORDS}|{_DOT_PROSE})[ \t]{{1,3}}|\.){_OCTET}){{3}}(?![\w@])", re.I)
# Entities and percent codes of @, . and +.
CODES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "%2e": ".", "&#43;": "+", "&#x2b;": "+", "&plus;": "+", "%2b": "+"}
_CODE = re.compile("|".join(CODES), re.I)
# letters one by one, or blanks around @ and dots; a name is looked for in so many characters before an @
_REACH = 140
_LETTERS = r"[A-Za-z0-9](?:[ \t][A-Za-z0-9-])+(?![A-Za-z0-9-])"
_NAME_BEFORE = re.compile(r"(?:(?P<letters>(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[ \t][A-Za-z0-9._+-]){2,63})|(?P<word>[A-Za-z0-9._%+-]+))(?P<gap>[ \t]{0,3})$")
_HOST_AFTER = re.compile(rf"@(?P<gap>[ \t]{{0,3}})(?P<host>(?:{_LETTERS}|[A-Za-z0-9-]{{1,63}}+)(?:(?:\.|[ \t]{{1,3}}\.[ \t]{{1,3}})(?:{_LETTERS}|[A-Za-z0-9-]{{1,63}}+))+)")
# Every pattern takes time in proportion to a text: it begins only where a run begins, and gives nothing back.
_OPEN, _CLOSE = r"(?:(?<![ \t])[ \t]++)?[\[({<][ \t]*+", r"[ \t]*+[\])}>][ \t]*+"
_AT = re.compile(rf"{_OPEN}(?:{_AT_WORDS}|{_AT_PROSE}|@){_CLOSE}", re.I)
_DOT = re.compile(rf"{_OPEN}(?:{_DOT_WORDS}|{_DOT_PROSE}|\.){_CLOSE}", re.I)
# "name at host dot tld": bare words count only in this whole shape, or before a plain host where the context tells
_BLANKS = r"(?<![ \t])[ \t]++"
_LINK = re.compile(rf"(?P<at>{_BLANKS}(?:{_AT_WORDS}|{_AT_PROSE})[ \t]++|@)(?P<host>[A-Za-z0-9-]++(?:(?:[ \t]++(?:{_DOT_WORDS}|{_DOT_PROSE})[ \t]++|\.)[A-Za-z0-9-]++)*)", re.I)
_BORDER = re.compile(r"\b")
_BARE_DOT = re.compile(rf"{_BLANKS}(?:{_DOT_WORDS}|{_DOT_PROSE})[ \t]++", re.I)
_PROSE_DOT = re.compile(rf"{_BLANKS}(?:{_DOT_PROSE})[ \t]++", re.I)
_CUE = re.compile(r"\b(?:e-?mails?|mailto|contact|write|reach|address|send)(?:[ \t]+(?:to|is|address))*[ \t]*[:=]?[ \t]*$", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])[ \t]++(?:{_DOT_WORDS}|{_DOT_PROSE})[ \t]++(?=[0-9])", re.I)
_VERBAL = re.compile(r"(?:ed|ing|able|ible|ly)$", re.I)
_MARKED_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[._+][A-Za-z0-9]+)+|[A-Za-z]{2,}[0-9]+", re.A)
#: What a text must have, or else a look-alike, for a transducer to change it.
_TRIGGER = re.compile(
    rf"[\[({{<][ \t]*+(?:{_AT_WORDS}|{_AT_PROSE}|{_DOT_WORDS}|{_DOT_PROSE}|@|\.)[ \t]*+[\])}}>]|\b(?:{_AT_WORDS}|{_DOT_WORDS})\b|[0-9][ \t]++(?:{_DOT_PROSE})[ \t]++[0-9]"
    rf"|[ \t]@|@[ \t]|@[a-z0-9][ \t][a-z0-9][ \t]|@[a-z0-9-]{{1,63}}+[ \t]|&(?:\#(?:64|x40|46|x2e|43|x2b)|commat|period|plus);|%(?:40|2e|2b)"
    rf"|\bat[ \t]++[a-z0-9-]++(?:\.|[ \t]++(?:{_DOT_PROSE})[ \t]++)[a-z0-9-]|\b{_FIRST}{_NUMBER}[ \t-]{{0,3}}(?:{_NUMBER}|[0-9])|[0-9][ \t-]{{0,3}}{_NUMBER}", re.I,
)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Plain identifiers: for each kind the leftmost matches, none overlapping; failing ones are dropped."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        first = at
        while first > last and _LOCAL.match(text[first - 1]):
            first -= 1
        m = _DOMAIN.match(text, at) if first < at else None
        if m:
            out.append(("email", first, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Rewrite:
    """A text with edits (start, end, new) applied, and the way back."""

    def __init__(self, text: str, edits: Iterable[tuple[int, int, str]]):
        parts, self._new, self._old = [], [], []  # each part's place in the new and its span in the old text
        at = place = 0
        for start, end, new in edits:
            if start < at:
                continue
            for s, e, body, changed in ((at, start, text[at:start], False), (start, end, new, True)):
                if body:
                    self._new.append(place)
                    self._old.append((s, e, changed))
                    parts.append(body)
                    place += len(body)
            at = end
        if at < len(text):
            self._new.append(place)
            self._old.append((at, len(text), False))
            parts.append(text[at:])
        self.text = "".join(parts)

    def _part(self, place: int) -> tuple[int, tuple[int, int, bool]]:
        k = bisect_right(self._new, place) - 1
        return place - self._new[k], self._old[k]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source's span of a span here; what touches a rewritten part takes all of it."""
        shift, (s, _, changed) = self._part(start)
        first = s if changed else s + shift
        shift, (s, e, changed) = self._part(end - 1)
        return first, e if changed else s + shift + 1


def _glyphs(text: str) -> Iterable[tuple[int, int, str]]:
    return () if text.isascii() else ((m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _GLYPH.finditer(text))


def _coded(text: str) -> Iterable[tuple[int, int, str]]:
    return ((*m.span(), CODES[m[0].lower()]) for m in _CODE.finditer(text)) if "%" in text or "&" in text else ()


def _spelled(text: str) -> Iterable[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        parts = _PARTS.findall(m[0])
        if not all(p.isdigit() for p in parts):
            out.append((m.start(), m.end(), _digits(parts)))
    for m in _CALLED.finditer(text):
        parts = _PARTS.findall(m[0])
        if not all(p.isdigit() for p in parts) and 9 <= len(_digits(parts)) <= 15:
            out.append((m.start(), m.end(), "+" + _digits(parts)))
    for m in _DOTTED.finditer(text):
        octets = [_PARTS.findall(o) for o in _OCTET_ENDS.split(m[0])]
        if not all(p.isdigit() for o in octets for p in o):
            out.append((m.start(), m.end(), ".".join(map(_digits, octets))))
    return sorted(out, key=lambda e: (e[0], -e[1]))


def _digits(parts: list[str]) -> str:
    return "".join(DIGIT_WORDS.get(p.lower(), p) for p in parts)


def _spaced(text: str) -> Iterable[tuple[int, int, str]]:
    at = text.find("@")
    while at >= 0:
        host = _HOST_AFTER.match(text, at)
        name = _NAME_BEFORE.search(text[max(0, at - _REACH) : at]) if host else None
        if name and (name["letters"] or name["gap"] or host["gap"] or " " in host["host"] or "\t" in host["host"]):
            start = max(0, at - _REACH) + name.start()
            plain = re.sub(r"[ \t]", "", host["host"])
            letters = bool(name["letters"]) and not name["letters"].strip().isdigit()
            wide = re.search(r"[ \t]\.", host["host"]) and plain.rpartition(".")[2].lower() in TOPS
            known = (name["word"] or "").lower() not in _NO_NAME and (_CUE.search(text[max(0, start - 40) : start]) or _MARKED_NAME.fullmatch(name["word"] or ""))
            if letters or wide or known and plain.rpartition(".")[2].lower() in TOPS:
                yield start, host.end(), re.sub(r"[ \t]", "", name["letters"] or name["word"]) + "@" + plain
        at = text.find("@", host.end() if host else at + 1)


def _bracketed(text: str) -> Iterable[tuple[int, int, str]]:
    return sorted([(*m.span(), "@") for m in _AT.finditer(text)] + [(*m.span(), ".") for m in _DOT.finditer(text)])


def _named(text: str, begin: int, at: int) -> int:
    """Where a name begins that ends at ``at``: at the first border of a word among its characters; ``at`` where there is none."""
    first = at
    while first > begin and _LOCAL.match(text[first - 1]):
        first -= 1
    border = _BORDER.search(text, first, at) if first < at else None
    return border.start() if border else at


def _mailed(text: str, m: re.Match[str], start: int) -> bool:
    """Whether "name at host.tld" is an address.

    Name and tld can be such, and a word for mail comes before it, or the name has marks or digits as names of
    accounts have, or it begins a text, a line or a clause and is no word that prose has there.
    """
    host, name = m["host"], text[start : m.start("at")]
    top = host.rpartition(".")[2]
    if "." not in host or len(top) < 2 or not top.isalpha() or top.istitle() or name.lower() in _NO_NAME:
        return False
    before = text[max(0, start - 40) : start]
    if m["at"].strip().lower() != _AT_PROSE or _CUE.search(before):
        return True
    if top.lower() not in TOPS or host.lower().startswith("www."):
        return False
    return bool(_MARKED_NAME.fullmatch(name)) or (name.isalpha() and not _VERBAL.search(name) and before.rstrip(" \t")[-1:] in ("", "\n", ":", ";", ",", "(", "<", '"'))


def _worded(text: str) -> Iterable[tuple[int, int, str]]:
    edits = [(*m.span(), ".") for m in _DIGIT_DOT.finditer(text)]
    last = place = 0
    while m := _LINK.search(text, place):
        start = _named(text, last, m.start("at"))
        if start == m.start("at"):
            place = m.start("at") + 1
            continue
        last = place = m.end()
        dots = [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in _BARE_DOT.finditer(m["host"])]
        # words for a dot that prose has as well need a host's ending after them, and more than a bare "at"
        sure = not _PROSE_DOT.search(m["host"]) or (
            re.split(r"[ \t.]+", m["host"])[-1].lower() in TOPS and (m["at"].strip().lower() != _AT_PROSE or bool(_CUE.search(text[max(0, start - 40) : start])))
        )
        if dots and sure or not dots and m["at"] != "@" and _mailed(text, m, start):
            edits += [(*m.span("at"), "@"), *dots]
    return sorted(edits)


TRANSDUCERS = (_glyphs, _coded, _spelled, _spaced, _bracketed, _worded)


def disguised(text: str) -> list[Span]:
    """Source spans of identifiers that show only after rewriting."""
    if (text.isascii() or _GLYPHS.isdisjoint(text)) and not _TRIGGER.search(text):
        return []
    chain: list[Rewrite] = []
    now = text
    for transducer in TRANSDUCERS:
        edits = list(transducer(now))
        if edits:
            chain.append(Rewrite(now, edits))
            now = chain[-1].text
    out = []
    for kind, start, end in identifiers(now) if chain else ():
        found = now[start:end]
        for step in reversed(chain):
            start, end = step.back(start, end)
        if text[start:end] != found:
            out.append((kind, start, end))
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: a disguised one counts unless it lies within a base one of its kind."""
    if not text:
        return [], []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(identifiers(text), key=order)
    own = {k: [s for s in base if s[0] == k] for k in KINDS}

    def within(s: Span) -> bool:
        k = bisect_right(own[s[0]], s[1], key=lambda b: b[1])
        return k > 0 and s[2] <= own[s[0]][k - 1][2]

    more = [s for s in disguised(text) if not within(s)]
    return base, sorted({*base, *more}, key=order)


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap go together."""
    _, found = spans(text)
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if found else text


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256 and spans (all), one row for each row.

    A null text is an empty one: no spans, the digest of an empty string. Null and repeated ids and repeated
    rows stay as they are; an empty table gives no rows; other columns are not read. A text of any length is
    read whole, in time and memory proportional to it, whatever runs it holds. No shuffle.
    """
    ship(docs.sparkSession)
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string>")
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            base, every = spans(t.as_py())
            counts = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
            out.append(counts | {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(every)})
        return pa.array(out, kind)

    return docs.select(F.col(id_col).alias("doc_id"), find(F.col(text_col)).alias("p")).select("doc_id", "p.*")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of the text column replaced by their kinds.

    A null text stays null, an empty one empty; repeated rows stay; an empty table stays empty; other columns
    pass unchanged; a text of any length takes time proportional to it. No shuffle.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(t.as_py()) for t in texts], pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))
