"""Symbol and key functions on columns. Pitch classes are 0 (C) to 11 (B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrebird.functions.text import WHITE, trimmed

# Note names, steps of the natural notes, and scale degrees.
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
NATURALS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
FLAT_KEYS = (1, 3, 5, 8, 10)
MAJOR_SCALE = ((0, "maj"), (2, "min"), (4, "min"), (5, "maj"), (7, "maj"), (9, "min"), (11, "dim"))
MINOR_SCALE = ((0, "min"), (2, "dim"), (3, "maj"), (5, "min"), (7, "maj"), (8, "maj"), (10, "maj"))
SUFFIX = {"maj": "", "min": "m", "dim": "°"}
QUALITIES = tuple(SUFFIX)

_ROOT = r"^([A-G])([#♯b♭]?)"
_KEY = rf"(?i)^([A-G])([#♯b♭]?){WHITE}*(m|min|minor)?$"


def _names(flats: Column) -> Column:
    return F.when(flats, F.array(*map(F.lit, FLATS))).otherwise(F.array(*map(F.lit, SHARPS)))


def note_name(pitch: Column, flats: Column) -> Column:
    return F.get(_names(flats), F.pmod(pitch, F.lit(12)).cast("int"))


def key_label(pitch: Column) -> Column:
    """Both names where they differ, as in C#/Db."""
    sharp, flat = note_name(pitch, F.lit(False)), note_name(pitch, F.lit(True))
    return F.when(sharp == flat, sharp).otherwise(F.concat(sharp, F.lit("/"), flat))


def parse_root(symbol: Column) -> Column:
    """The pitch class that a symbol's name begins with, or null."""
    letter, mark = F.regexp_extract(symbol, _ROOT, 1), F.regexp_extract(symbol, _ROOT, 2)
    base = reduce(lambda w, kv: w.when(letter == kv[0], F.lit(kv[1])), list(NATURALS.items())[1:], F.when(letter == "C", F.lit(0)))
    shift = F.when(mark.isin("#", "♯"), 1).when(mark.isin("b", "♭"), -1).otherwise(0)
    return F.pmod(base + shift, F.lit(12))


def root_length(symbol: Column) -> Column:
    return F.length(F.regexp_extract(symbol, _ROOT, 0))


def transpose(symbol: Column, delta: Column, flats: Column) -> Column:
    """Every part between slashes moved by delta half tones; all parts must begin with a root, else nothing changes."""
    step = F.pmod(delta, F.lit(12))
    parts = F.split(symbol, "/")
    known = F.forall(parts, lambda p: F.rlike(p, F.lit(_ROOT)))
    moved = F.transform(parts, lambda p: F.concat(note_name(parse_root(p) + step, flats), F.substr(p, root_length(p) + 1)))
    return F.when((F.trim(symbol) == "") | (delta == 0) | ~known, symbol).otherwise(F.array_join(moved, "/"))


def transpose_all(symbols: Column, delta: Column, flats: Column) -> Column:
    return F.transform(symbols, lambda c: transpose(c, delta, flats))


def prefer_flats(tonic: Column) -> Column:
    """Whether a major key is written with flats."""
    return tonic.isin(*FLAT_KEYS)


def relative_major(tonic: Column, mode: Column) -> Column:
    return F.when(mode == "minor", F.pmod(tonic + 3, F.lit(12))).otherwise(tonic)


def symbol_quality(symbol: Column) -> Column:
    """maj, min or dim, from what follows the root (a bass after a slash doesn't count).

    The name is lower-cased first, so a capital M before a number reads as minor, as it always has.
    """
    head = F.element_at(F.split(symbol, "/"), 1)
    rest = F.lower(F.trim(F.substr(head, root_length(head) + 1)))
    return (
        F.when(F.rlike(rest, F.lit("^(dim|°$|ø|m7b5)")), "dim")
        .when(F.rlike(rest, F.lit("^(maj|ma7)")), "maj")
        .when(F.startswith(rest, F.lit("m")), "min")
        .otherwise("maj")
    )


def diatonic_symbol(tonic: Column, degree: Column, flats: Column, minor: bool = False) -> Column:
    """The symbol on the degree (0 to 6) of a key."""
    scale = MINOR_SCALE if minor else MAJOR_SCALE
    steps, ends = F.array(*[F.lit(s) for s, _ in scale]), F.array(*[F.lit(SUFFIX[q]) for _, q in scale])
    return F.concat(note_name(tonic + F.get(steps, degree), flats), F.get(ends, degree))


def signed_delta(source: Column, target: Column) -> Column:
    """The shorter way from one tonic to another, from -5 to 6."""
    d = F.pmod(target - source, F.lit(12))
    return F.when(d > 6, d - 12).otherwise(d)


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.65, "mid").otherwise("low")


def default_tonic(declared: Column, detected: Column, confidence: Column) -> Column:
    """The declared key, else a detected one that is sure enough, else C."""
    return F.coalesce(declared, F.when(confidence >= 0.5, detected), F.lit(0))


def parse_key(value: Column) -> Column:
    """(tonic, mode) of a key directive such as ``F#m`` or ``bb minor``; null if it is anything else."""
    text = trimmed(value)
    letter, mark = F.upper(F.regexp_extract(text, _KEY, 1)), F.regexp_extract(text, _KEY, 2)
    # a capital B after the letter is taken for a mark, but moves nothing
    root = parse_root(F.concat(letter, F.when(mark == "B", "").otherwise(mark)))
    mode = F.when(F.regexp_extract(text, _KEY, 3) != "", "minor").otherwise("major")
    return F.when(F.rlike(text, F.lit(_KEY)), F.struct(root.alias("tonic"), mode.alias("mode")))


def norm_symbol(value: Column) -> Column:
    """``C-sharp-m`` as ``C#m``: a word for a sign goes with the hyphens around it; other hyphens and words stay."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("-sharp-", "#"), ("-flat-", "b"), ("-sharp", "#"), ("-flat", "b")), value)


def key_weights(tonic: int, minor: bool) -> list[int]:
    """Twice the score of each root with each quality (root * 3 + its place in QUALITIES) for a key: 2 for a symbol of
    the key, 1 for its root alone, 0 else."""
    out = [0] * (12 * len(QUALITIES))
    for step, quality in MINOR_SCALE if minor else MAJOR_SCALE:
        at = (tonic + step) % 12 * len(QUALITIES)
        for k, q in enumerate(QUALITIES):
            out[at + k] = 2 if q == quality else 1
    return out
