"""Whole texts to token ids, fast: exact pieces are encoded once and remembered.

Both vocabularies here cut a text before any single space that stands between two other characters, so a
text may be encoded one space-separated chunk at a time. Chunks repeat, so a bounded memory of chunks
does most of the work; what is not in it goes through a model's own steps.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Chunks that a worker remembers, in each of two generations.
REMEMBERED = 500_000
#: Longer chunks are encoded anew each time, so that memory stays bounded.
LONGEST = 48
#: Whether a chunk is one word of plain letters.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Marks that are one piece when they follow a word.
MARKS = ".,;:!?*%&$#|"


class ChunkMemory(dict):
    """Chunk to the little-endian 32-bit ids of its tokens. The older generation goes when the newer is full."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = REMEMBERED):
        super().__init__()
        self._encode, self._limit, self._older = encode, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self._older.get(chunk) or self._encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self._limit:
                self._older = dict(self)
                self.clear()
            self[chunk] = out
        return out


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


_SHOWN = byte_characters()
_SHOWN_TABLE = {b: _SHOWN[b] for b in range(256)}


SPACE = _SHOWN[0x20]


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def shown(piece: str) -> str:
    """A piece as a byte-level vocabulary writes it."""
    return piece.encode("utf-8").decode("latin-1").translate(_SHOWN_TABLE)


def load(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Encoder:
    """Texts to ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    ``model``: a byte-level piece to ids; by default the library's own BPE model. ``remembered``: chunks that are
    remembered, in each of two generations; the ids don't depend on it.
    """

    def __init__(self, path: str, model: Callable[[str], list[int]] | None = None, remembered: int = REMEMBERED):
        self.tokenizer = load(path)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._special = re.compile("|".join(sorted(map(re.escape, self.specials), key=len, reverse=True)) or "(?!)")
        own = self.tokenizer.model
        self.model = model or (lambda piece: [t.id for t in own.tokenize(piece)])
        self.spaced = self.tokenizer.normalizer is None  # a space belongs to the word after it
        self._ends = ChunkMemory(lambda piece: _little_endian(self.model(piece)), 10_000)
        self._memory = ChunkMemory(self._chunk, remembered)

    def _pieces(self, text: str) -> list[str]:
        normalizer = self.tokenizer.normalizer
        text = normalizer.normalize_str(text) if normalizer else text
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _bytes(self, pieces: list[str]) -> bytes:
        return b"".join([_little_endian(self.model(p)) for p in pieces])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that stands after a space. Plain words, and plain words with marks after them, take a short way."""
        if PLAIN(chunk):
            if self.spaced:
                return _little_endian(self.model(SPACE + (chunk if chunk.isascii() else shown(chunk))))
            low = chunk.lower()
            if low != chunk:
                return self._memory[low]
            return _little_endian(self.model(chunk if chunk.isascii() else shown(chunk)))
        word = chunk.rstrip(MARKS)
        if word and len(word) < len(chunk) and PLAIN(word):
            return self._memory[word] + self._ends[chunk[len(word) :]]
        return self._bytes(self._pieces(" " + chunk))

    def _part(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        if self.spaced:
            if "  " in text:  # a run of spaces is cut by what follows it
                return self._bytes(self._pieces(text))
            first, *rest = text.split(" ")
            return (self._bytes(self._pieces(first)) if first else b"") + b"".join(map(self._memory.__getitem__, rest))
        return b"".join(map(self._memory.__getitem__, text.split(" ")))

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; a null text is an empty one."""
        if not text:
            return b""
        if "<|" not in text or not self._special.search(text):
            return self._part(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._part(text[at : m.start()]), np.array([self.specials[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._part(text[at:])])


class RankEncoder(Encoder):
    """The same ids for a byte-level vocabulary, from its ranks; nothing is remembered between texts.

    The pattern takes a run of white space as one piece, but for its last character where something follows.
    Its matcher would overflow its stack on very long runs, so these pieces are cut out here.
    """

    #: What the pattern calls white space, in runs that are cut out.
    WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

    def __init__(self, path: str):
        super().__init__(path)
        raw = {c: b for b, c in enumerate(_SHOWN)}
        special = set(self.specials)
        ranks = {bytes(map(raw.__getitem__, t)): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self._ranks = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _part(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.WHITE.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self._ranks(text[at : m.start()])
            out += self.model(shown(text[m.start() : end]))
            at = end
        return _little_endian(out + self._ranks(text[at:]) if out else self._ranks(text[at:]))


@lru_cache(maxsize=1)
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this worker process for a vocabulary file."""
    return Encoder(path, remembered=remembered)
