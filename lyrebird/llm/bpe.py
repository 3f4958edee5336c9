"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens finds, in one pass, the longest token that begins at each place
of a piece. The encoder walks along them and asks a compatibility table whether two tokens may stand side
by side, that is, whether merging their joined text in rank order would give back just these two. Where
not, it tries the next shorter token, and where none is left, it steps back; a place that has failed is
never tried again, so the time is linear in the piece. The first full walk is the exact merge result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.tokens import WORD_BPE, Encoder
from lyrebird.runtime import ship

#: Pairs whose compatibility a worker remembers.
PAIRS = 1_000_000
#: Added to the last character of a piece in vocabularies that mark a word's end.
FINAL = 0x10000
#: Later than any merge.
NEVER = 1 << 60


class Backtracker:
    """Pieces (as byte-level vocabularies write them) to ids, for a BPE model in the library's JSON form."""

    def __init__(self, model: dict):
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.marked = bool(suffix)

        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                return self.mark(token[: -len(suffix)])
            return token

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair, made = (vocab[a], vocab[b]), vocab[(a + b)]
            self.rank[pair] = r
            halves.setdefault(made, (r, *pair))
        self.text = {i: symbols(t) for t, i in vocab.items() if i in halves or len(symbols(t)) == 1}
        by_text = {t: i for i, t in self.text.items()}
        # the tokens down a token's right (left) edge, each with the rank at which it is merged into the next
        self.right_edge = {i: self._edge(i, halves, 2) for i in self.text}
        self.left_edge = {i: self._edge(i, halves, 1) for i in self.text}
        self.shorter = {i: next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), None) for i, t in self.text.items()}
        self.length = {i: len(t) for i, t in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}

    def mark(self, piece: str) -> str:
        return piece[:-1] + chr(ord(piece[-1]) + FINAL) if self.marked else piece

    @staticmethod
    def _edge(token: int, halves: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        out, until = [(token, NEVER)], NEVER
        while token in halves:
            until, token = halves[token][0], halves[token][side]
            out.append((token, until))
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b may be neighbours: no merge across their border comes before both are whole.

        Tokens along a's right edge and b's left edge meet at the border for as long as neither has been
        merged into the next; of equal merges the left one comes first.
        """
        known = self._fits.get((a, b))
        if known is None:
            rank, known = self.rank, True
            for x, x_until in self.right_edge[a]:
                for y, y_until in self.left_edge[b]:
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        known = False
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            self._fits[a, b] = known
        return known

    def encode(self, piece: str) -> list[int]:
        text = self.mark(piece)
        size = len(text)
        longest: list[int | None] = [None] * size
        reach = [0] * size
        for end, (n, token) in self.automaton.iter(text):
            at = end - n + 1
            if n > reach[at]:
                reach[at], longest[at] = n, token
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            while token is not None:
                to = at + self.length[token]
                if not dead[to] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at = to
                token = longest[at] if at < size else None
            elif out:
                dead[at] = 1
                last = out.pop()
                at -= self.length[last]
                token = self.shorter[last]
            else:
                raise ValueError(f"the vocabulary can't write {piece[:40]!r}")
        return out


class OffsetTable:
    """Strings by id in one run of bytes; entry i is from offsets[i] to offsets[i + 1]."""

    def __init__(self, entries: list[bytes]):
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(e) for e in entries])])
        self.sizes = np.diff(self.offsets)

    def gather(self, ids: np.ndarray) -> bytes:
        """The entries of all ids, one after another."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        places = np.repeat(self.offsets[ids] - ends + n, n) + np.arange(ends[-1])
        return self.bytes[places].tobytes()


class Bpe:
    """Both directions for one vocabulary file."""

    #: Ids that are decoded at once, so that memory doesn't follow a text's length.
    CHUNK = 1 << 16

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.encoder = Encoder(path, Backtracker(model).encode)
        known = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.encoder.specials.items()}}
        if self.encoder.tokenizer.decoder is not None:
            raise ValueError("decoding is for vocabularies without a decoder of their own, which join tokens by spaces")
        size = max(known) + 1
        self.tokens = OffsetTable([f"{known.get(i, '')} ".encode() for i in range(size)])
        self.decimals = OffsetTable([f"{i} ".encode() for i in range(size)])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.tokens.gather(ids)[:-1].decode("utf-8")

    def _digest(self, table: OffsetTable, ids: np.ndarray) -> str:
        out = hashlib.sha256()
        for at in range(0, len(ids), self.CHUNK):
            part = table.gather(ids[at : at + self.CHUNK])
            out.update(part if at + self.CHUNK < len(ids) else part[:-1])
        return out.hexdigest()

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """How many ids, and SHA-256 of the decimal ids and of the decoded text."""
        ids = self.encode(text)
        return len(ids), self._digest(self.decimals, ids), self._digest(self.tokens, ids)


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """The coder of this worker process for a vocabulary file."""
    return Bpe(path)


def encode_texts(docs: DataFrame, path: str = WORD_BPE, text_col: str = "text", name: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, whatever its length; a null text is an empty one.

    Null and repeated ids and repeated rows stay as they are; an empty table stays empty; other columns pass
    unchanged. No shuffle.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([bpe(path).encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return docs.withColumn(name, encode(F.col(text_col)))


def decode_ids(docs: DataFrame, path: str = WORD_BPE, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with the text that each list of ids decodes to, whatever its length; null ids give an empty text.

    Repeated rows stay as they are; an empty table stays empty; other columns pass unchanged.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([bpe(path).decode(np.array(ids.as_py() or [], np.int64)) for ids in column], pa.string())

    return docs.withColumn(name, decode(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded by backtracking, decoded by table.

    A null text is an empty one; null and repeated ids and repeated rows stay as they are; an empty table
    gives no rows; a text of any length is encoded whole, in time proportional to it; other columns are not read.
    Rows don't leave their partitions.
    """
    ship(docs.sparkSession)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        own = bpe(path).digests
        return pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), own(t.as_py()), strict=True)) for t in texts], kind)

    return docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col)).alias("d")).select("doc_id", "d.*")
