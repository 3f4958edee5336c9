"""A quality classifier by attention over passages (multiple-instance learning).

Every passage of a text is encoded from its characters and from its words: each word, and its first and last three
bytes, is hashed to a row of an embedding table, and the passage takes the mean of these rows. The table is learned
with all else. A gated attention unit, learned from the
labels of whole documents, weighs the passages; the weighted mean of their hidden representations is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.runtime import ship

#: Bytes of a passage, and of the texts that are encoded at once.
PASSAGE, AT_ONCE = 1024, 1 << 19
#: Labelled documents that a model is fitted on at most, and the passages that these may have together; of a
#: document that is taken all passages count, and scoring sees all passages of all documents.
SAMPLE, SAMPLE_PASSAGES = 6000, 1 << 17
#: Passages that a step of the fit works on at once; a mini-batch with more of them adds up its gradients.
STEP_PASSAGES = 1 << 14
HELD_OUT, THRESHOLD = 5, 0.3
HIDDEN, GATE = 24, 12
#: Rows of the embedding table, and what their weights cost more than others, as there are many.
BUCKETS, BUCKET_DECAY = 512, 300.0

_CLASSES = ("upper", "lower", "digit", "space", "line", "stop", "comma", "bang", "bar", "symbol", "bracket", "other")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), np.uint8)
    for name, chars in (("digit", b"0123456789"), ("space", b" \t\r\v\f"), ("line", b"\n"), ("stop", b".?"), ("comma", b",;:-'"), ("bang", b"!"), ("bar", b"|"), ("bracket", b"()[]{}<>\"/\\_=")):
        table[list(chars)] = _CLASSES.index(name)
    table[0x41:0x5B], table[0x61:0x7B], table[0x80:] = _CLASSES.index("upper"), _CLASSES.index("lower"), _CLASSES.index("other")
    return table


_CLASS = _class_table()
_MIX = np.random.default_rng(7).integers(1, 1 << 62, (16, 256), dtype=np.int64).astype(np.uint64)
SHARES = len(_CLASSES) + 10
FEATURES = SHARES + BUCKETS


def features(text: bytes) -> np.ndarray:
    """The rows of ``encode`` for one text of any length, about AT_ONCE bytes of it at a time.

    A part is encoded together with the four words that begin before it and the end of its own last word; a word
    that goes on for more than a passage beyond a part makes the part longer. So the rows are those of the whole
    text, whatever its words.
    """
    if len(text) <= AT_ONCE:
        return encode([text])[0]
    kind = _CLASS[np.frombuffer(text, np.uint8)]
    wordy = (kind != _CLASSES.index("space")) & (kind != _CLASSES.index("line"))
    edge = np.diff(wordy.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, first = [], 0
    while first < len(text):
        end = first + AT_ONCE
        while True:
            end = min(end, len(text))
            k = int(np.searchsorted(starts, end)) - 1
            ahead = max(end, int(ends[k])) if k >= 0 else end
            if ahead - end <= PASSAGE:
                break
            end = -(-ahead // PASSAGE) * PASSAGE
        before = int(np.searchsorted(starts, first))
        back = min(first, int(starts[max(0, before - 4)])) if before else first
        rows, _ = encode([text[back:ahead]], back % PASSAGE)
        out.append(rows[first // PASSAGE - back // PASSAGE :][: -(-(end - first) // PASSAGE)])
        first = end
    return np.concatenate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose low bits depend on all bits (the end of a common 64-bit mixing hash, whose two factors are fixed values)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def encode(texts: list[bytes], phase: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """One row of features for each passage of each text, and how many passages each text has.

    ``phase``: where in a passage a text begins.

    Shares of kinds of characters; lengths of words; words that repeat the one, two or three before; words
    that are wholly upper case, start with a capital or end in a mark; distinct words; then for each bucket of the
    embedding table the share of the passage's words, of their beginnings and of their ends that fall into it. A
    word belongs to the passage where it begins. An empty text has one passage of zeros.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    passages = np.maximum(1, -(-(sizes + phase) // PASSAGE))
    first = np.cumsum(passages) - passages
    out = np.zeros((int(passages.sum()), FEATURES), np.float32)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if not len(b):
        return out, passages
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    passage = first[doc] + (np.arange(len(b)) - begin[doc] + phase) // PASSAGE
    kind = _CLASS[b]
    n = np.bincount(passage, minlength=len(out)).astype(np.float32)
    n[n == 0] = 1
    mixed = np.bincount(passage * len(_CLASSES) + kind, minlength=len(out) * len(_CLASSES)).reshape(len(out), -1)
    out[:, : len(_CLASSES)] = mixed / n[:, None]
    wordy = (kind != _CLASSES.index("space")) & (kind != _CLASSES.index("line"))
    new_doc = np.zeros(len(b), bool)
    new_doc[begin[sizes > 0]] = True
    starts = np.flatnonzero(wordy & (new_doc | ~np.concatenate([[False], wordy[:-1]])))
    if len(starts):
        ends = np.flatnonzero(wordy & np.concatenate([~wordy[1:] | new_doc[1:], [True]])) + 1
        length = ends - starts
        word = np.repeat(np.arange(len(starts)), length)
        inside = np.flatnonzero(wordy)
        spot = inside - starts[word]
        at_word = np.cumsum(length) - length
        digest = np.add.reduceat(_MIX[spot & 15, b[inside]] * (spot // 16 * 2 + 1).astype(np.uint64), at_word)
        home, of = passage[starts], doc[starts]
        upper = np.add.reduceat((kind[inside] == 0).astype(np.int64), at_word)
        lower = np.add.reduceat((kind[inside] == 1).astype(np.int64), at_word)
        last = kind[ends - 1]
        words = np.bincount(home, minlength=len(out)).astype(np.float32)
        many = np.log1p(words) / 5
        words[words == 0] = 1
        share = lambda flag: np.bincount(home, flag, len(out)) / words
        repeats = []
        for back in (1, 2, 3):
            same = np.zeros(len(starts))
            same[back:] = (digest[back:] == digest[:-back]) & (of[back:] == of[:-back])
            repeats.append(share(same))
        order = np.lexsort((digest, home))
        distinct = np.ones(len(order))
        distinct[order[1:]] = (digest[order[1:]] != digest[order[:-1]]) | (home[order[1:]] != home[order[:-1]])
        columns = [
            np.minimum(share(length) / 10, 3), np.minimum(np.sqrt(share(length.astype(np.float64) ** 2)) / 10, 3), *repeats,
            share((upper > 1) & (lower == 0)), share((upper > 0) & (lower > 0)), share((last >= _CLASSES.index("bang")) & (last <= _CLASSES.index("symbol"))), share(distinct), many,
        ]
        out[:, len(_CLASSES) : SHARES] = np.stack(columns, 1)
        head, tail = np.full(len(starts), 3, np.uint64), np.full(len(starts), 5, np.uint64)
        for k in range(3):
            there = length > k
            head[there] += _MIX[k, b[starts[there] + k]]
            tail[there] += _MIX[k + 8, b[ends[there] - 1 - k]]
        cells = np.concatenate([home * BUCKETS + (_mixed(d) % BUCKETS).astype(np.int64) for d in (digest, head, tail)])
        out[:, SHARES:] = np.bincount(cells, minlength=len(out) * BUCKETS).reshape(len(out), -1) / (3 * words)[:, None]
    return out, passages


class Model:
    """Hidden passage representations, gated attention over them, and a score of the weighted mean."""

    NAMES = ("w", "b", "v", "u", "a", "o", "c")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        parts = [x[i : i + STEP_PASSAGES].astype(np.float64) for i in range(0, len(x), STEP_PASSAGES)] if x.dtype == np.float16 else [x]
        mean = sum(p.sum(0) for p in parts) / len(x)
        spread = np.sqrt(sum(((p - mean) ** 2).sum(0) for p in parts) / len(x))
        return cls(mean, spread + 1e-3, {"w": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "o": draw(HIDDEN), "c": np.zeros(1)})

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Each bag's log-odds; counts[k] rows of x, in order, are bag k."""
        p = self.weights
        first = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (t * g) @ p["a"]
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        mean = np.add.reduceat(weight[:, None] * h, first)
        return mean @ p["o"] + p["c"][0], {"z": z, "h": h, "t": t, "g": g, "weight": weight, "mean": mean, "bag": bag, "first": first}

    def gradients(self, c: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss by each weight; error: of the loss by each bag's log-odds."""
        p, bag, h, t, g = self.weights, c["bag"], c["h"], c["t"], c["g"]
        by_mean = error[:, None] * p["o"]
        by_h = c["weight"][:, None] * by_mean[bag]
        by_weight = (h * by_mean[bag]).sum(1)
        by_s = c["weight"] * (by_weight - np.add.reduceat(c["weight"] * by_weight, c["first"])[bag])
        by_t = by_s[:, None] * p["a"] * g * (1 - t * t)
        by_g = by_s[:, None] * p["a"] * t * g * (1 - g)
        by_h = by_h + by_t @ p["v"].T + by_g @ p["u"].T
        by_in = by_h * (1 - h * h)
        return {"w": c["z"].T @ by_in, "b": by_in.sum(0), "v": h.T @ by_t, "u": h.T @ by_g, "a": (t * g).T @ by_s, "o": c["mean"].T @ error, "c": np.array([error.sum()])}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, counts)[0], -40, 40)))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, at_once: int = STEP_PASSAGES) -> Model:
    """Logistic loss by Adam, the same for the same bags in the same order."""
    sizes = np.array([len(b) for b in bags])
    model = Model.fresh(np.concatenate(bags))
    rng, step = np.random.default_rng(11), 0
    costs = decay * np.where(np.arange(len(model.mean)) < SHARES, 1.0, BUCKET_DECAY)[:, None]
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in model.weights.items()}
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            total: dict[str, np.ndarray] = {}
            for part in _parts(rows, sizes, at_once):
                logit, cache = model.forward(np.concatenate([bags[i] for i in part]).astype(np.float64), sizes[part])
                error = (1 / (1 + np.exp(-logit)) - labels[part]) / len(rows)
                for k, grad in model.gradients(cache, error).items():
                    total[k] = total[k] + grad if k in total else grad
            step += 1
            for k, grad in total.items():
                m, v = moments[k]
                grad = grad + (costs if k == "w" else decay) * model.weights[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                model.weights[k] = model.weights[k] - rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _parts(rows: np.ndarray, sizes: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """Rows in runs of at most at_once passages, or of one row that has more."""
    first, held = 0, 0
    for k, size in enumerate(sizes[rows]):
        if k > first and held + size > at_once:
            yield rows[first:k]
            first, held = k, 0
        held += size
    yield rows[first:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _features(text: str | None) -> np.ndarray:
    return features((text or "").encode("utf-8"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Model:
    """Fit on at most ``sample`` labelled rows that aren't held out: those with the smallest hashes of their ids.

    Rows come in whole, with all their passages: in the order of the hashes as long as those before have fewer
    than ``passages`` together. Only the last row taken can go beyond, so it bounds what the driver holds: about
    1 KB for each passage.
    Labels that are null, or rows without an id, teach nothing; of an id with several labels the largest counts.
    Without any labelled row the model scores everything 0.5.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def bag(texts: pa.Array) -> pa.Array:
        return pa.array([_features(t.as_py()).astype("<f2").tobytes() for t in texts], pa.binary())

    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).where("_id is not null and _quality is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_quality").alias("_quality"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("_text"), F.lit(0)) / PASSAGE))
    sized = texts.select("_id", n.alias("_n")).join(F.broadcast(chosen), "_id").groupBy("_id", "_quality").agg(F.max("_n").alias("_n"))  # at most sample rows
    before = F.sum("_n").over(Window.orderBy(F.xxhash64("_id"), "_id")) - F.col("_n")
    chosen = sized.withColumn("_before", before).where(F.col("_before") < passages).select("_id", "_quality")
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_quality", bag("_text").alias("bag"))
    rows = rows.groupBy("_id", "_quality").agg(F.min("bag").alias("bag"))  # one row for an id, so the sample bounds what is collected
    found = sorted((r["_id"], bytes(r["bag"]), r["_quality"]) for r in rows.collect())
    if not found:
        model = Model.fresh(np.zeros((1, FEATURES)))
        model.weights["o"] = np.zeros(HIDDEN)
        return model
    return fit([np.frombuffer(b, "<f2").reshape(-1, FEATURES) for _, b, _ in found], np.array([q for _, _, q in found], float))


@lru_cache(maxsize=2)
def _revived(packed: bytes) -> Model:
    return Model(*pickle.loads(packed))


def scorer(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each whole text, from 0 to 1; higher: label 1 likelier."""
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.mean, model.scale, model.weights)))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _revived(packed.value)
        for column in texts:
            out, held, size = [], [], 0
            for t in column:
                text = (t.as_py() or "").encode("utf-8")
                if len(text) > AT_ONCE:  # a text of its own
                    if held:
                        out.append(own.scores(*encode(held)))
                        held, size = [], 0
                    rows = features(text)
                    out.append(own.scores(rows, np.array([len(rows)])))
                    continue
                held.append(text)
                size += len(held[-1])
                if size > AT_ONCE:
                    out.append(own.scores(*encode(held)))
                    held, size = [], 0
            if held:
                out.append(own.scores(*encode(held)))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(F.col(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of docs.

    Only the text goes into a score. A null text is an empty one and gets a score too; a null id is not held
    out; repeated rows score alike; an empty table gives no rows; other columns are not read. A text of any length
    is encoded whole, by parts that give the same passages.
    """
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), scorer(docs, model, text_col).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
