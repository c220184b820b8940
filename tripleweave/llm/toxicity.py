"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 1).

A word is a bag of hashed byte n-grams (3 to 6 bytes, the ends marked), so an unseen or misspelt word shares vectors with its
kin. The vectors of a window of words, each word once, are averaged and go through a linear softmax; vectors and softmax are trained jointly in
numpy. A document is toxic if some window is: training starts with windows of a toxic document as positive, and then keeps as
positive only those the model itself finds, so the neutral rest of long documents is unlearnt. A document's score is that of
its worst window, moved so that a quarter of each class's sample, set apart from training, parts best at 0.5.

The fit uses a bounded sample of labelled rows (at most `SAMPLE` rows a class, the first by a hash of id and text); all of a
sampled text is used. It runs in one task on an executor: the driver only sees the model. Scoring is linear, so each n-gram's
share of the logit is a number in a table: whole texts are scored by array look-ups, piece by piece, so a text of any length
takes memory in proportion to its windows. Only texts and toxic labels are inputs.

Defined results: null and empty texts get the score of a window without n-grams; fewer than two labelled rows of a class (one
to learn from, one apart) give the score 0 to all; labels of null documents or with null values are ignored; a document with
both labels is toxic; equal rows get equal scores; scores that tie get the same prediction; an empty table gives no rows;
other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, load, map_batches, materialize, release, texts
from .vectors import word_hashes

BITS, DIM, SIZES = 19, 8, (3, 4, 5, 6)
#: Labelled rows a class of which the model learns; words in a window and from one window to the next.
SAMPLE, WINDOW, STEP = 2500, 24, 12
PIECE = 1 << 20
#: A window's average is over so many n-grams at least, so that one word alone says little.
FLOOR = 120
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(11)
_MULT = _rng.integers(1, 2**31, (max(SIZES) + 1, max(SIZES)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _pieces(data: bytes) -> list[bytes]:
    """Pieces of bounded length, cut at white space where there is some."""
    out, at = [], 0
    while len(data) - at > PIECE:
        cut = data.rfind(b" ", at, at + PIECE)
        cut = cut if cut > at else at + PIECE
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def _subwords(data: bytes):
    """Hashed n-grams of the words: for each size the buckets and the word each belongs to; and how many words."""
    a = np.frombuffer(b" " + data + b" ", np.uint8)
    gap = _GAP[a]
    begins = ~gap[1:] & gap[:-1]
    word = np.cumsum(np.concatenate([[False], begins])) - 1
    words = int(begins.sum())
    a = np.where(gap, np.uint8(32), a)
    wide = a.astype(np.uint32)
    inner = np.concatenate([[0], np.cumsum(gap)])
    found = []
    for n in SIZES:
        if len(a) < n:
            continue
        m = len(a) - n + 1
        ok = np.flatnonzero(inner[n - 1 : n - 1 + m] - inner[1 : 1 + m] == 0)  # no gap but at the ends
        h = np.full(len(ok), n, np.uint32)
        for j in range(n):
            h = (h ^ wide[ok + j]) * _MULT[n, j]
            h ^= h >> np.uint32(15)
        found.append(((h >> np.uint32(32 - BITS)).astype(np.int64), word[ok + 1]))
    return found, words


def _fresh(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each window, the words of each window, and which of these are there for the first time."""
    h = word_hashes(data)
    order = np.argsort(h, kind="stable")
    before = np.full(words, -1)
    same = h[order][1:] == h[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    a = np.arange(0, max(1, words - WINDOW + STEP), STEP)
    at = a[:, None] + np.arange(WINDOW)
    there = at < words
    at = np.minimum(at, words - 1)
    fresh = there & (before[at] < a[:, None])
    return a, np.where(there, at, words - 1 + (~there)), fresh


class Model:
    """A table with each n-gram's share of the logit, the softmax's bias, and the shift that parts documents at 0.5."""

    def __init__(self, table: np.ndarray, bias: float, shift: float = 0.0) -> None:
        self.table, self.bias, self.shift = table, bias, shift

    def dump(self) -> bytes:
        return np.array([self.bias, self.shift], np.float64).tobytes() + self.table.astype(np.float32).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Model:
        bias, shift = np.frombuffer(data, np.float64, 2)
        return cls(np.frombuffer(data, np.float32, offset=16), float(bias), float(shift))

    def windows(self, text: str) -> np.ndarray:
        """The logit of each window."""
        out = []
        for data in _pieces(text.lower().encode("utf-8", "surrogatepass")):
            found, words = _subwords(data)
            if not words:
                continue
            total, many = np.zeros(words + 1), np.zeros(words + 1)  # and a word that isn't there
            for bucket, word in found:
                total += np.bincount(word, self.table[bucket], minlength=words + 1)
                many += np.bincount(word, minlength=words + 1)
            a, at, fresh = _fresh(data, words)
            out.append((total[at] * fresh).sum(1) / np.maximum(FLOOR, (many[at] * (at < words)).sum(1)) + self.bias)
        return np.concatenate(out) if out else np.full(1, self.bias)

    def score(self, text: str) -> float:
        x = float(self.windows(text).max()) - self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _bags(text: str) -> list[tuple[np.ndarray, int]]:
    """Of each window of a text the n-gram buckets of its different words, and how many it has with repeats."""
    out = []
    for data in _pieces(text.lower().encode("utf-8", "surrogatepass")):
        found, words = _subwords(data)
        if not words or not found:
            continue
        bucket, word = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(word, kind="stable")
        bucket, edge = bucket[order].astype(np.int32), np.searchsorted(word[order], np.arange(words + 1))
        for a, at, fresh in zip(*_fresh(data, words)):
            z = min(a + WINDOW, words)
            own = [bucket[edge[w] : edge[w + 1]] for w in at[fresh].tolist()]
            if edge[z] > edge[a]:
                out.append((np.concatenate(own), max(FLOOR, int(edge[z] - edge[a]))))
    return out


def fit(rows: list[tuple[str, int]], seed: int = 5, rounds: int = 3, windows: int = 6) -> Model:
    """Train on (text, toxic). Of a clean document, `windows` windows drawn at random count in a round, later also
    those that look the most toxic; of a toxic one up to four times as many in the first round, then those that the model finds."""
    rng = np.random.default_rng(seed)
    clean, toxic = [t for t, y in rows if not y], [t for t, y in rows if y]
    apart = [(t, 0) for t in clean[::4]] + [(t, 1) for t in toxic[::4]]  # these only place the threshold
    clean, toxic = ([t for i, t in enumerate(x) if i % 4] for x in (clean, toxic))
    if not clean or not toxic:
        return Model(np.zeros(1 << BITS, np.float32), -50.0)
    vec = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    bags = [[b for b in _bags(t)] for t in toxic]
    model = None
    for r in range(rounds):
        data = []
        for t, b in zip(toxic, bags):
            if not b:
                continue
            if model is None:
                use = [b[i] for i in rng.permutation(len(b))[: 4 * windows]]
            else:
                logit = np.array([model.table[x].sum() / n for x, n in b])
                use = [b[i] for i in np.flatnonzero((logit >= logit.max() - 1e-9) | (logit + model.bias > 2))]
            data += [(x, 1) for x in use]
        for t in clean:
            b = _bags(t)
            pick = rng.permutation(len(b))[:windows].tolist()
            if model is not None and b:  # and the windows that the model likes least to see as clean
                pick += np.argsort([-model.table[x].sum() / n for x, n in b], kind="stable")[: windows // 2].tolist()
            data += [(b[i], 0) for i in pick]
        vec, soft, bias = _train(data, vec, soft, bias, rng, 0.5 if r == 0 else 0.3)
        model = Model((vec @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    y = np.array([c for _, c in apart])
    x = np.array([model.windows(t).max() for t, _ in apart])
    order = np.argsort(-x)
    hits = np.cumsum(y[order])
    good = 2 * hits / (np.arange(len(x)) + 1 + y.sum())
    k = int(good.argmax())
    low = x[order][k + 1] if k + 1 < len(x) else x[order][k] - 1
    model.shift = float((x[order][k] + low) / 2)
    return model


def _train(data, vec, soft, bias, rng, rate, size: int = 64):
    """Passes (more over few windows) of minibatches with AdaGrad steps for the vectors that a batch touches."""
    seen = np.full(len(vec), 1e-3, np.float32)
    passes = min(8, max(1, 12_000 // max(1, len(data))))
    order = np.concatenate([rng.permutation(len(data)) for _ in range(passes)])
    gs, gb = np.full(soft.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    for at in range(0, len(order), size):
        part = [data[i] for i in order[at : at + size]]
        many = np.array([len(b[0]) for b, _ in part])
        over = np.array([b[1] for b, _ in part], np.float32)
        y = np.array([c for _, c in part])
        u, inv = np.unique(np.concatenate([b[0] for b, _ in part]), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        own = vec[u]
        mean = np.add.reduceat(own[inv], first, axis=0) / over[:, None]
        z = mean @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= np.where(y == 1, 1.5, 1.0)[:, None]
        back = (p @ soft.T) / over[:, None]
        spread = np.repeat(np.arange(len(part)), many)
        grad = np.stack([np.bincount(inv, back[spread, k], minlength=len(u)) for k in range(vec.shape[1])], 1).astype(np.float32)
        grad *= size / 4  # an n-gram is a small part of its bag
        seen[u] += (grad**2).mean(1)
        vec[u] = own - rate * grad / np.sqrt(seen[u])[:, None]
        ws, wb = mean.T @ p / len(part), p.mean(0)
        gs, gb = gs + ws**2, gb + wb**2
        soft, bias = soft - 0.2 * ws / np.sqrt(gs), bias - 0.2 * wb / np.sqrt(gb)
    return vec, soft.astype(np.float32), bias.astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(text, y): at most `rows` training rows a class, those with the lowest hash of their id and text. Ids are first drawn
    by a threshold that leaves twice as many as are needed on average, then rows are counted out."""
    lab = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    lab = lab.where(fold("__id") != 0).groupBy("__id").agg(F.max("__y").alias("__y"))
    lab = lab.withColumn("__h", F.pmod(F.xxhash64(F.lit("toxic"), "__id"), F.lit(1 << 30)))
    many = {r[0]: r[1] for r in lab.groupBy("__y").count().collect()}
    use = lab.where(" or ".join(f"(__y = {int(y)} and __h < {int(min(1, 2 * rows / n) * (1 << 30))})" for y, n in many.items()) or "false")
    found = docs.select("doc_id", "text").join(F.broadcast(use), F.col("doc_id") == F.col("__id"))  # about 4 * rows ids
    found = found.select("text", F.col("__y").alias("y"), F.col("__h").alias("h"), F.xxhash64("text").alias("t"))
    first = [found.where(F.col("y") == y).orderBy("h", "t").limit(rows) for y in (0, 1)]
    return first[0].unionByName(first[1])


def train(rows: DataFrame) -> Model:
    """fit(), in one task: rows are a bounded sample (text, y, h, t)."""

    def run(batches):
        held = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
        held = [(t or "", y) for t, y, _, _ in sorted(held, key=lambda r: r[2:])]
        model = fit(held).dump()
        held.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    one = materialize(rows.select("text", "y", "h", "t").coalesce(1).mapInArrow(run, "model binary"), "toxicity")
    found = one.first()
    return Model.load(bytes(found[0])) if found else fit([])


def _scored(docs: DataFrame, model: Model, keep: list[str] | None, only_clean: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            found = [m.score(t) for t in texts(batch)]
            return {"__rows": [i for i, s in enumerate(found) if s < 0.5]} if only_clean else {"score": found}

        return work

    return map_batches(docs, start, [] if only_clean else [T.StructField("score", T.DoubleType())], keep)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    out = _scored(docs.select("doc_id", "text"), model, ["doc_id"], False)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects, all columns as they were."""
    return _scored(docs, model, None, True)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: see the module. (doc_id, held_out, score, predicted)."""
    docs = load(spark, sf_dir, "documents")
    return score(docs, train(sample(docs, load(spark, sf_dir, "labels"))))
