"""Language-model scoring with a causal self-attention model trained in numpy on subword ids (operator 2).

A text is its words (A-Z lower-cased) and one end. A word's subword id is the longest piece of a public byte-level vocabulary,
of `LEAD` bytes at most, that the word begins with; the most frequent ids of the training corpus are the model's classes, the
rest share one, and the end is a class of its own. The attention model gives the probability of each token's class from the
classes before it; within a class the corpus counts give the word's, so

    log10 P(token | text before) = log10 P(class | classes before) + log10 (c + 0.5) / (N_class + 0.5 (V_class + 1)),

which is the base measure with its fixed class shares replaced by the model's. Words, ids and classes are counted over all
training documents. The attention weights (one layer, one head, learned positions) are fitted by Adam in one pass over every training
document on the executors, where each token is a target once: each task goes on from the same start with its own rows, and the
tasks' weights are averaged by their windows. The start, from where the pass goes, is fitted in the driver on windows of at
most `SAMPLE` training documents, so that small tables have steps enough.

Scoring cuts a text's classes into windows of `WINDOW` that overlap by half; each token is scored once, in the window where it
has the longest context, with keys and values of all places and queries of the second half only. The counts of the `KNOWN`
most frequent words go to the tasks as a table of bounded size; the rest are joined by a 64-bit hash of the word.

Defined results: null and empty texts hold the end alone; a null doc_id counts as a training row; with no training rows all
counts are 0; an empty table gives no rows; words of any length count.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, load, map_batches, materialize, release, texts
from .vectors import fold_case

LEAD, CLASSES, DIM, WINDOW = 4, 160, 24, 32
#: Words whose counts are broadcast; training documents that start the attention weights, and the start's steps.
KNOWN, SAMPLE, STEPS = 100_000, 1500, 900
#: The rate of the pass on the executors; windows a step; windows whose arrays are made at once (they stay in the cache).
RATE, LOT, BLOCK = 1e-3, 128, 16
#: Words that a task counts before it sends what it has.
HELD = 400_000
HALF = WINDOW // 2
END, OTHER, START = 0, 1, None  # classes 0 and 1; the class before the first token is CLASSES


class Subwords:
    """The leading subword id of a word, by a tiktoken file of ranks."""

    def __init__(self, path: str) -> None:
        import base64

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ids = {k: v for k, v in ranks.items() if len(k) <= LEAD}

    def lead(self, word: bytes) -> int:
        ids = self.ids
        for n in range(min(LEAD, len(word)), 0, -1):
            found = ids.get(word[:n])
            if found is not None:
                return found
        return 0


_READY: dict[str, Subwords] = {}


def _subwords(path: str) -> Subwords:
    return _READY.get(path) or _READY.setdefault(path, Subwords(path))


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(hash, lead, word, n) of all words of docs."""

    def run(batches):
        sub = _subwords(path)

        def send(held):
            words = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([_hash(w) for w in words], pa.int64()), pa.array([sub.lead(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())],
                names=["hash", "lead", "n"],
            )

        held: Counter = Counter()
        for batch in batches:
            for t in texts(batch):
                held.update(fold_case(t).split())
                if len(held) > HELD:
                    yield send(held)
                    held = Counter()
        if held:
            yield send(held)

    return docs.select("text").mapInArrow(run, "hash long, lead int, n long").groupBy("hash", "lead").agg(F.sum("n").alias("n"))


_MASK = np.where(np.arange(WINDOW)[None, :] > np.arange(WINDOW)[:, None], np.float32(-1e9), np.float32(0))


class Attention:
    """One causal self-attention layer over classes, and a softmax over the next class."""

    def __init__(self, classes: int, prior: np.ndarray, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        d, c = DIM, classes
        g = lambda *s: r.normal(0, 1 / math.sqrt(s[0]), s).astype(np.float32)
        self.w = {
            "emb": r.normal(0, 0.3, (c + 1, d)).astype(np.float32), "pos": r.normal(0, 0.1, (WINDOW, d)).astype(np.float32),
            "q": g(d, d), "k": g(d, d), "v": g(d, d), "o": g(d, d) * 0.5, "out": g(d, c) * 0.1, "bias": np.log(prior + 1e-7).astype(np.float32),
        }

    def _forward(self, ids: np.ndarray, first: int):
        """Of a few windows, a row a place: what the layers give, up to exp(logits) and their sums."""
        w, d, many = self.w, DIM, len(ids)
        x = w["emb"].take(ids, 0)
        x += w["pos"]
        x = x.reshape(-1, d)
        xq = x if not first else np.ascontiguousarray(x.reshape(many, WINDOW, d)[:, first:]).reshape(-1, d)
        q, k, v = (e.reshape(many, -1, d) for e in (xq @ w["q"], x @ w["k"], x @ w["v"]))
        s = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        s *= np.float32(1 / math.sqrt(d))
        s += _MASK[first:]
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= (s @ np.ones(WINDOW, s.dtype))[..., None]
        a = (s @ v).reshape(-1, d)
        h = a @ w["o"]
        h += xq
        np.tanh(h, out=h)
        z = h @ w["out"]
        z += w["bias"]
        return x, q, k, v, s, a, h, z

    def _exp(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """(exp(z - top), top), in z's place; as |h| < 1, a bound of the weights tells whether a top is needed."""
        top: np.ndarray | float = 0.0
        if not np.abs(self.w["out"]).sum(0).max() + np.abs(self.w["bias"]).max() < 60:
            top = z.max(1)
            z -= top[:, None]
        return np.exp(z, out=z), top

    def log_probs(self, ids: np.ndarray, targets: np.ndarray, first: int) -> np.ndarray:
        """Natural logarithms of the targets' probabilities; ids: what stands before each target, in windows; the targets
        of the places from `first` on."""
        out = []
        for at in range(0, len(ids), BLOCK):
            z = self._forward(ids[at : at + BLOCK], first)[-1]
            picked = z[np.arange(len(z)), targets[at : at + BLOCK].ravel()]
            e, top = self._exp(z)
            out.append((picked - top - np.log(e @ np.ones(e.shape[1], e.dtype))).reshape(-1, WINDOW - first))
        return np.concatenate(out) if out else np.zeros((0, WINDOW - first), np.float32)

    def gradients(self, i: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over windows (ids before, targets), masked causally."""
        total: dict[str, np.ndarray] = {}
        scale = np.float32(1 / max(1, y.size))
        for at in range(0, len(i), BLOCK):
            for name, x in self._gradients(i[at : at + BLOCK], y[at : at + BLOCK].ravel(), scale).items():
                total[name] = total[name] + x if name in total else x
        return total

    def _gradients(self, i: np.ndarray, y: np.ndarray, scale: np.float32) -> dict[str, np.ndarray]:
        w, d, many = self.w, DIM, len(i)
        x, q, k, v, s, a, h, z = self._forward(i, 0)
        p, _ = self._exp(z)
        p *= (scale / (p @ np.ones(p.shape[1], p.dtype)))[:, None]
        p[np.arange(len(y)), y] -= scale
        g = {"out": h.T @ p, "bias": np.ones(len(p), p.dtype) @ p}
        dh = p @ w["out"].T
        dh *= 1 - h * h
        g["o"] = a.T @ dh
        da = (dh @ w["o"].T).reshape(many, WINDOW, d)
        dv = s.transpose(0, 2, 1) @ da
        ds = da @ np.ascontiguousarray(v.transpose(0, 2, 1))
        ds -= np.einsum("btd,btd->bt", da, a.reshape(da.shape))[..., None]
        ds *= s
        ds *= np.float32(1 / math.sqrt(d))
        dx = dh
        for name, part in (("q", ds @ k), ("k", ds.transpose(0, 2, 1) @ q), ("v", dv)):
            part = part.reshape(-1, d)
            g[name] = x.T @ part
            dx = dx + part @ w[name].T
        g["pos"] = dx.reshape(many, WINDOW, d).sum(0)
        flat = (i.reshape(-1, 1) * d + np.arange(d)).ravel()
        g["emb"] = np.bincount(flat, dx.ravel(), minlength=w["emb"].size).reshape(w["emb"].shape).astype(np.float32)
        return g

    def fit(self, ids: np.ndarray, targets: np.ndarray, steps: int, rate: float = 4e-3, seed: int = 4) -> None:
        """Adam on windows drawn at random, with a rate that rises and falls."""
        r, adam = np.random.default_rng(seed), Adam(self)
        for t in range(1, steps + 1):
            at = r.integers(0, len(ids), LOT)
            adam.step(ids[at], targets[at], rate * min(1, t / 100) * (1 - 0.9 * t / steps))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.values()])

    def unflat(self, values: np.ndarray) -> None:
        ends = np.cumsum([x.size for x in self.w.values()])
        self.w = {k: values[e - x.size : e].reshape(x.shape).astype(np.float32) for (k, x), e in zip(self.w.items(), ends)}


class Adam:
    def __init__(self, model: Attention) -> None:
        self.model, self.t = model, 0
        self.m = {k: np.zeros_like(x) for k, x in model.w.items()}
        self.n = {k: np.zeros_like(x) for k, x in model.w.items()}

    def step(self, ids: np.ndarray, targets: np.ndarray, rate: float) -> None:
        self.t += 1
        w, m, n, t = self.model.w, self.m, self.n, self.t
        for name, d in self.model.gradients(ids, targets).items():
            m[name] = 0.9 * m[name] + 0.1 * d
            n[name] = 0.99 * n[name] + 0.01 * d * d
            w[name] = (w[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(n[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def windows(classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's classes (the end last): the classes before each token in the first window, and in each further window;
    (ids, targets, how many targets count). The first window scores all its places, each further one its second half."""
    n = len(classes)
    before = np.concatenate([[start], classes[:-1]])
    more = max(0, -(-(n - WINDOW) // HALF))
    size = WINDOW + more * HALF
    before = np.concatenate([before, np.full(size - n, start)])
    after = np.concatenate([classes, np.zeros(size - n, np.int64)])
    at = np.arange(more + 1)[:, None] * HALF + np.arange(WINDOW)
    return before[at], after[at], np.minimum(n - np.arange(more + 1) * HALF, WINDOW)


def cuts(classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one text's classes: windows to learn from, (ids, targets), one after the other, so that each token is a target
    once; beyond the text's end, as in windows(), ends follow starts."""
    size = -(-len(classes) // WINDOW) * WINDOW
    before, after = np.full(size, start), np.full(size, END)
    before[1 : len(classes)] = classes[:-1]
    after[: len(classes)] = classes
    return before.reshape(-1, WINDOW), after.reshape(-1, WINDOW)


class Scorer:
    """What a task needs: the frequent words' classes and counts, classes by subword id, and the model."""

    def __init__(self, path, known, count, word_class, lead_class, model, norm, classes) -> None:
        self.path, self.known, self.count, self.word_class, self.lead_class = path, known, count, word_class, lead_class
        self.model, self.norm, self.classes = model, norm, classes  # norm: log10 (N_class + 0.5 (V_class + 1))

    def prepare(self) -> None:
        self.sub = _subwords(self.path)
        self.place = {h: i for i, h in enumerate(self.known.tolist())}
        self.words: dict[bytes, int] = {}  # word -> place of a frequent word, or -1 - class
        self.log_count = np.log10(self.count + 0.5)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Classes of the words, places of the frequent words, hashes of the others."""
        words, seen = fold_case(text).split(), self.words
        got = list(map(seen.get, words))
        rare = []
        for i, g in enumerate(got):
            if g is None:
                w = words[i]
                h = _hash(w)
                g = self.place.get(h, -1)
                if g < 0:
                    g = -1 - int(self.lead_class[self.sub.lead(w)])
                    rare.append(h)
                else:
                    seen[w] = g
                got[i] = g
        at = np.array(got, np.int64)
        cls = np.where(at >= 0, self.word_class[np.maximum(at, 0)] if len(self.word_class) else 0, -1 - at)
        return cls, at[at >= 0], rare

    def read(self, batch_texts: list[str]) -> dict:
        """Of each text: its tokens, what the counts give, hashes of rare words, and the classes (a byte each, the end last)."""
        out: dict[str, list] = {"n_tokens": [], "n_top": [], "sum_top": [], "norm": [], "rare": [], "classes": []}
        for t in batch_texts:
            cls, top, rare = self.tokens(t)
            cls = np.concatenate([cls, [END]])
            out["n_tokens"].append(len(cls))
            out["n_top"].append(len(top))
            out["sum_top"].append(float(self.log_count[top].sum()))
            out["norm"].append(float(self.norm[cls].sum()))
            out["rare"].append(rare)
            out["classes"].append(cls.astype(np.uint8).tobytes())
        return out

    def log_model(self, classes: list[bytes]) -> list[float]:
        """The model's log10 probability of each text's classes."""
        every = [windows(np.frombuffer(c, np.uint8).astype(np.int64), self.classes) for c in classes]
        if not every:
            return []
        doc = np.repeat(np.arange(len(every)), [len(x[0]) for x in every])
        ids, after, n = (np.concatenate([x[j] for x in every]) for j in range(3))
        head = np.concatenate([[True], doc[1:] != doc[:-1]])
        total = np.zeros(len(every))
        for use, first in ((np.flatnonzero(head), 0), (np.flatnonzero(~head), HALF)):
            for a in range(0, len(use), 512):
                u = use[a : a + 512]
                lp = self.model.log_probs(ids[u], after[u, first:], first)
                lp = np.where(np.arange(first, WINDOW) < n[u][:, None], lp, 0).sum(1, dtype=np.float64)
                total += np.bincount(doc[u], lp, minlength=len(total))
        return (total / math.log(10)).tolist()

    def batch(self, batch_texts: list[str]) -> dict:
        out = self.read(batch_texts)
        return out | {"model": self.log_model(out["classes"])}


def learn(docs: DataFrame, path: str, held_out, sample: int = SAMPLE, steps: int = STEPS):
    """(Scorer, counts (hash, n), N, V, ends) from all rows of docs that aren't held_out."""
    scorer, *rest = begin(docs, path, held_out, sample, steps)
    refine(docs.where(~held_out), scorer)
    return scorer, *rest


def begin(docs: DataFrame, path: str, held_out, sample: int, steps: int):
    """What learn() gives, before the pass over all rows: the weights are at their start."""
    train = docs.where(~held_out)
    counts = materialize(word_counts(train, path), "counts")
    ends = train.count()
    leads = counts.groupBy("lead").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # as many as the vocabulary
    words, distinct = sum(r["n"] for r in leads), sum(r["v"] for r in leads)
    order = sorted(leads, key=lambda r: (-r["n"], r["lead"]))
    lead_class = np.full(1 << 17, OTHER, np.int64)
    for c, r in enumerate(order[: CLASSES - 2]):
        lead_class[r["lead"]] = c + 2
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    n_class[END], v_class[END] = ends, int(ends > 0)
    for r in leads:
        n_class[lead_class[r["lead"]]] += r["n"]
        v_class[lead_class[r["lead"]]] += r["v"]
    # the largest set of the most frequent words within the bound: by a histogram of counts
    hist = counts.groupBy(F.floor(F.log2("n") * 8).alias("b")).count().collect()
    left, low = KNOWN, None
    for r in sorted(hist, key=lambda r: -r["b"]):
        if left < r["count"]:
            break
        left, low = left - r["count"], r["b"]
    top = counts.where(F.floor(F.log2("n") * 8) >= low).select("hash", "lead", "n").collect() if low is not None else []
    top.sort(key=lambda r: (-r["n"], r["hash"]))
    known, count = np.array([r["hash"] for r in top], np.int64), np.array([r["n"] for r in top], np.float64)
    word_class = lead_class[np.array([r["lead"] for r in top], np.int64)] if top else np.zeros(0, np.int64)
    norm = np.log10(n_class + 0.5 * (v_class + 1))
    model = Attention(CLASSES, (n_class + 1) / (n_class.sum() + CLASSES))
    scorer = Scorer(path, known, count, word_class, lead_class, model, norm, CLASSES)
    scorer.prepare()
    h = F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(1 << 30))
    share = min(1.0, 2 * sample / max(1, ends))  # twice as many as needed on average; then rows are counted out
    drawn = train.where(h < int(share * (1 << 30))).select("text", h.alias("h")).orderBy("h", F.xxhash64("text")).limit(sample).collect()
    data = [cuts(np.concatenate([scorer.tokens(t)[0], [END]]), CLASSES) for t in sorted(r[0] or "" for r in drawn)]
    if data:
        ids, after = np.concatenate([x[0] for x in data]), np.concatenate([x[1] for x in data])
        model.fit(ids, after, steps)
    scorer.words, scorer.place, scorer.sub = {}, {}, None
    return scorer, counts, words + ends, distinct + int(ends > 0), ends


def refine(train: DataFrame, scorer: Scorer, every: int = 1) -> int:
    """Move the model's weights by one pass over all rows of train (every > 1: over one in `every`, by hash), which have a
    `text` or, from Scorer.read, `classes`; the number of tokens learnt from. Weights are added up in lots of tasks on the
    executors, so the driver meets 16 rows whatever the input. Without a document the weights stay."""
    shared = train.sparkSession.sparkContext.broadcast(scorer)
    column = "classes" if "classes" in train.columns else "text"

    def run(batches):
        s = shared.value
        model = Attention(CLASSES, np.ones(CLASSES))
        model.unflat(s.model.flat())
        adam, held, many, done, tokens = Adam(model), [], 0, 0, 0

        def step(least):
            nonlocal held, many, done
            if many < least:
                return
            ids, after = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            end = many - many % least
            for a in range(0, end, LOT):
                adam.step(ids[a : a + LOT], after[a : a + LOT], RATE * min(1, (adam.t + 1) / 20))
            held, many, done = [(ids[end:], after[end:])], many - end, done + end

        for batch in batches:
            if column == "text" and not getattr(s, "sub", None):
                s.prepare()
            found = s.read(texts(batch))["classes"] if column == "text" else batch.column(0).to_pylist()
            for c in found:
                held.append(cuts(np.frombuffer(c, np.uint8).astype(np.int64), CLASSES))
                many += len(held[-1][0])
                tokens += len(c)
                step(LOT)
        step(1)
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([(model.flat().astype(np.float64) * done).tobytes()], pa.binary()), pa.array([done], pa.int64()), pa.array([tokens], pa.int64())],
                names=["w", "n", "tokens"],
            )
        release()

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, np.float64) for x in pdf["w"])
        return pd.DataFrame({"w": [total.tobytes()], "n": [int(pdf["n"].sum())], "tokens": [int(pdf["tokens"].sum())]})

    some = train.where(F.pmod(F.xxhash64(F.lit("pass"), *train.columns), F.lit(every)) == 0) if every > 1 else train
    parts = some.select(column).mapInArrow(run, "w binary, n long, tokens long").groupBy(F.pmod(F.spark_partition_id(), F.lit(16)).alias("lot"))
    found = parts.applyInPandas(add, "w binary, n long, tokens long").collect()
    if found:
        scorer.model.unflat(sum(np.frombuffer(r["w"], np.float64) for r in found) / sum(r["n"] for r in found))
    shared.unpersist()
    return sum(r["tokens"] for r in found)


def score(docs: DataFrame, path: str, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    held_out = fold() == 1
    scorer, counts, total, distinct, ends = begin(docs, path, held_out, sample, steps)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def start():
        s = shared.value
        if not getattr(s, "sub", None):
            s.prepare()

        return lambda batch: s.read(texts(batch))

    L, D = T.LongType(), T.DoubleType()
    new = [T.StructField("n_tokens", L), T.StructField("n_top", L), T.StructField("sum_top", D), T.StructField("norm", D), T.StructField("rare", T.ArrayType(L)), T.StructField("classes", T.BinaryType())]
    rows = map_batches(docs.select("doc_id", "text"), start, new, ["doc_id"]).withColumn("held_out", held_out)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm")
    learnt = refine(rows.where("not held_out").select("classes"), scorer)
    if learnt != total:
        raise RuntimeError(f"op2: learnt from {learnt} of {total} training tokens")
    scored = docs.sparkSession.sparkContext.broadcast(Scorer(path, *[np.zeros(0)] * 4, scorer.model, scorer.norm, CLASSES))

    def model():
        return lambda batch: {"model": scored.value.log_model(batch.column(batch.schema.get_field_index("classes")).to_pylist())}

    keep = ["row", "doc_id", "held_out", "n_tokens", "n_top", "sum_top", "norm"]
    out = map_batches(rows.select(*keep, "classes"), model, [T.StructField("model", D)], keep)
    rare = rows.select("row", F.explode("rare").alias("hash"))
    rare = rare.join(counts.select("hash", "n"), "hash", "left").groupBy("row")
    rare = rare.agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("sum_rare"), F.count("n").alias("n_rare"))
    out = out.join(rare, "row", "left")
    top = F.col("sum_top") + F.coalesce("sum_rare", F.lit(0.0)) + F.lit(math.log10(ends + 0.5))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_top") + F.coalesce("n_rare", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (top - F.col("n_tokens") * math.log10(total + 0.5 * (distinct + 1))).alias("base_score"),
        (top - F.col("norm") + F.col("model")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: see the module. (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    import public_tokenizers

    return score(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
