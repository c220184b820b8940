"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model (operator 5).

The model (words A-Z lower-cased, orders 1 to 3) is trained on trusted text: all documents labelled quality 1 whose id's hash
falls into the lower half; the others set the thresholds. Spark counts the trigrams, and from them the continuation
counts of lower orders; the three discounts of an order come from its counts of counts. The lowest order is
interpolated with a uniform share for unknown words.

The query scores by slices (`rated`): learnt words are numbered, and trigrams of all texts, packed as such numbers, are dealt by a hash
of their middle word, so that a slice has every count that its trigrams need but the words' p1, for which counts go to all tasks
(`words` and `learn`: 16 bytes a distinct learnt word, in the driver too). `TURNS` turns of slices follow each other, to hold less on disk.
`values` and `perplexity` are a plainer form by joins of rows.

A document is kept if its perplexity is at most the `QUANTILE` of the trusted documents' in its language, times `SLACK`.
Perplexities are of whole texts, without an end mark; quantiles are exact, over all trusted documents that the model didn't
learn from. A language without trusted documents takes the threshold over all languages.

Defined results: null and empty texts have no perplexity and are not kept; texts with a null language are a language; without
trusted text nothing can be judged and all rows with words are kept; perplexities at a threshold are kept; repeated rows and
ids are judged alike; a text of any length is scored whole; other columns, of whatever name, aren't read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, free_shuffles, load, map_batches, materialize, release, shuffles_deleted, small, texts
from .vectors import U, fold_case, mix, word_hashes

SHARDS, QUANTILE, SLACK = 16, 0.98, 1.15
#: Keys that are sent to the tasks with their values; bits of the map of the other keys.
HOT, BITS = 1 << 20, 29
#: Words of a piece of texts, whose trigrams are packed together.
PIECE = 1 << 21
#: Trigrams of a slice that are unpacked at a time, if no piece has more.
CHUNK = 1 << 19
#: Columns of so many numbers are compressed byte by byte.
LONG = 4096
#: Turns in which all documents' trigrams are shuffled: each holds that part of them on disk.
TURNS = 4
_START = U(0x5851F42D4C957F2D)


def _grams(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams that end at each word; the text's beginning counts as two marks."""
    w = np.concatenate([np.full(2, _START), words])
    one = w[2:]
    two = mix(w[1:-1] * U(3) + mix(one))
    three = mix(w[:-2] * U(5) + two)
    return [one, two, three]


def _contexts(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts of the 2- and 3-grams: one word and two words."""
    w = np.concatenate([np.full(2, _START), words])
    return [mix(w[1:-1] * U(7)), mix(w[:-2] * U(11) + mix(w[1:-1]))]


def _counted(trusted: DataFrame) -> list[DataFrame]:
    """Per order, with the keys of what it holds: c, the number of occurrences for trigrams, of continuations below, and n,
    the occurrences."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out = {"__rows": [], "g1": [], "g2": [], "g3": [], "c2": [], "c3": []}
            for r, t in enumerate(texts(batch)):
                words = word_hashes(fold_case(t))
                for name, x in zip(("g1", "g2", "g3", "c2", "c3"), [*_grams(words), *_contexts(words)]):
                    out[name].append(x.view(np.int64))
                out["__rows"].append(np.full(len(words), r))
            return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}

        return work

    new = [T.StructField(n, T.LongType()) for n in ("g1", "g2", "g3", "c2", "c3")]
    tri = map_batches(trusted.select("text"), start, new, []).groupBy("g3", "g2", "g1", "c3", "c2").agg(F.count(F.lit(1)).alias("c"))
    tri = materialize(tri, "trigrams")
    # nothing stands before a text's first word, so a pair with the text's beginning counts by its occurrences
    first = F.col("c2") == int(_contexts(np.zeros(1, U))[0].view(np.int64)[0])
    bi = tri.groupBy("g2", "g1", "c2").agg(F.when(first, F.sum("c")).otherwise(F.count(F.lit(1))).alias("c"), F.sum("c").alias("n"))
    uni = bi.groupBy("g1").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    return [uni, bi, tri.withColumn("n", F.col("c"))]


def counts(trusted: DataFrame) -> list[DataFrame]:
    """Per order: (gram, context, c); c is the number of occurrences for trigrams, of continuations below."""
    uni, bi, tri = _counted(trusted)
    return [
        uni.select(F.col("g1").alias("gram"), F.lit(0).cast("long").alias("context"), "c"),
        bi.select(F.col("g2").alias("gram"), F.col("c2").alias("context"), "c"),
        tri.select(F.col("g3").alias("gram"), F.col("c3").alias("context"), "c"),
    ]


def discounts(n: dict[int, int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)])


class Table:
    """An order's shards: sorted grams with their discounted counts, and sorted contexts with total and left-over mass."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, c: np.ndarray) -> None:
        seen, many = np.unique(np.minimum(c, 5), return_counts=True)
        d = discounts(dict(zip(seen.tolist(), many.tolist())))
        off = d[np.minimum(c, 3) - 1] if len(c) else np.zeros(0)
        names, at = np.unique(context.view(np.uint64), return_inverse=True)
        total = np.bincount(at, c, minlength=len(names))
        self.grams = self._shards(gram.view(np.uint64), (c - off)[:, None])
        self.contexts = self._shards(names, np.stack([total, np.bincount(at, off, minlength=len(names))], 1))

    @staticmethod
    def _shards(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        cut = np.searchsorted(keys >> U(60), np.arange(SHARDS + 1, dtype=np.uint64))
        return [(keys[a:z], values[a:z]) for a, z in zip(cut[:-1], cut[1:])]

    @staticmethod
    def join(shards, keys: np.ndarray) -> np.ndarray:
        """The values of keys, zero where there are none: sorted keys against one shard after the other."""
        order = np.argsort(keys)
        k = keys[order]
        out = np.zeros((len(keys), shards[0][1].shape[1]))
        cut = np.searchsorted(k >> U(60), np.arange(SHARDS + 1, dtype=np.uint64))
        for (own, values), a, z in zip(shards, cut[:-1], cut[1:]):
            if len(own) and z > a:
                i = np.minimum(np.searchsorted(own, k[a:z]), len(own) - 1)
                hit = own[i] == k[a:z]
                out[order[a:z][hit]] = values[i[hit]]
        return out


class Model:
    """Orders 1 to 3, interpolated, in memory: the plain form, against which tests hold `values`."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.tables = [Table(*columns) for columns in orders]
        self.vocabulary = len(orders[0][0]) + 1  # and the unknown word

    def many(self, found: list[np.ndarray]) -> list[float | None]:
        """The perplexity of each of several texts."""
        sizes = [len(w) for w in found]
        if not sum(sizes):
            return [None] * len(found)
        grams = [np.concatenate(x) for x in zip(*[_grams(w) for w in found])]
        contexts = [np.zeros(len(grams[0]), np.uint64), *[np.concatenate(x) for x in zip(*[_contexts(w) for w in found])]]
        p = np.full(len(grams[0]), 1 / self.vocabulary)
        for table, gram, context in zip(self.tables, grams, contexts):
            c = table.join(table.grams, gram)[:, 0]
            total, left = table.join(table.contexts, context).T
            known = total > 0
            p = np.where(known, (c + left * p) / np.where(known, total, 1), p)
        ends = np.concatenate([[0.0], np.cumsum(np.log(p))])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return [float(np.exp(-(ends[z] - ends[a]) / (z - a))) if z > a else None for a, z in zip(at[:-1], at[1:])]


def values(trusted: DataFrame) -> tuple[DataFrame, float] | None:
    """((key, value, n), the logarithm of an unknown word's p1): a text's log probability is the sum of its keys' values and,
    a word, of that logarithm. n: how often the key occurs in trusted. None without any word."""
    orders = [materialize(d, "order") if i < 2 else d for i, d in enumerate(_counted(trusted))]
    off = []
    for d in orders:
        seen = {r["k"]: r["count"] for r in d.groupBy(F.least("c", F.lit(5)).alias("k")).count().collect()}
        one, two, more = (F.lit(float(x)) for x in discounts(seen))
        off.append(F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more))
    uni, bi, tri = (d.withColumn("off", o) for d, o in zip(orders, off))
    whole = uni.agg(F.sum("c").alias("total"), F.sum("off").alias("left"), F.count(F.lit(1)).alias("v")).first()
    if not whole["v"]:
        return None
    total, left = float(whole["total"]), whole["left"]
    unknown = left / (whole["v"] + 1) / total
    uni = uni.select("g1", "n", ((F.col("c") - F.col("off") + left / (whole["v"] + 1)) / total).alias("p1"))

    def contexts(d, key):
        return d.groupBy(key).agg(F.sum("c").alias("total"), F.sum("off").alias("left"), F.sum("n").alias("m"))

    def joined(d, key, lower, p, name):  # an order's probabilities, interpolated with those of the order below
        d = d.join(contexts(d, key), key).join(lower, name)
        return d.withColumn(p, (F.col("c") - F.col("off") + F.col("left") * F.col("below")) / F.col("total"))

    rest = F.log(F.col("left") / F.col("total"))
    bi2 = materialize(joined(bi, "c2", uni.select("g1", F.col("p1").alias("below")), "p2", "g1").select("g2", "n", "p2", (F.log("p2") - rest - F.log("below")).alias("value")), "bigrams")
    tri3 = joined(tri, "c3", bi2.select("g2", F.col("p2").alias("below")), "p3", "g2")
    parts = [
        uni.select(F.col("g1").alias("key"), (F.log("p1") - float(np.log(unknown))).alias("value"), "n"),
        contexts(bi, "c2").select(F.col("c2").alias("key"), rest.alias("value"), F.col("m").alias("n")),
        bi2.select(F.col("g2").alias("key"), "value", "n"),
        contexts(tri, "c3").select(F.col("c3").alias("key"), rest.alias("value"), F.col("m").alias("n")),
        tri3.select(F.col("g3").alias("key"), (F.log("p3") - rest - F.log("below")).alias("value"), "n"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return materialize(table, "values"), float(np.log(unknown))


class Lookup:
    """What a task needs: the frequent keys, sorted, with their values, and the bits of the others."""

    def __init__(self, table: DataFrame, hot: int, bits: int) -> None:
        step = F.floor(F.log2("n") * 8)
        left, low = hot, None
        for r in sorted(table.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"]):
            if left < r["count"]:
                break
            left, low = left - r["count"], r["b"]
        often = F.lit(False) if low is None else step >= low
        got = table.where(often).select("key", "value").toArrow()
        keys, found = got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()
        order = np.argsort(keys)
        self.keys, self.values, self.shift = keys[order], found[order], 64 - bits
        self.map = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
        self.cold = table.where(~often)
        at = F.shiftrightunsigned("key", self.shift) + 1  # bitmap buckets count from 1
        for r in self.cold.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).toLocalIterator():
            self.map[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cold"}

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there are none; whether the table must be asked)."""
        out, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[i] == keys
            out[hit] = self.values[i[hit]]
        bit = keys >> U(self.shift)
        return out, ~hit & ((self.map[bit >> U(3)] >> (bit & U(7)).astype(np.uint8)) & 1).astype(bool)


def perplexity(docs: DataFrame, table: DataFrame, unknown: float, keep: list[str], hot: int = HOT, bits: int = BITS) -> DataFrame:
    """Columns `keep` of docs, n_words and perplexity (null without words)."""
    lookup = Lookup(table, hot, bits)
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    def start():
        m = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            out = {"n_words": [], "__sum": [], "__cold": []}
            for t in texts(batch):
                words = word_hashes(fold_case(t))
                out["n_words"].append(len(words))
                got, ask = m.look(keys := np.concatenate([*_grams(words), *_contexts(words)]))
                out["__sum"].append(float(got.sum()))
                out["__cold"].append(keys[ask].view(np.int64))
            return out

        return work

    L, D = T.LongType(), T.DoubleType()
    rows = map_batches(docs.select(*keep, "text"), start, [T.StructField("n_words", L), T.StructField("__sum", D), T.StructField("__cold", T.ArrayType(L))], keep)
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "perplexity")
    cold = rows.select("__row", F.explode("__cold").alias("key")).join(lookup.cold.select("key", "value"), "key")
    rows = rows.drop("__cold").join(cold.groupBy("__row").agg(F.sum("value").alias("__more")), "__row", "left")
    total = F.col("__sum") + F.coalesce("__more", F.lit(0.0)) + F.col("n_words") * unknown
    return rows.select(*keep, "n_words", F.when(F.col("n_words") > 0, F.exp(-total / F.col("n_words"))).alias("perplexity"))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of small whole numbers, compressed by bytes of like weight: each for itself if the columns are long."""
    planes = np.concatenate([np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T for c in columns])
    planes = planes if planes.shape[1] >= LONG else planes.reshape(1, -1)
    out = [pa.compress(p.tobytes(), "zstd", asbytes=True) if p.any() else b"" for p in planes]
    return np.array([len(x) for x in out], "<u4").tobytes() + b"".join(out)


def _unpack(raw: bytes, columns: int, n: int) -> list[np.ndarray]:
    many, size = (4 * columns, n) if n >= LONG else (1, 4 * columns * n)
    at = np.cumsum(np.concatenate([[4 * many], np.frombuffer(raw, "<u4", many)]))
    planes = np.zeros((many, size), np.uint8)
    for p, a, z in zip(planes, at[:-1], at[1:]):
        if z > a:
            p[:] = np.frombuffer(pa.decompress(raw[a:z], size, "zstd"), np.uint8)
    return [np.ascontiguousarray(c.T).view("<i4").ravel() for c in planes.reshape(columns, 4, n)]


class _Words:
    """Numbers of the learnt words: 0 is any other word, 1 a text's beginning, then the words by their occurrences."""

    def __init__(self, names: np.ndarray, many: np.ndarray) -> None:
        """names: hashes; many: their occurrences."""
        number = np.empty(len(names) + 1, np.uint32)
        number[np.argsort(-many, kind="stable")] = np.arange(2, len(names) + 2)
        number[-1] = 1
        names = np.concatenate([names, [_START]])
        order = np.argsort(names)
        self.names, self.numbers, self.starts = names[order], number[order], None

    def look(self, words: np.ndarray) -> np.ndarray:
        """The numbers of hashes. As those are spread evenly, a word stands a few places at most after the first with its leading bits."""
        bits = max(1, len(self.names).bit_length())
        shift = U(64 - bits)
        if self.starts is None:
            self.starts = np.searchsorted(self.names, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.uint32)
        out = np.zeros(len(words), np.uint32)
        rest, at = np.arange(len(words), dtype=np.uint32), self.starts[words >> shift]
        while len(rest):
            inside = at < len(self.names)
            rest, at, words = rest[inside], at[inside], words[inside]
            found = self.names[at]
            hit = found == words
            out[rest[hit]] = self.numbers[at[hit]]
            on = found < words
            rest, at, words = rest[on], at[on] + np.uint32(1), words[on]
        return out


def _pieces(batches, work, keyed: bool = False):
    """work(texts' word hashes, their keys, whether they are learnt from) for pieces of some PIECE words; texts without words are left out."""
    found, keys, learns, size = [], [], [], 0
    for batch in batches:
        column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "text"}
        for i, t in enumerate(texts(batch)):
            words = word_hashes(fold_case(t))
            if len(words):
                found.append(words)
                keys.append(column["key"][i] if keyed else 0)
                learns.append(column["learns"][i] if keyed else True)
                size += len(words)
            if size > PIECE:
                yield work(found, keys, learns)
                found, keys, learns, size = [], [], [], 0
    if found:
        yield work(found, keys, learns)
    del found
    release()


def _slices(docs: DataFrame, vocabulary, slices: int, keyed: bool, turn: int = 0, turns: int = 1) -> DataFrame:
    """(slice, piece, n, heads, body, learnt, ids) of docs (text; with keyed also key and learns): n trigrams of a piece's texts whose
    middle word's hash falls to a slice, as numbers of the broadcast vocabulary and, keyed, of the text in the piece, of which the first
    `learnt` are learnt from. ids, in one row a piece: the texts' keys and their words of this turn. Only slices whose remainder by turns is turn."""

    def packed(found, keys, learns):
        first = np.argsort(~np.array(learns), kind="stable")
        found, keys = [found[i] for i in first], np.array(keys, np.int64)[first]
        sizes = np.array([len(a) for a in found]) + 2
        ends = np.cumsum(sizes)
        whole = np.full(ends[-1], _START)
        inner = np.ones(len(whole), bool)
        inner[ends - sizes] = inner[ends - sizes + 1] = False
        whole[inner] = np.concatenate(found)
        part = ((whole >> U(20)) % U(slices)).astype(np.uint16 if slices < 1 << 16 else np.uint32)
        mine = part % turns == turn
        mine[ends - 1] = mine[ends - sizes] = False  # a text's ends are no middle words
        at = np.flatnonzero(mine)
        mine[at - 1] = mine[at + 1] = True
        number = np.zeros(len(whole), np.uint32)
        number[mine] = vocabulary.value.look(whole[mine])
        at = at[np.argsort(part[at], kind="stable")]
        cut = np.searchsorted(part[at], np.arange(slices + 1))
        del whole, inner, mine, part
        u, v, w, doc = number[at - 1], number[at], number[at + 1], np.repeat(np.arange(len(found), dtype=np.uint32), sizes)[at]
        u[v == 0] = 0  # after a word that isn't learnt, the one before doesn't matter
        learnt = int(sum(learns))
        name = int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8, salt=learnt.to_bytes(8, "little")).digest(), "little", signed=True)
        ids = keys.tobytes() + np.bincount(doc, minlength=len(found)).astype(np.uint32).tobytes() if keyed else b""
        rows = {k: [] for k in ("slice", "piece", "n", "heads", "body", "learnt", "ids")}
        for i, (a, z) in enumerate(zip(cut[:-1], cut[1:])):
            if a == z:
                continue
            heads, idx, many = np.unique(v[a:z], return_inverse=True, return_counts=True)
            often = np.argsort(-many, kind="stable")  # frequent words get small numbers
            place = np.empty(len(often), np.uint32)
            place[often] = np.arange(len(often))
            text = [np.diff(doc[a:z], prepend=np.uint32(0))] if keyed else []
            for k, x in zip(rows, (i, name, int(z - a), heads[often].tobytes(), _pack(u[a:z], place[idx], w[a:z], *text), learnt, ids)):
                rows[k].append(x)
            ids = b""
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_pydict(rows, pa.schema(list(zip(rows, kinds))))

    return docs.mapInArrow(lambda batches: _pieces(batches, packed, keyed), "slice int, piece long, n long, heads binary, body binary, learnt long, ids binary")


def _by_slice(parts: DataFrame, work, kind: str) -> DataFrame:
    """work(rows), with the rows of one slice after the other, gives record batches: rows stay packed until work unpacks them."""

    def run(batches):
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["slice"] != r["slice"]:
                    yield from work(rows)
                    rows = []
                    release()
                rows.append(r)
        if rows:
            yield from work(rows)
        del rows
        release()

    return parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, kind)


def _heads(rows) -> np.ndarray:
    """The numbers of a slice's middle words, sorted."""
    return np.unique(np.concatenate([np.frombuffer(r["heads"], np.uint32) for r in rows]))


def _chunks(rows, heads: np.ndarray, keyed: bool):
    """(some rows, where each ends, u, v, w, text) of trigrams (u, v, w), v as a place in heads; text (keyed) is its text's number in the piece."""
    a = 0
    while a < len(rows):
        z, n = a, 0
        while z < len(rows) and (z == a or n + rows[z]["n"] <= CHUNK):
            n += rows[z]["n"]
            z += 1
        parts = []
        for r in rows[a:z]:
            columns = _unpack(r["body"], 4 if keyed else 3, r["n"])
            columns[1] = np.searchsorted(heads, np.frombuffer(r["heads"], np.uint32)).astype(np.int32)[columns[1]]
            if keyed:
                columns[3] = np.cumsum(columns[3])
            parts.append(columns)
        yield rows[a:z], np.cumsum([r["n"] for r in rows[a:z]]), *(np.concatenate(x) for x in zip(*parts))
        a = z


class _Slice:
    """Counts of a slice's learnt trigrams (u, v, w), words numbered below size and middle words as in heads: all that share
    a middle word are in one slice, and so are the pairs that end with it and those that begin with it. add() takes them lot by
    lot, so that only different trigrams are held; close() ends that."""

    def __init__(self, heads, size) -> None:
        self.heads, self.size, self.many = heads, size, len(heads)
        none = np.zeros(0, np.int64)
        self.lots = [(none, none, none)]

    def add(self, u, v, w) -> None:
        pairs, at = np.unique(self.pair(v, w), return_inverse=True)
        self.lots.append((pairs, *np.unique(at * self.size + u, return_counts=True)))
        while len(self.lots) > 1 and len(self.lots[-2][1]) < 2 * len(self.lots[-1][1]):
            self._merge()

    def _merge(self) -> None:
        lots = [self.lots.pop(), self.lots.pop()]
        pairs = np.unique(np.concatenate([p for p, _, _ in lots]))
        tri = np.concatenate([np.searchsorted(pairs, p)[t // self.size] * self.size + t % self.size for p, t, _ in lots])
        tri, at = np.unique(tri, return_inverse=True)
        c = np.zeros(len(tri), np.int64)
        np.add.at(c, at, np.concatenate([c for _, _, c in lots]))
        self.lots.append((pairs, tri, c))

    def close(self) -> None:
        while len(self.lots) > 1:
            self._merge()
        (self.pairs, self.tri, self.c3), self.lots = self.lots[0], []
        pair = self.tri // self.size
        first = self.heads[self.pairs // self.size] == 1  # nothing stands before a text's beginning: occurrences count
        many = np.zeros(len(self.pairs), np.int64)
        np.add.at(many, pair, self.c3)
        self.c2 = np.where(first, many, np.bincount(pair, minlength=len(self.pairs)))
        self.before, self.of = np.unique(self.context(self.tri % self.size, self.pairs[pair] // self.size), return_inverse=True)

    def pair(self, v, w):
        return v.astype(np.int64) * self.size + w

    def context(self, u, v):
        return u.astype(np.int64) * self.many + v


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _by_part(part: np.ndarray, name: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Rows (part, a, b) of the names and counts of each part; part is sorted."""
    kinds, ends = np.unique(part, return_index=True)
    return [(int(k), x.tobytes(), y.astype(np.int64).tobytes()) for k, x, y in zip(kinds, np.split(name, ends[1:]), np.split(n, ends[1:]))]


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "a", "b"])


def _added(parts: DataFrame, kind) -> dict[int, list[np.ndarray]]:
    """By part, the distinct a (arrays of a kind) of rows (part, a, b) and the sums of their b; below 0: the sum of b."""

    def add(key, pdf):
        import pandas as pd

        a, b = np.frombuffer(b"".join(pdf["a"]), kind), [np.frombuffer(x, np.int64) for x in pdf["b"]]
        if key[0] < 0:
            a, b = a[:0], sum(b)
        else:
            a, at = np.unique(a, return_inverse=True)
            b = np.bincount(at, np.concatenate(b)).astype(np.int64)
        return pd.DataFrame({"part": [key[0]], "a": [a.tobytes()], "b": [b.tobytes()]})

    found = parts.groupBy("part").applyInPandas(add, "part int, a binary, b binary").collect()
    return {r["part"]: [np.frombuffer(r["a"], kind), np.frombuffer(r["b"], np.int64)] for r in sorted(found, key=lambda r: r["part"])}


def words(trusted: DataFrame) -> _Words | None:
    """The words of trusted texts, numbered; None without any word."""

    def count(found, keys, learns):
        name, n = np.unique(np.concatenate(found), return_counts=True)
        return _part_batch(_by_part((name >> U(58)).astype(np.int64), name, n))

    found = _added(trusted.select("text").mapInArrow(lambda b: _pieces(b, count), "part int, a binary, b binary"), np.uint64)
    return _Words(*(np.concatenate(x) for x in zip(*found.values()))) if found else None


def learn(trusted: DataFrame, vocabulary, slices: int) -> tuple:
    """(by number, how many different words stand before a word; discounts of orders 1 to 3) of texts whose words the broadcast
    vocabulary numbers."""
    size = len(vocabulary.value.names) + 1

    def count(rows):
        heads = _heads(rows)
        s = _Slice(heads, size)
        for _, _, *columns in _chunks(rows, heads, False):
            s.add(*columns)
        s.close()
        word, n = np.unique(s.pairs % size, return_counts=True)
        of = [np.bincount(np.minimum(c, 5), minlength=6).astype(np.int64).tobytes() for c in (s.c2, s.c3)]
        yield _part_batch([(-2, b"", of[0]), (-3, b"", of[1]), *_by_part(word * 64 // size, word, n)])

    parts = _by_slice(_slices(trusted.select("text"), vocabulary, slices, False), count, "part int, a binary, b binary")
    found = _added(parts, np.int64)
    of = {2: found.pop(-2)[1], 3: found.pop(-3)[1]}
    c = np.zeros(size, np.uint32)
    for number, n in found.values():
        c[number] = n
    of[1] = np.bincount(np.minimum(c[2:], 5), minlength=6)
    return c, *(discounts(dict(enumerate(of[k].tolist()))) for k in (1, 2, 3))


def score(docs: DataFrame, vocabulary, model: tuple, slices: int, turns: int = TURNS) -> DataFrame:
    """(key, total, words) of docs (text, learns, key): the logarithm of the probability of the texts of a key, and their words.
    Slices take turns: the texts are read once a turn, and the shuffle files of one are deleted before the next."""
    c = model[0]
    off = np.concatenate([[0.0], model[1]])
    share = off[np.minimum(c, 3)].sum() / (len(c) - 1)  # the words and the unknown one
    whole = c.sum(dtype=np.int64)
    table = docs.sparkSession.sparkContext.broadcast(c)
    d1, d2, d3 = off, *model[2:]

    def rate(rows):
        c, heads = table.value, _heads(rows)
        s = _Slice(heads, len(c))
        for some, ends, u, v, w, text in _chunks(rows, heads, True):
            own = text < np.repeat([r["learnt"] for r in some], np.diff(ends, prepend=0))
            if own.any():
                s.add(u[own], v[own], w[own])
        s.close()
        off = d2[np.minimum(s.c2, 3) - 1]
        mass, left2 = (np.bincount(s.pairs // s.size, x, s.many) for x in (s.c2, off))
        above2 = s.c2 - off
        off = d3[np.minimum(s.c3, 3) - 1]
        total, left3 = (np.bincount(s.of, x, len(s.before)) for x in (s.c3, off))
        above3 = s.c3 - off
        del off, s.of, s.c2, s.c3
        for some, ends, u, v, w, text in _chunks(rows, heads, True):
            p = c[w]
            p = (p - d1[np.minimum(p, 3)] + share) / whole
            if len(s.pairs):
                pair, hit = _find(s.pairs, s.pair(v, w))
                of = mass[v]
                p = np.where(of > 0, (np.where(hit, above2[pair], 0) + left2[v] * p) / np.where(of > 0, of, 1), p)
                tri, there = _find(s.tri, pair * s.size + u)
                place, seen = _find(s.before, s.context(u, v))
                p = np.where(seen, (np.where(there & hit, above3[tri], 0) + left3[place] * p) / total[place], p)
            p = np.log(p)
            out = {"piece": [r["piece"] for r in some], "n": [r["n"] for r in some], "ids": [r["ids"] for r in some], "own": [], "total": []}
            for a, z in zip([0, *ends[:-1]], ends):
                here = text[a:z]  # ascending
                start = np.flatnonzero(np.diff(here, prepend=-1))
                out["own"].append(_pack(np.diff(here[start], prepend=0)))
                out["total"].append(np.add.reduceat(p[a:z], start).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_pydict(out, pa.schema(list(zip(out, kinds))))

    def add(pdf):
        import pandas as pd

        ids = [x for x in pdf["ids"] if x]  # several: the same texts stand in as many pieces
        size = len(ids[0]) // 12 if ids else 0
        key, many = np.frombuffer(ids[0], np.int64, size), np.frombuffer(ids[0], np.uint32, size, 8 * size).astype(np.int64) * len(ids)
        if many.sum() != pdf["n"].sum():
            raise RuntimeError("a piece's texts came in another order when it was read again")
        total = np.zeros(size)
        for own, x in zip(pdf["own"], pdf["total"]):
            x = np.frombuffer(x, np.float64)
            total[np.cumsum(_unpack(own, 1, len(x))[0])] += x
        return pd.DataFrame({"key": key, "total": total, "words": many})

    totals = None
    for turn in range(min(turns, slices)):
        parts = _slices(docs.select("text", "learns", "key"), vocabulary, slices, True, turn, min(turns, slices))
        found = _by_slice(parts, rate, "piece long, n long, ids binary, own binary, total binary")
        with shuffles_deleted(docs.sparkSession):
            found = materialize(found.groupBy("piece").applyInPandas(add, "key long, total double, words long"), "totals")
        totals = found if totals is None else totals.unionByName(found)
        del parts, found
        free_shuffles(docs.sparkSession)
    return totals.groupBy("key").agg(F.sum("total").alias("total"), F.sum("words").alias("words"))


def rated(docs: DataFrame, keep: list[str], slices: int | None = None) -> DataFrame | None:
    """Columns `keep` of docs (with text and learns), n_words and perplexity (null without words), by a model of the texts that
    learns marks; None if they have no word. Equal texts have one key."""
    slices = slices or max(6, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 3 // 2)
    trusted = docs.where("learns").select("text")
    known = words(trusted)
    if known is None:
        return None
    vocabulary = docs.sparkSession.sparkContext.broadcast(known)
    model = learn(trusted, vocabulary, slices)
    free_shuffles(docs.sparkSession)
    key = F.xxhash64("text").alias("key")
    totals = materialize(score(docs.select("text", "learns", key), vocabulary, model, slices), "totals")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*keep, n.alias("n_words"), key).join(small(totals), "key", "left")
    return rows.select(*keep, "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("total") / F.col("words"))).alias("perplexity"))


def _quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """(lang, own) of values (lang, perplexity, n): the value of rank ceil(quantile * rows) of each language, exactly, found among the
    values of the bin that holds it, so that no task sorts a language's values."""
    from pyspark.sql import Window as W

    step = F.floor(F.log2("perplexity") * 256)
    bins = values.groupBy("lang", step.alias("bin")).agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(W.partitionBy("lang").orderBy("bin"))
    rank = F.greatest(F.ceil(F.lit(quantile) * F.sum("n").over(W.partitionBy("lang"))), F.lit(1))
    bins = bins.withColumn("up_to", up_to).withColumn("rank", rank).where("rank > up_to - n and rank <= up_to")
    bins = bins.select(F.col("lang").alias("__lang"), "bin", (F.col("rank") - F.col("up_to") + F.col("n")).alias("place"))
    inside = values.withColumn("__bin", step).join(bins, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("__bin") == F.col("bin")))
    inside = inside.withColumn("up_to", F.sum("n").over(W.partitionBy("lang").orderBy("perplexity")))
    return inside.where("up_to >= place").groupBy("lang").agg(F.min("perplexity").alias("own"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) of every row of docs."""
    trusted_ids = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct(), "trusted")
    learns = F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(2)) == 0
    marked = docs.select("doc_id", "lang", "text").join(small(trusted_ids.where(learns).withColumn("__learns", F.lit(True))), F.col("doc_id") == F.col("__id"), "left")
    rows = rated(marked.select("doc_id", "lang", "text", F.coalesce("__learns", F.lit(False)).alias("learns")), ["doc_id", "lang"])
    if rows is None:
        n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", n.alias("n_words"), none.alias("perplexity"), none.alias("threshold"), (n > 0).alias("kept"))
    rows = materialize(rows, "judged")
    judged = small(trusted_ids.where(~learns))
    known = rows.where("perplexity is not null").join(judged, F.col("doc_id") == F.col("__id"), "left_semi")
    known = materialize(known.groupBy("lang", "perplexity").agg(F.count(F.lit(1)).alias("n")), "known")
    by = materialize(_quantiles(known, quantile).select(F.col("lang").alias("__lang"), (F.col("own") * slack).alias("own")), "thresholds")
    whole = _quantiles(known.withColumn("lang", F.lit("")), quantile).first()
    whole = whole["own"] * slack if whole else None
    out = rows.join(F.broadcast(by.limit(10_000)), F.col("lang").eqNullSafe(F.col("__lang")), "left") if by.count() <= 10_000 else rows.join(by, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    threshold = F.coalesce("own", F.lit(whole).cast("double"))
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))))
    return out.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the documents that are kept. (doc_id, lang, n_words, perplexity, threshold, kept)."""
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).where("kept")
