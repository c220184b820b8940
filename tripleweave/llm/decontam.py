"""Benchmark decontamination by q-gram lemma filtering (operator 6).

Texts are normalised: A-Z in lower case, other ASCII but digits as one space. Two strings within k edits share at least
m - q + 1 - k q of the m - q + 1 q-grams of the first, all on neighbouring diagonals. So the q-grams (8 bytes, read as 64-bit
integers) that a document shares with a benchmark item are counted in overlapping diagonal bands, each as wide as two edit
budgets and shifted by one; bands that reach the bound are verified by banded alignment of the whole item. The edit budget is
a share of the item's length, and less for items so short that the bound would vanish; items below q match exactly.

The benchmark is a stated query set: it is worked through in blocks of bounded bytes, each block's q-gram index is sent to
the tasks, and every document is scanned once a block, in pieces that overlap by more than an item's length.

Defined results: null and empty texts and items match nothing; equal items are each reported; several matches of an item in a
document give the best one (fewest edits, then leftmost); empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, map_batches, texts

Q, EDITS = 8, 0.08
#: Bytes of items in a block, and of a document in a piece.
BLOCK_BYTES, PIECE = 4 << 20, 1 << 20
_MAP = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _MAP[_b] = _b
_MAP[65:91] = np.arange(97, 123)


def normalize(text: str) -> tuple[bytes, np.ndarray]:
    """The normal form, and the place in the text's UTF-8 of each of its bytes."""
    a = _MAP[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    gap = a == 32
    keep = np.flatnonzero(~(gap & np.concatenate([[True], gap[:-1]])))
    if len(keep) and a[keep[-1]] == 32:
        keep = keep[:-1]
    return a[keep].tobytes(), keep


def grams(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as integers."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for k in range(min(Q, n)):
        own = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
        out[k::8] = own[: len(out[k::8])]
    return out


def budget(m: int, edits: float = EDITS) -> tuple[int, int]:
    """Edits allowed for an item of m bytes, and the q-grams that must then be shared."""
    k = max(0, min(int(m * edits), (m - Q) // Q))
    return k, m - Q + 1 - k * Q


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS) -> None:
        self.ids, self.items = [], []
        for i, t in items:
            n = normalize(t or "")[0]
            if n:
                self.ids.append(i)
                self.items.append(n)
        g = [grams(x) for x in self.items]
        code = np.concatenate([np.zeros(0, np.uint64), *g])
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in g]])
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.many = np.unique(code[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self._cell(self.codes)] = True
        self.length = np.array([len(x) for x in self.items], np.int64)
        self.edits, self.bound = (np.array(x, np.int64) for x in zip(*[budget(len(x), edits) for x in self.items])) if self.items else (np.zeros(0, np.int64),) * 2
        self.short = [i for i, x in enumerate(self.items) if len(x) < Q]
        self.longest = int(self.length.max(initial=0))

    @staticmethod
    def _cell(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's place, start, end, edits) in the normal form of the text; the best match of each item."""
        data = text if isinstance(text, bytes) else normalize(text)[0]
        best: dict[int, tuple[int, int, int]] = {}
        step = PIECE + 2 * self.longest
        for at in range(0, max(1, len(data)), PIECE):
            for i, a, z, e in self._piece(data[at : at + step]):
                if i not in best or (e, a + at) < (best[i][2], best[i][0]):
                    best[i] = (a + at, z + at, e)
        return [(i, *x) for i, x in sorted(best.items())]

    def _piece(self, data: bytes):
        for i in self.short:
            a = (b" " + data + b" ").find(b" " + self.items[i] + b" ")
            if a >= 0:
                yield i, a, a + len(self.items[i]), 0
        g = grams(data)
        if not len(g) or not len(self.codes):
            return
        at = np.flatnonzero(self.filter[self._cell(g)])
        if not len(at):
            return
        c = np.minimum(np.searchsorted(self.codes, g[at]), len(self.codes) - 1)
        hit = self.codes[c] == g[at]
        at, c = at[hit], c[hit]
        many = self.many[c]
        which = np.repeat(self.first[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, where = self.item[which], np.repeat(at, many)
        some = np.bincount(item, minlength=len(self.items)) >= np.maximum(1, self.bound)  # before any sorting
        use = some[item]
        if not use.any():
            return
        item, diagonal, place = item[use], (where[use] - self.place[which[use]]) + self.longest, self.place[which[use]]
        wide = self.edits[item] + 1
        tried: dict[int, int] = {}
        for shift in (0, 1):  # bands of two budgets, overlapping by one
            band = (diagonal + shift * wide) // (2 * wide)
            order = np.lexsort((place, band, item))
            x, y, z = item[order], band[order], place[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            own = new | np.concatenate([[True], z[1:] != z[:-1]])  # an item's q-gram counts once a band
            head = np.flatnonzero(new)
            n = np.add.reduceat(own.astype(np.int64), head)
            head = head[n >= np.maximum(1, self.bound[x[head]])]
            for i, b in zip(x[head].tolist(), y[head].tolist()):
                k, m = int(self.edits[i]), int(self.length[i])
                low = b * 2 * (k + 1) - shift * (k + 1) - self.longest
                a, z = max(0, low - k), min(len(data), low + 2 * (k + 1) + m + k)
                exact = data.find(self.items[i], a, z)
                found = (exact, exact + m, 0) if exact >= 0 else align(self.items[i], data[a:z], k, a) if k and tried.get(i, k + 1) else None
                if found:
                    tried[i] = found[2]
                    yield i, *found


def align(item: bytes, window: bytes, k: int, at: int = 0) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of item in window within k edits, by rows of a banded alignment; the band is the
    window, whose width over the item's length is the filter's band and two budgets."""
    p, w = np.frombuffer(item, np.uint8), np.frombuffer(window, np.uint8)
    n = len(w)
    cost, start, j = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    big = 1 << 32
    width = max(0, n - len(p)) + k + 1  # cells further right than this can't end within k edits
    for r, b in enumerate(p):
        lo, hi = max(0, r - k), min(n, r + width + k) + 1
        new = np.full(n + 1, k + 1, np.int64)
        origin = start.copy()
        c = cost[lo:hi] + 1
        diag = np.concatenate([[k + 1] if lo == 0 else [cost[lo - 1] + (w[lo - 1] != b)], cost[lo : hi - 1] + (w[lo : hi - 1] != b)])
        dfrom = np.concatenate([[0] if lo == 0 else [start[lo - 1]], start[lo : hi - 1]])
        take = diag <= c
        v, s = np.where(take, diag, c), np.where(take, dfrom, start[lo:hi])
        run = np.minimum.accumulate((v - j[lo:hi]) * big + s)
        new[lo:hi], origin[lo:hi] = (run // big) + j[lo:hi], run % big
        cost, start = new, origin
        if cost.min() > k:
            return None
    e = int(cost.argmin())
    return (at + int(start[e]), at + e, int(cost[e])) if cost[e] <= k else None


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The items in blocks of about so many bytes, one at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): places, in characters of the document's text, of items within their budget."""
    spark, out = docs.sparkSession, None
    new = [T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "edits")]
    for block in blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(block, edits))

        def start(index=index):
            ix = index.value

            def work(batch: pa.RecordBatch) -> dict:
                rows, cols = [], [[], [], [], []]
                for r, t in enumerate(texts(batch)):
                    data, at = normalize(t)
                    found = ix.search(data)
                    raw = t.encode("utf-8", "surrogatepass") if found else b""
                    for i, a, z, e in found:
                        a, z = (len(raw[:x].decode("utf-8", "ignore")) for x in (at[a], at[z - 1] + 1))
                        rows.append(r)
                        for c, v in zip(cols, (ix.ids[i], a, z, e)):
                            c.append(v)
                return {"__rows": rows} | {f.name: c for f, c in zip(new, cols)}

            return work

        part = map_batches(docs.select("doc_id", "text"), start, new, ["doc_id"])
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.select("doc_id").limit(0).select("doc_id", *[F.lit(None).cast("long").alias(f.name) for f in new])
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """docs without the rows that hold an item, all columns as they were."""
    for block in blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, edits))

        def start(index=index):
            ix = index.value
            return lambda batch: {"__rows": [r for r, t in enumerate(texts(batch)) if not ix.search(t)]}

        docs = map_batches(docs, start, [])
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op6: documents that hold benchmark passages. (doc_id, item_id, start, end, edits)."""
    return matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
