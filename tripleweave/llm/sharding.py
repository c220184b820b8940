"""Sharding by best-fit-decreasing bin packing (operator 9).

Groups of equal texts are indivisible. Groups enter by falling size; each enters the bin whose remaining capacity is the
tightest that holds it, found in a balanced tree (a treap keyed by remaining capacity). Equal sizes are packed as a run: after
a bin has taken one, it stays the tightest until it holds no more of them, so a whole run is placed at once. The driver
therefore needs only the histogram of group sizes: with t bytes in all there are at most sqrt(2 t) different sizes. Groups,
documents and their bins stay distributed: a group's rank among those of its size picks its run.

Given a number of shards, the smallest capacity is sought at which best-fit-decreasing needs no more bins than that; a group
that alone exceeds its fair part gets a bin of its own first. Given a capacity, as many bins as needed are opened.

Defined results: a null text counts as empty (size 1, crc32 0) and is one group with the empty text; repeated rows each get a
slot; sizes that tie are packed as one run, in the order of the texts' digests; a text of any length is one item; other
columns, of whatever name, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, load, materialize, merged, numbered, ranked, small

#: Parts into which a size class or a shard is split for numbering.
SALTS = 256


class Treap:
    """A balanced tree of (remaining, bin) keys: insert, delete, and the least key not below a bound."""

    def __init__(self) -> None:
        self.root, self._random = None, random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self._random.random(), None, None]), b)

    def delete(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        _, c = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, c)

    def ceiling(self, bound: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= bound:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple], int] | None:
    """Best-fit-decreasing of (size, how many). Runs (size, first rank, last rank, first bin, how many a bin), and the number
    of bins; None if that exceeds `most`. A size above the capacity gets bins of its own."""
    tree, runs, bins = Treap(), [], 0
    for size, n in sorted(classes, reverse=True):
        rank = 0
        while rank < n:
            found = tree.ceiling(size)
            if found is not None:
                rest, b = found
                k = min(n - rank, rest // size)
                tree.delete(found)
                tree.insert((rest - k * size, b))
                runs.append((size, rank, rank + k - 1, b, k))
                rank += k
                continue
            each = max(1, capacity // size)
            new = -(-(n - rank) // each)
            if most is not None and bins + new > most:
                return None
            for i in range(new):
                k = min(each, n - rank - i * each)
                tree.insert((max(0, capacity - k * size), bins + i))
            runs.append((size, rank, n - 1, bins, each))
            rank, bins = n, bins + new
    return runs, bins


def plan(classes: list[tuple[int, int]], shards: int) -> list[tuple]:
    """Runs into `shards` bins of near equal sizes: groups above a fair part get own bins, the rest the least capacity."""
    left, runs, first = sorted(classes, reverse=True), [], 0
    while left and shards - first > 1:
        size, n = left[0]
        if size * (shards - first) <= sum(s * k for s, k in left):
            break
        runs.append((size, 0, 0, first, 1)) if n == 1 else runs.append((size, n - 1, n - 1, first, 1))
        first += 1
        left = ([(size, n - 1)] if n > 1 else []) + left[1:]
    if not left:
        return runs
    total, bins = sum(s * k for s, k in left), shards - first
    low = max(-(-total // bins), left[0][0])
    slack, found = 0, pack(left, low, bins)
    while found is None:
        slack = max(1, slack * 2)
        found = pack(left, low + slack, bins)
    bad = slack // 2
    while slack - bad > max(1, low // 100_000):
        mid = (slack + bad) // 2
        other = pack(left, low + mid, bins)
        if other is None:
            bad = mid
        else:
            slack, found = mid, other
    return runs + [(s, a, z, b + first, k) for s, a, z, b, k in found[0]]


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs, by the number of shards or by capacity in bytes."""
    spark = docs.sparkSession
    meta = numbered(
        merged(docs.select("doc_id", (F.octet_length(_text()) + 1).cast("long").alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), F.unhex(F.md5(_text().cast("binary"))).alias("key"))),
        "row",
    )
    total = meta.count()
    groups = materialize(
        merged(meta.groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("whole", F.col("copies") * F.col("size"))), "groups"
    )
    classes = [(r[0], r[1]) for r in groups.groupBy("whole").count().collect()]  # at most sqrt(2 t) rows
    runs = plan(classes, shards) if capacity is None else pack(classes, capacity)[0]
    table = spark.createDataFrame(runs, "whole long, first long, last long, bin int, each long")
    placed = ranked(groups, ["whole"], F.xxhash64("key"), ["key"], "rank", SALTS).join(small(table, len(runs)), "whole")
    placed = placed.where(F.col("rank").between(F.col("first"), F.col("last"))).select(
        "key", "size", "copies", (F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("int").alias("shard")
    )
    out = attach(meta, materialize(merged(placed), "placed"), ["key", "size"], "copies", total)
    out = ranked(out, ["shard"], F.xxhash64("row"), ["doc_id", "key", "row"], "slot", 4 * SALTS)
    return merged(out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")))


def query(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """op9: all documents into shards 0 to 7 under the law `bytes`. (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    docs = load(spark, sf_dir, "documents") if docs is None else docs
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
