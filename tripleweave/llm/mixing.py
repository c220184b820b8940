"""Mixing sources to target weights by hash-threshold histograms (operator 4).

Each row has a 60-bit hash of its id and text. A source takes every row `base` times, and once more the rows whose hash is
below the source's threshold. The threshold comes from nested histograms: words are summed by source and the hash's leading
10 bits, the bucket in which the source's budget ends is found, and only that bucket is opened by the next 10 bits, until it
holds one row. No row is sorted; every pass sees all rows of the buckets it opens.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that are equal in id and
text share a hash and are taken together, so with many such rows at the boundary a source can miss its target by half their
size; a text of any length is one row; other columns, of whatever name, stay as they were in take() and aren't read in mix(); an
empty table gives no rows. The number of sources is a catalogue: their totals meet on the driver, no row does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WORD, load, materialize, small

BITS, LEVELS = 10, 6


def targets(sizes: list[tuple[str | None, int]], weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets of (source, size), in the order of code points with null last: `share` of all sizes dealt by the repeating
    weights, no more than `most` times a source's size; the excess is dealt again among the others."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, sizes[i][0] or ""))
    weight = {i: weights[k % len(weights)] for k, i in enumerate(order)}
    out, left, open_ = [0.0] * len(sizes), share * sum(s for _, s in sizes), set(order)
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / total > most * sizes[i][1]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = most * sizes[i][1]
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def word_count(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str = "doc_id", text: str = "text") -> Column:
    """60 bits; both ids and texts count, so rows without ids differ as well."""
    return F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text)).bitwiseAND(F.lit((1 << (BITS * LEVELS)) - 1))


def thresholds(meta: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source of meta (source, size, hash): source_size, target, base, below. A row is taken base times, and once
    more if its hash is less than below. Few and narrow rows: one a source."""
    spark = meta.sparkSession
    found = meta.groupBy("source").agg(F.sum("size").alias("n")).collect()
    goal = targets([(r["source"], r["n"]) for r in found], weights, share, most)
    state = []  # source, size, target, base, budget still to take, start of the open bucket
    for r, t in zip(found, goal):
        base = min(int(t // r["n"]), int(most)) if r["n"] else 0
        base -= base == most and base > 0  # exactly the cap: all rows once more
        state.append([r["source"], int(r["n"]), float(t), base, float(t - base * r["n"]), 0, r["n"] > 0])
    kind = "source string, size long, target double, base int, budget double, start long, going boolean"
    for level in range(LEVELS):
        going = [s for s in state if s[6]]
        if not going:
            break
        shift = BITS * (LEVELS - 1 - level)
        now = small(spark.createDataFrame([(s[0], s[4], s[5]) for s in going], "source string, budget double, start long"), len(going))
        m = meta.alias("m").join(now.alias("n"), F.col("m.source").eqNullSafe(F.col("n.source")))
        inside = m.where(F.shiftright(F.col("hash"), shift + BITS) == F.shiftright(F.col("start"), shift + BITS))
        hist = inside.groupBy(F.col("m.source").alias("source"), F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("m.size").alias("words"), F.min("budget").alias("budget"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        cut = hist.withColumn("upto", F.sum("words").over(run)).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
        cut = {r["source"]: r for r in cut.collect()}
        for s in going:
            r = cut.get(s[0])
            if r is None:  # the budget reaches beyond the open bucket
                s[5], s[6] = s[5] + (1 << (shift + BITS)), False
                continue
            s[4] -= r["upto"] - r["words"]
            s[5] = r["bucket"] << shift
            if r["low"] == r["high"] or s[4] <= 0:  # one row, or rows that can't be told apart: the nearer end
                s[5], s[6] = (r["high"] + 1 if 2 * s[4] >= r["words"] else s[5]), False
    rows = [(s[0], s[1], s[2], s[3], s[5]) for s in state]
    return spark.createDataFrame(rows, "source string, source_size long, target double, base int, below long")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs' rows as (doc_id, source, size, source_size, target, copies, taken): the mix takes a row `copies` times."""
    meta = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), row_hash().alias("hash"))
    meta = materialize(meta, "mix")
    th = thresholds(meta, weights, share, most)
    th = small(th).alias("t")
    copies = F.col("base") + (F.col("hash") < F.col("below")).cast("int")
    return (
        meta.alias("m").join(th, F.col("m.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", F.col("m.source").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


def take(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it (0, 1 or 2 times)."""
    key, size, h = "__mix_source", "__mix_size", "__mix_hash"
    meta = docs.select(F.col("source").cast("string").alias("source"), word_count().alias("size"), row_hash().alias("hash"))
    th = thresholds(materialize(meta, "mix"), weights, share, most)
    th = small(th.select(F.col("source").alias(key), F.col("base").alias("__mix_base"), F.col("below").alias("__mix_below")))
    d = docs.withColumn(h, row_hash()).join(th, F.col("source").cast("string").eqNullSafe(F.col(key)))
    copies = F.col("__mix_base") + (F.col(h) < F.col("__mix_below")).cast("int")
    many = F.explode(F.array_repeat(F.lit(0), copies)).alias("__mix_copy")
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], many).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op4: see the module. (doc_id, size, source_size, target, taken, source, copies)."""
    out = mix(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "copies")
