"""Embedding near-dedup by a pivot-permutation index (operator 8).

Vectors that are equal form one class first. Each class is described by the ordered list of its nearest reference points
(pivots). Inverted lists, kept by pairs of pivots, retrieve the classes that share at least two of their nearest pivots; the
classes of a list meet in blocks of bounded size, where the number of shared pivots is counted, and the cosine is verified in
double precision. A pair that meets in several lists counts in the list of its two smallest shared pivots alone. What leaves a
task is each class's number of links, and the links that join something new: never all pairs of a list.

Pivots are drawn by a hash of the vector from a bounded sample and are kept apart from each other, so a large group of copies
brings no more than a few of them. Their number grows with the root of the number of classes, so lists stay short. Every class
is indexed; tests measure recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links 0, a
component of their own); vectors of other lengths are strangers to each other; repeated rows are copies and linked; a null
vec_id takes part, and a component's id is the smallest that isn't null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, components, load, map_batches, materialize, small

NEAREST, SHARED = 8, 2
#: Cosine between two pivots at most; pivots at most (the broadcast stays below 2 ** 16 vectors); classes in a block.
APART, MOST, BLOCK = 0.8, 1 << 16, 2048
#: What names a group of classes that meet: the list and two of its blocks.
GROUP = ["dim", "one", "two", "i", "j"]


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, key) of all rows and, by key, the vector as bytes of doubles; key is null where nothing can be linked."""

    def start():
        import hashlib

        def work(batch: pa.RecordBatch) -> dict:
            keys, raw = [], []
            for v in batch.column(batch.schema.get_field_index("embedding")).to_pylist():
                x = None
                if v and all(c is not None for c in v):
                    x = np.array(v, np.float64)
                    x = x + 0.0 if np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0 else None
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if x is not None else None)
                raw.append(x.tobytes() if x is not None else None)
            return {"key": keys, "vector": raw}

        return work

    new = [T.StructField("key", T.BinaryType()), T.StructField("vector", T.BinaryType())]
    return map_batches(vectors.select("vec_id", "embedding"), start, new, ["vec_id"])


def choose(sample: list[bytes], most: int, apart: float = APART) -> dict[int, np.ndarray]:
    """By length: unit vectors of the sample that are apart from all chosen before."""
    by: dict[int, list] = {}
    for raw in sample:
        by.setdefault(len(raw) // 8, []).append(raw)
    out = {}
    for dim, found in by.items():
        x = np.frombuffer(b"".join(found), np.float64).reshape(-1, dim)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        own, n = np.empty((min(most, len(x)), dim)), 0
        for at in range(0, len(x), 256):  # a block against all chosen at once, then one by one within the block
            part = x[at : at + 256]
            part = part[(part @ own[:n].T).max(1, initial=-2) < apart]
            start = n
            for v in part:
                if n < len(own) and (own[start:n] @ v).max(initial=-2) < apart:
                    own[n], n = v, n + 1
        out[dim] = own[:n]
    return out


def _lists(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(key, vector, copies, near, one, two): a row for each pair of a class's nearest pivots, one < two. With fewer than two
    pivots there is one list for the length."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def start():
        known = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            rows, near, one, two, dims = [], [], [], [], []
            raw = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            by: dict[int, list[int]] = {}
            for i, x in enumerate(raw):
                by.setdefault(len(x) // 8, []).append(i)
            for dim, at in by.items():
                p = known.get(dim)
                if p is None or len(p) < 2:
                    for i in at:
                        rows.append(i), near.append([-2, -1]), one.append(-2), two.append(-1), dims.append(dim)
                    continue
                x = np.stack([np.frombuffer(raw[i], np.float64) for i in at])
                cos = x @ p.T
                k = min(NEAREST, len(p))
                best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                best = np.sort(best, axis=1)
                for i, b in zip(at, best.tolist()):
                    for u in range(k):
                        for w in range(u + 1, k):
                            rows.append(i), near.append(b), one.append(b[u]), two.append(b[w]), dims.append(dim)
            return {"__rows": rows, "near": near, "one": one, "two": two, "dim": dims}

        return work

    new = [T.StructField("near", T.ArrayType(T.IntegerType())), *[T.StructField(n, T.IntegerType()) for n in ("one", "two", "dim")]]
    return map_batches(classes, start, new, ["key", "copies"])


def _verify(least: float):
    """Of rows sorted by list and block, group after group: (key, null, links) and the links that join something new. A task
    holds one group and one batch at a time; lists are many and short, so they aren't dealt out as pandas groups."""

    def group(name, raw, near, copies, keys, side, out):
        if len(raw) < 2:
            return
        _, one, two, i, j = name
        x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
        norm = np.sqrt((x * x).sum(1))
        side = np.array(side)
        a = np.flatnonzero(side == 0)
        b = a if i == j else np.flatnonzero(side == 1)
        count, label, copies, hot = np.zeros(len(x), np.int64), np.arange(len(x)), np.array(copies), None
        for at in range(0, len(a), 512):
            r = a[at : at + 512]
            ok = (x[r] @ x[b].T) / (norm[r][:, None] * norm[b][None, :]) >= least
            if i == j:
                ok &= r[:, None] != b[None, :]
            if not ok.any():
                continue
            if hot is None:
                # the pivots below `two` but `one`: a pair that shares any of them counts elsewhere
                near = np.array(near)
                low = np.where((near < two) & (near != one), near, -9)
                names = np.unique(low)
                hot = np.zeros((len(x), len(names)), np.float32)
                hot[np.arange(len(x))[:, None], np.searchsorted(names, low)] = 1
                hot = hot[:, names != -9]
            ok &= hot[r] @ hot[b].T == 0
            count[r] += ok @ copies[b]
            if i != j:
                count[b] += copies[r] @ ok
            for u, hits in zip(r, ok):
                if hits.any():
                    met = b[hits]
                    for l in np.unique(label[met]):
                        if l != label[u]:
                            out.append((keys[u], keys[int(met[label[met] == l][0])], 0))
                            label[label == l] = label[u]
        out += [(keys[u], None, int(count[u])) for u in np.flatnonzero(count)]

    def send(out):
        a, b, n = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def run(batches):
        name, held = None, [[] for _ in range(5)]  # the group that the next batch may go on with
        for batch in batches:
            out: list[tuple] = []
            of = batch.schema.get_field_index
            groups = np.stack([batch.column(of(c)).to_numpy() for c in GROUP], 1)
            columns = [batch.column(of(c)).to_pylist() for c in ("vector", "near", "copies", "key", "side")]
            heads = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1).tolist()]
            for s, e in zip(heads, [*heads[1:], len(groups)]):
                now = tuple(groups[s].tolist())
                if now != name:
                    if name:
                        group(name, *held, out)
                    name, held = now, [c[s:e] for c in columns]
                else:
                    held = [h + c[s:e] for h, c in zip(held, columns)]
            if out:
                yield send(out)
        out = []
        if name:
            group(name, *held, out)
        if out:
            yield send(out)

    return run


def near(vectors: DataFrame, least: float = 0.9, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    rows = materialize(_classes(vectors), "vectors")
    usable = rows.where("key is not null")
    classes = materialize(usable.groupBy("key").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")), "classes")
    n = classes.count()
    want = pivots or min(MOST, max(16, int(8 * n**0.5)))
    share = min(1.0, 2 * want / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "vector").collect()
    chosen = choose([r["vector"] for r in sorted(drawn, key=lambda r: bytes(r["key"]))], want)
    lists = materialize(_lists(classes.select("key", "copies", "vector"), chosen), "lists")
    many = lists.groupBy("dim", "one", "two").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    many = materialize(many.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "lists-met")
    met = lists.join(small(many), ["dim", "one", "two"])
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") != F.col("i")).cast("int"))
    met = met.join(small(classes.select("key", "vector")), "key")
    met = met.select("dim", "one", "two", "i", "j", "side", "key", "copies", "near", "vector")
    met = met.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = materialize(met.mapInArrow(_verify(least), "a binary, b binary, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    label = materialize(components(found.where("b is not null").select("a", "b")), "roots")
    info = classes.select("key", "copies", "least_id").join(small(materialize(links, "counts")), "key", "left")
    info = info.join(small(label.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("component", "key"))
    info = materialize(info.select("key", "copies", "least_id", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    least_id = info.groupBy("root").agg(F.min("least_id").alias("component_id"))
    info = materialize(info.join(least_id, "root").select("key", "copies", "n_links", "component_id"), "classes")
    out = attach(usable.select("vec_id", "key"), info, ["key"], "copies", usable.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: cosine 0.9 or more. (vec_id, n_links, component_id, kept)."""
    return near(load(spark, sf_dir, "embeddings"))
