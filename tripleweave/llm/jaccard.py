"""N-gram Jaccard join by token-combination prefixes (operator 10).

A document's set holds its distinct shingle hashes. All shingles are ordered by one rule: rare ones first, by the
level of their count and hash; then the frequent ones, by sub-class and hash. Two sets with Jaccard similarity t share all but floor((1-t)|x|) shingles of either,
so a prefix is extended until a partner can't break it: a rare shingle breaks by itself, a sub-class of frequent shingles
needs all but one of its prefix members broken before no two of them are left together. Rare shingles of the prefix are
indexed alone, frequent ones by pairs within their sub-class, so a common passage alone makes no candidates. How frequent a shingle is
comes from a table of counts by hash cell over all documents (any table gives the same links, only the cost differs). The
number of sub-classes depends on the set's size band; a set is indexed under its own band and the one above, and partners'
bands differ by one at most.

Sets that are equal form one class first. The classes that share a signature and are of one size band or the band below are a
list; sets that link are in one band or in neighbours. A list's hub is its smallest set. Lists are verified twice. First every class is compared with one hub, that of which its lists speak most (a list of m
classes with weight 1/m): one comparison a class, whatever the lists' lengths, which joins large groups of near copies.
Then only lists whose classes are still in several groups are left, and those with one hub are taken together: their classes
meet in blocks of bounded bytes, those of one group not again, and a link counts if it joins something new. So every pair
that shares a signature is either compared or joined already: no list of pairs is made, none is lost, nothing is capped.
Both times the tasks first get sets as 16 bits a shingle, whose common members (with repeats) are no fewer than those of the
sets themselves; whole sets are sent only of classes that this leaves a partner. Prints of sets have 128 bits; the graphs run
on their first 64.

Defined results: null and empty texts have an empty set and are linked with nothing; equal rows fall into one class; a row
with a null id takes part, and a component's id is its smallest id that isn't null; texts of any length are hashed piece by
piece into one set; other columns, of whatever name, stay as they were in keep_one() and aren't read in join(); an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, components, in_map, load, map_batches, materialize, numbered, release, small, texts
from .vectors import U, fold_case, mix, shingles, word_hashes

#: Hash cells of the table of counts, its slices, the bytes of sets in one block, and the prints a task keeps in mind.
CELL_BITS, SLICES, BLOCK_BYTES, KEPT = 24, 256, 16 << 20, 100_000
#: Bits of the map of shared signatures that holds the others back from a join by shuffle.
MAP_BITS = 27


def _band_width(percent: int) -> float:
    """The width of a size band in log(size): the sizes of sets that link differ by one width at most."""
    return float(np.log(100 / percent))


def _cells(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> U(64 - bits)).astype(np.int64)


def cell_levels(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of all documents by hash cell, as floor(log2(count + 1)): a table of fixed size, whatever the input's. Tasks
    send their table in compressed slices; slices are added up in two rounds, so no task meets those of all others."""
    bits, slices_ = CELL_BITS, SLICES
    cells, width = 1 << bits, (1 << bits) // slices_

    def run(batches):
        total, held, size = np.zeros(cells, np.uint32), [], 0

        def add():
            nonlocal held, size
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                total[at] += n.astype(np.uint32)
            held, size = [], 0

        for batch in batches:
            for t in texts(batch):
                held.append(_cells(shingles(word_hashes(fold_case(t)), k), bits))
                size += len(held[-1])
                if size > 1 << 20:
                    add()
        add()
        if total.any():
            slices = [zlib.compress(total[i : i + width].tobytes(), 1) for i in range(0, cells, width)]
            del total
            release()
            yield pa.RecordBatch.from_arrays([pa.array(range(slices_), pa.int32()), pa.array(slices, pa.binary())], names=["part", "n"])

    def add_up(finish):
        def run(key, pdf):
            import pandas as pd

            total = np.zeros(width, np.int64)
            for x in pdf["n"]:
                total += np.frombuffer(zlib.decompress(x), np.uint32)
            return pd.DataFrame({"part": [key[0]], "n": [zlib.compress(finish(total).tobytes(), 1)]})

        return run

    def counts(total):
        return np.minimum(total, 2**32 - 1).astype(np.uint32)

    def levels(total):
        return np.log2(total + 1.0).astype(np.uint8)

    parts = docs.select("text").mapInArrow(run, "part int, n binary")
    some = parts.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(8))).groupBy("part", "lot").applyInPandas(add_up(counts), "part int, n binary")
    out = np.zeros(cells, np.uint8)
    for r in some.groupBy("part").applyInPandas(add_up(levels), "part int, n binary").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["n"]), np.uint8)
    return out


def common_level(levels: np.ndarray) -> int:
    """Shingles in cells of this level and above count as frequent: eight times the mean cell, 64 at least."""
    found = np.bincount(levels)  # levels are few: no wide copy of the table
    mean = found @ (np.exp2(np.arange(len(found))) - 1) / len(levels)
    return int(np.ceil(np.log2(8 * mean + 64)))


def signatures(s: np.ndarray, levels: np.ndarray, common: int, percent: int) -> np.ndarray:
    """The indexed signatures of a sorted set of shingles. levels: by hash cell."""
    n = len(s)
    need = n * (100 - percent) // 100 + 1
    level = levels[_cells(s, len(levels).bit_length() - 1)]
    few = level < common
    rare = s[few]
    rare = rare[np.argsort(level[few], kind="stable")]
    if len(rare) >= need:
        return rare[:need]
    often, out = s[~few], [rare]
    width = _band_width(percent)
    band = int(np.log(n) / width + 1e-9)
    for b in (band, band + 1):
        classes = max(1, int(np.exp(b * width) / 8))
        sub = (mix(often) % U(classes)).astype(np.int64)
        order = np.lexsort((often, sub))
        c, sub = often[order], sub[order]
        new = np.concatenate([[True], sub[1:] != sub[:-1]])
        units = np.cumsum(~new) + len(rare)
        end = int(np.searchsorted(units, need)) + 1  # the shortest prefix that can't be broken
        first = np.flatnonzero(new[:end])
        for i, a in enumerate(first):
            z = first[i + 1] if i + 1 < len(first) else min(end, len(c))
            x, y = np.triu_indices(z - a, 1)
            out.append(mix(c[a:z][x] * U(0x9E3779B97F4A7C15) + c[a:z][y] + U(b)))
    return np.unique(np.concatenate(out))


def _prints(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _node(p: bytes | None) -> int | None:
    return None if p is None else int.from_bytes(p[:8], "little", signed=True)


def scan(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, print, node, n_shingles, signatures) of every row; an empty set has no print. node: the print's first half.
    A set that the task has seen before (as far as it keeps prints) has no signatures: its class has them already."""

    table, common = docs.sparkSession.sparkContext.broadcast(levels), common_level(levels)

    def start():
        levels, seen = table.value, set()

        def work(batch: pa.RecordBatch) -> dict:
            prints, sizes, sigs = [], [], []
            for t in texts(batch):
                s = shingles(word_hashes(fold_case(t)), k)
                p = _prints(s) if len(s) else None
                sizes.append(len(s))
                prints.append(p)
                sigs.append(signatures(s, levels, common, percent).view(np.int64) if len(s) > 1 and p not in seen else [])
                if len(seen) >= KEPT:
                    seen.clear()
                seen.add(p)
            return {"print": prints, "node": [_node(x) for x in prints], "n_shingles": sizes, "signatures": sigs}

        return work

    new = [T.StructField("print", T.BinaryType()), T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("signatures", T.ArrayType(T.LongType()))]
    return map_batches(docs.select("doc_id", "text"), start, new, ["doc_id"])


def _held_back(found: DataFrame, many: DataFrame) -> DataFrame:
    """(node, n_shingles, sig) of found without signatures whose bit in a map of those in many isn't set: what is left
    holds all of many, and of the others the share of the map that is set."""
    bits = MAP_BITS
    table = found.sparkSession.sparkContext.broadcast(bit_map(many, "sig", bits))

    def start():
        bitmap = table.value

        def work(batch: pa.RecordBatch) -> dict:
            lists = batch.column(batch.schema.get_field_index("signatures"))
            sigs, sizes = lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            good = in_map(bitmap, sigs.view(np.uint64), bits)
            rows = np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))
            return {"__rows": rows[good], "sig": sigs[good]}

        return work

    return map_batches(found.select("node", "n_shingles", "signatures").where("size(signatures) > 0"), start, [T.StructField("sig", T.LongType())], ["node", "n_shingles"])


def _lists(found: DataFrame, percent: int) -> DataFrame:
    """(list, node, hub, center, many), each once: the classes of each signature that several share, of one size band and the
    one below; the list's smallest set as a number and as a class, and how many they are. Hubs that fall on one number by
    chance only meet each other too."""
    sig = found.select(F.explode("signatures").alias("sig"), "node", "n_shingles")
    many = sig.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least != last").select("sig")
    many = materialize(many, "signatures")
    few = small(many)
    sig = materialize((sig if few is not many else _held_back(found, many)).join(few, "sig").select("sig", "node", "n_shingles"), "shared")
    key = F.shiftleft(F.least("n_shingles", F.lit((1 << 22) - 1)), 40).bitwiseOR(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1)))
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / _band_width(percent) + 1e-9).cast("int")
    each = sig.select("sig", "node", key.alias("key"), band.alias("own")).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    each = each.select(F.xxhash64("sig", "band").alias("list"), "node", "key", (F.col("own") == F.col("band")).alias("own"))
    # a list needs two classes, one of them of the band itself
    met = each.groupBy("list").agg(F.min("key").alias("hub"), F.min_by("node", "key").alias("center"), F.min("node").alias("least"), F.max("node").alias("last"), F.max("own").alias("own"), F.count(F.lit(1)).alias("many"))
    met = materialize(met.where("least != last and own").select("list", "hub", "center", "many"), "met")
    return materialize(each.select("list", "node").join(small(met), "list").distinct(), "lists")


def _sets(docs: DataFrame, found: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(node, n, set, short) of the classes in lists; texts are read again by one id of each class, and equal rows come again.
    short: the last 16 bits of each shingle, sorted."""
    ids = found.join(lists.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = materialize(ids.select("doc_id").distinct(), "ids")

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            found = [shingles(word_hashes(fold_case(t)), k) for t in texts(batch)]
            short = [np.sort(s.astype(np.uint16)).tobytes() for s in found]
            return {"node": [_node(_prints(s)) if len(s) else None for s in found], "n": [len(s) for s in found], "set": [s.tobytes() for s in found], "short": short}

        return work

    chosen = docs.select("doc_id", "text").join(small(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    new = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("short", T.BinaryType())]
    return materialize(map_batches(chosen, start, new, []), "sets")


def _members(raw: bytes, whole: bool) -> np.ndarray:
    """A set's members, sorted; of a short form with a number for each repeat, so that common members count with repeats."""
    if whole:
        return np.frombuffer(raw, np.uint64)
    v = np.frombuffer(raw, np.uint16).astype(np.int64)
    return (v << 32) + np.arange(len(v)) - np.searchsorted(v, v)


def _groups(batches, names: list[str]):
    """Of batches sorted by names: (values of names, columns as lists) piece by piece; a group can come in several pieces."""
    for batch in batches:
        columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
        keys = list(zip(*[columns[n] for n in names]))
        a = 0
        while a < len(keys):
            z = a + 1
            while z < len(keys) and keys[z] == keys[a]:
                z += 1
            yield keys[a], {c: v[a:z] for c, v in columns.items()}
            a = z


def _pairs_out(pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _stars(sets: DataFrame, best: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b): hub and node of best (node, hub), one hub a node, whose sets (or short forms) are similar enough. A hub of many
    nodes is dealt over several tasks."""
    hubs = best.groupBy("hub").agg(F.count(F.lit(1)).alias("nodes")).select("hub", F.ceil(F.col("nodes") / 512).cast("int").alias("parts"))
    hubs = materialize(hubs, "hubs")
    best = best.join(small(hubs), "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    sets = sets.select("node", F.col("set" if whole else "short").alias("set"))
    own = sets.join(small(materialize(best, "stars-of")), "node").select("hub", "part", F.lit(1).alias("side"), "node", "set")
    hubs = hubs.select(F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hubs = sets.join(small(materialize(hubs, "hub-parts")), "node").select(F.col("node").alias("hub"), "part", F.lit(0).alias("side"), "node", "set")

    def run(batches):
        name, center = None, None
        for now, x in _groups(batches, ["hub", "part"]):
            out = []
            for side, node, raw in zip(x["side"], x["node"], x["set"]):
                s = _members(raw, whole)
                if side == 0:
                    name, center = now, s
                    continue
                if percent * max(len(s), len(center)) <= 100 * min(len(s), len(center)):
                    at = np.minimum(np.searchsorted(center, s), len(center) - 1)
                    both = int(np.count_nonzero(center[at] == s))
                    if 100 * both >= percent * (len(s) + len(center) - both):
                        out.append((name[0], node))
            if out:
                yield _pairs_out(out)

    both = own.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "side")
    return materialize(both.mapInArrow(run, "a long, b long"), "stars")


def _verify(block: dict, percent: int, whole: bool) -> list[tuple[int, int]]:
    """Of the classes of one hub (node, group, n, set, side), or of two blocks of them, those of a block only with the other's:
    the links that join something new; or, of short forms, (hub, node) of all that may have a partner in another group."""
    order = np.argsort(np.array(block["n"]), kind="stable")
    n, node = np.array(block["n"])[order], np.array(block["node"])[order]
    label = np.unique(np.array(block["group"])[order], return_inverse=True)[1]
    if label.min() == label.max():
        return []
    side, own = np.array(block["side"])[order], block["i"][0] == block["j"][0]
    sets = [_members(block["set"][i], whole) for i in order]
    vocab, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    # inverted lists: which sets hold a shingle; shingles of one set alone are left out
    owner = np.repeat(np.arange(len(sets)), n)[np.argsort(at, kind="stable")]
    many = np.bincount(at, minlength=len(vocab))
    first = np.cumsum(many) - many
    out, hit = [], np.zeros(len(sets), bool)
    low = np.searchsorted(100 * n, percent * n)  # the smallest partner of each
    for r in range(1, len(sets)):
        rest = np.arange(low[r], r)
        rest = rest[(label[rest] != label[r]) & (own | (side[rest] != side[r]))]
        if not len(rest):
            continue
        mine = at[ends[r] - n[r] : ends[r]]
        mine = mine[many[mine] > 1]
        span = np.repeat(first[mine] - np.cumsum(many[mine]) + many[mine], many[mine]) + np.arange(many[mine].sum())
        both = np.bincount(owner[span], minlength=len(sets))[rest]
        good = rest[100 * both >= percent * (n[r] + n[rest] - both)]
        hit[good] = True
        hit[r] |= len(good) > 0
        for x in good if whole else ():
            if label[r] != label[x]:
                label[label == label[x]] = label[r]
                out.append((int(node[x]), int(node[r])))
    return out if whole else [(block["hub"][0], int(x)) for x in node[hit]]


def _meet(sets: DataFrame, sizes: DataFrame, member: DataFrame, percent: int, whole: bool) -> DataFrame:
    """_verify() of the members (hub, node, group) of each hub; those that are too many for a task are cut into blocks that meet
    in pairs. sizes: (node, n) of sets, written down apart, so that no set is read to be measured."""
    sets = sets.select("node", "n", F.col("set" if whole else "short").alias("set"))
    size = member.join(small(sizes), "node").groupBy("hub")
    size = size.agg((F.sum("n") * (8 if whole else 2)).alias("bytes"), F.min("group").alias("g"), F.max("group").alias("z")).where("g != z")
    blocks = size.select("hub", F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    rows = member.join(small(materialize(blocks, "blocks")), "hub")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "group")
    rows = sets.join(small(materialize(rows, "meet")), "node").select("hub", "i", "j", "side", "node", "group", "n", "set")

    def run(batches):
        name, held = None, {}

        def done():
            return _verify(held, percent, whole) if name and len(held["node"]) > 1 else []

        for now, x in _groups(batches, ["hub", "i", "j"]):
            if now == name:
                held = {c: held[c] + x[c] for c in held}
                continue
            out = done()
            if out:
                yield _pairs_out(out)
            name, held = now, x
        out = done()
        if out:
            yield _pairs_out(out)

    return materialize(rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(run, "a long, b long"), "links")


def _rest(sets: DataFrame, lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links within lists whose classes are in several groups (node, group; a class without is its own group),
    by hub."""
    member = lists.select("list", "node", "hub").join(small(groups), "node", "left").withColumn("group", F.coalesce("group", "node"))
    left = member.groupBy("list").agg(F.min("group").alias("g"), F.max("group").alias("z")).where("g != z").select("list")
    member = materialize(member.join(small(materialize(left, "lists-left")), "list").select("hub", "node", "group").distinct(), "met")
    sizes = materialize(sets.select("node", "n"), "sizes")
    likely = _meet(sets, sizes, member, percent, False).select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct()
    return _meet(sets, sizes, materialize(member.join(small(materialize(likely, "likely")), ["hub", "node"]), "met"), percent, True)


def _links(docs: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root): the components of all links between classes; a class without a link isn't there."""
    lists = _lists(found, percent)
    sets = _sets(docs, found, lists, k)
    met = lists.where("node != center").groupBy("node", "center").agg(F.sum(1 / F.col("many")).alias("weight"))
    best = materialize(met.groupBy("node").agg(F.max_by("center", "weight").alias("hub")), "best")
    likely = _stars(sets, best, percent, False).select(F.col("b").alias("node"), F.col("a").alias("hub"))
    near = _stars(sets, likely, percent, True)
    groups = materialize(components(near).select("node", F.col("component").alias("group")), "groups")
    more = _rest(sets, lists, groups, percent)
    return materialize(components(near.unionByName(more)).select("node", F.col("component").cast("string").alias("root")), "roots")


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, print) of every row of docs; linked: 100 * intersection >= percent * union."""
    found = materialize(scan(docs, k, percent, cell_levels(docs, k)), "jaccard")
    label = _links(docs, found, k, percent)
    rows = found.select("doc_id", "print", "node", "n_shingles")
    some, none = rows.where("print is not null"), rows.where("print is null")  # an empty set stands alone
    some = some.join(small(label), "node", "left").withColumn("root", F.coalesce("root", F.hex("print")))
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    shared = materialize(least.where("n > 1"), "shared")
    out = some.join(small(shared), "root", "left")
    # without a partner a row is its own component
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("n").isNull(), F.col("doc_id"))).alias("component_id"), "print").unionByName(
        none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "print")
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the row with the smallest id stays (of equal ids one row, of a
    component without ids one row). Only ids of rows that go are joined back."""
    tagged = numbered(docs, "__jac_row")
    found = join(tagged.select(F.col("__jac_row").alias("doc_id"), "text"), k, percent)
    go = materialize(found.where("doc_id != component_id").select(F.col("doc_id").alias("__jac_row")), "dropped")
    return tagged.join(small(go), "__jac_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: three-word shingles, similarity 0.9. (doc_id, n_shingles, component_id)."""
    return join(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
