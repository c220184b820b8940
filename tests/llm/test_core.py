"""Operators 4, 6, 7, 9 and 10 against brute force, and their defined results on odd input."""

import hashlib
import pathlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleweave.llm import bpe, common, decontam, jaccard, mixing, sharding, vectors

jaccard.CELL_BITS, jaccard.SLICES = 14, 8
KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(3000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], KIND)


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    rows = [(1, None, None), (2, "", "a"), (None, "one two three four", None), (3, " \t\n ", "b"), (4, "x" * 3000, "a"), (5, "same text here now", "a")]
    rows += [(5, "same text here now", "a")] * 3 + [(6 + i, prose(r, 60), "b") for i in range(5)] + [(None, None, None)]
    return docs_of(spark, rows).withColumn("size", F.lit(1)).withColumn("print", F.lit("x")).withColumn("hash", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def near(spark):
    r = random.Random(5)
    rows, at = [], 0
    for g in range(25):
        base = [r.choice(WORDS) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            at += 1
            rows.append((at * 3, " ".join(w).title(), f"s{g % 3}"))
    shared = prose(r, 40)
    for i in range(40):
        rows.append((1000 + i, shared + " " + prose(r, r.choice([1, 2, 3, 30, 200])), "t"))
    return rows


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)]
    got = {x[0]: x[1] for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_unfinished(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        common.components(chain, max_rounds=1)


def test_word_hashes():
    t = "Áb  cD\tef\n" + "x" * 3_000_000 + " tail " + "y " * 700_000
    data = vectors.fold_case(t)
    h = vectors.word_hashes(data)
    seen = {}
    assert len(h) == len(data.split())
    assert all(seen.setdefault(w, x) == x for w, x in zip(data.split(), h.tolist()))
    assert len(set(seen.values())) == len(seen)


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("common_from", [None, 0, 2])
def test_jaccard_join(spark, near, monkeypatch, common_from):
    if common_from is not None:
        monkeypatch.setattr(jaccard, "common_level", lambda levels: common_from)
    sets = {i: grams(t) for i, t, _ in near}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = union(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs_of(spark, near)).collect()}
    assert len(links) > 20
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_blocks(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1500)
    sets = {i: grams(t) for i, t, _ in near}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in jaccard.join(docs_of(spark, near)).collect()}
    assert got == union(links, sets)


def test_jaccard_signatures_by_shuffle(spark, near, monkeypatch):
    """More shared signatures than are broadcast: a bit map holds the others back before the join; all links stay."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    for bits in (15, 27):
        monkeypatch.setattr(jaccard, "MAP_BITS", bits)
        sets = {i: grams(t) for i, t, _ in near}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
        got = {r.doc_id: r.component_id for r in jaccard.join(docs_of(spark, near)).collect()}
        assert got == union(links, sets)
    r = random.Random(5)
    keys = [r.randrange(-(2**63), 2**63) for _ in range(4000)]
    found = spark.createDataFrame([(i, 5, keys[10 * i : 10 * i + 10]) for i in range(400)] + [(400, 5, None), (401, 5, [])], "node long, n_shingles long, signatures array<long>")
    many = spark.createDataFrame([(x,) for x in keys[::50]], "sig long")
    left = [(x.node, x.sig) for x in jaccard._held_back(found, many).collect()]
    assert {(50 * i // 10, x) for i, x in enumerate(keys[::50])} <= set(left) <= {(i // 10, x) for i, x in enumerate(keys)}
    assert len(left) < 100


@pytest.mark.parametrize("common_from", [None, 0])
def test_jaccard_join_sampled(spark, monkeypatch, common_from):
    """Copies by deletions and insertions of 58 to 70 shingles: the first look holds some whole and samples the others."""
    if common_from is not None:
        monkeypatch.setattr(jaccard, "common_level", lambda levels: common_from)
    r, found = random.Random(7), []
    for n in range(60, 73):
        for few in (1, 2, 4):
            w = prose(r, n).split()
            at = r.randrange(n - few)
            found += [w, w[:-few]]
            w = prose(r, n).split()
            found += [w, w[:at] + prose(r, few).split() + w[at:]]
            w = prose(r, n).split()
            found += [w, w[:at] + w[at + few :]]
    rows = [(i, " ".join(w), None) for i, w in enumerate(found)]
    sets = {i: grams(t) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert sum(len(sets[a]) // 64 != len(sets[b]) // 64 for a, b in links) >= 5
    got = {r.doc_id: r.component_id for r in jaccard.join(docs_of(spark, rows)).collect()}
    assert got == union(links, sets)


@pytest.mark.parametrize("common_from", [None, 0])
def test_keep_one_unequal_lengths(spark, monkeypatch, common_from):
    """Similarity 0.8: a copy cut short and one with a passage put in can be a quarter shorter or longer."""
    if common_from is not None:
        monkeypatch.setattr(jaccard, "common_level", lambda levels: common_from)
    r, found = random.Random(8), []
    for n in (40, 66, 100, 150, 310, 800):
        for share in (0.81, 0.84, 0.88, 0.93, 0.78):
            few = int(n * (1 - share))
            w = prose(r, n).split()
            found += [w, w[: n - few]]
            w, at = prose(r, n - few).split(), r.randrange(n - few)
            found += [w, w[:at] + prose(r, few).split() + w[at:]]
    rows = [(i, " ".join(w), None) for i, w in enumerate(found)]
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for i, w in enumerate(found)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sum(min(len(sets[a]), len(sets[b])) < 0.9 * max(len(sets[a]), len(sets[b])) for a, b in links) >= 15
    want = {i for i, first in union(links, sets).items() if i == first}
    assert {x.doc_id for x in jaccard.keep_one(docs_of(spark, rows), k=5, percent=80).collect()} == want


def test_keep_one_of_a_join(spark):
    """Rows that come out of a shuffle are numbered once: all unique ones stay, and one of the copies."""
    r = random.Random(12)
    rows = [(i, prose(r, 20), None) for i in range(60)] + [(100 + i, "all the same words in this one text", None) for i in range(200)]
    d = docs_of(spark, rows)
    d = d.drop("source").join(d.select("doc_id", "source"), "doc_id").repartition(7, "text")
    left = [x.doc_id for x in jaccard.keep_one(d).collect()]
    assert sorted(i for i in left if i < 100) == list(range(60)) and len(left) == 61


def test_jaccard_hot_passage(spark):
    """Many texts with one passage, long ones and very long ones, and near copies among them: the hubs' classes meet in blocks."""
    r, found = random.Random(13), []
    passage = prose(r, 60)
    for i in range(40):
        t = f"{prose(r, r.choice([4, 10, 40, 2000]))} {passage} {prose(r, r.choice([0, 3, 20]))}"
        found += [t, t + " end"] if i % 3 == 0 else [t]
    sets = dict(enumerate(map(grams, found)))
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {x.doc_id: x.component_id for x in jaccard.join(docs_of(spark, [(i, t, None) for i, t in enumerate(found)])).collect()}
    assert got == union(links, sets) and len(links) >= 14


def test_jaccard_odd(spark, odd):
    got = jaccard.join(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert len(got) == odd.count()
    assert sorted((r[1], r[2]) for r in got if r[0] == 5) == [(2, 5)] * 4
    assert [(r[1], r[2]) for r in got if r[0] in (1, 2, 3)] == [(0, r[0]) for r in got if r[0] in (1, 2, 3)]
    assert jaccard.join(odd.limit(0)).count() == 0
    left = jaccard.keep_one(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 3


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, live, out = 1.5 * sum(sizes.values()), set(order), {}
    while live:
        tot = sum(w[s] for s in live)
        full = {s for s in live if left * w[s] / tot > 2 * sizes[s]}
        if not full:
            return out | {s: left * w[s] / tot for s in live}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        live -= full
    return out


def test_decontam_many_items():
    """More items in a block than 2 ** 17, and a long item, are found alike."""
    name = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    index = decontam.Index([(i, name(i)) for i in range(150_000)] + [(-1, "".join(map(name, range(-150_000, 0))))])
    for i in (0, 131_071, 131_072, 149_999):
        assert [(index.ids[x[0]], x[3]) for x in index.search(f"well, {name(i)}!")] == [(i, 0)]


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(1, 80)), r.choice(["a", "a", "a", "b", "c", None, "é", "Z"])) for i in range(1500)]
    d = docs_of(spark, rows)
    got = mixing.mix(d).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    goal = water(sizes)
    for x in got:
        assert x.size == len(rows[x.doc_id][1].split()) and x.source_size == sizes[x.source] and 0 <= x.taken <= 2 * x.size
        assert x.target == pytest.approx(goal[x.source])
        taken[x.source] += x.taken
    assert all(abs(taken[s] - goal[s]) <= 40 for s in sizes)
    assert sorted(map(str, mixing.mix(d.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.take(d).count() == sum(x.copies for x in got)


def test_mix_odd(spark, odd):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.take(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def fit(sizes, cap):
    bins = []
    for s in sorted(sizes, reverse=True):
        ok = [b for b in range(len(bins)) if bins[b] >= s]
        if ok:
            bins[min(ok, key=lambda b: (bins[b], b))] -= s
        else:
            bins.append(max(0, cap - s))
    return sorted(bins)


def test_pack():
    r = random.Random(4)
    for _ in range(60):
        sizes = [r.choice([3, 5, 7, 11, 40, r.randint(1, 60)]) for _ in range(r.randint(1, 120))]
        cap = r.randint(40, 130)
        classes = [(s, sizes.count(s)) for s in set(sizes)]
        runs, bins = sharding.pack(classes, cap)
        fill = defaultdict(int)
        for size, a, z, b, k in runs:
            for rank in range(a, z + 1):
                fill[b + (rank - a) // k] += size
        assert len(fill) == bins and sum(fill.values()) == sum(sizes)
        assert sorted(max(0, cap - x) for x in fill.values()) == fit(sizes, cap)


def test_shard(spark):
    r = random.Random(6)
    rows = [(i, prose(r, r.randint(1, 50)), "a") for i in range(600)] + [(1000 + i, "copy of it", "a") for i in range(90)] + [(None, None, "a"), (7, "", "a")]
    got = sharding.shard(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    load, slots = defaultdict(int), defaultdict(list)
    for x in got:
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) < 0.01 * sum(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({x.shard for x in got if x.doc_id and x.doc_id >= 1000}) == 1
    cap = sharding.shard(docs_of(spark, rows), None, 2000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert max(x.n for x in cap) <= 2000 and len(cap) == -(-sum(load.values()) // 2000)


def test_shard_odd(spark, odd):
    assert sharding.shard(odd).count() == odd.count()
    assert sharding.shard(odd.limit(0)).count() == 0
    hot = docs_of(spark, [(i, "hot " * 30, "a") for i in range(50)] + [(100 + i, f"t{i}" * (i % 7), "a") for i in range(99)])
    assert sharding.shard(hot).select("shard").distinct().count() == 8


def test_shard_writes_few_files(spark):
    rows = [(i, "w" * (i % 40), None) for i in range(900)]
    first = len(common._WRITTEN)
    got = sharding.shard(docs_of(spark, rows).repartition(211))
    assert sorted(x.doc_id for x in got.collect()) == list(range(900))
    most = 4 * spark.sparkContext.defaultParallelism
    assert len(common._WRITTEN) > first
    for path in common._WRITTEN[first:]:
        assert len(list(pathlib.Path(path.removeprefix("file:")).glob("part-*"))) <= most
    assert got.rdd.getNumPartitions() <= most


def test_tokens(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(8)
    own = ["", " ", "a<|endoftext|>b <|endoftext|>", "\n\n  x\ty ", "naïve Ünïcødé ñandú 漢字 🎉🎉", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 200, "12345 it's we'll  　 end  "]
    own += ["".join(r.choice("abc é'1 \n<|") for _ in range(80)) for _ in range(300)]
    d = docs_of(spark, [(i, t, "s") for i, t in enumerate(own)] + [(9999, None, "s")])
    got = {x.doc_id: (x.n_bytes, x.n_tokens) for x in bpe.token_counts(d, P.path("byte_bpe_50k.json")).collect()}
    want = {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(own)} | {9999: (0, 0)}
    assert got == want
    assert bpe.token_counts(odd, P.path("byte_bpe_50k.json")).count() == odd.count()


def distance(p, w):
    row = [0] * (len(w) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(w):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontam(spark, odd):
    r = random.Random(9)
    items = [(i, prose(r, r.randint(12, 45)).capitalize() + ".") for i in range(30)] + [(100, None), (101, ""), (102, "w1"), (103, "!!")]
    rows, bench = [], spark.createDataFrame(items, "item_id long, text string")
    for i in range(160):
        t = prose(r, r.choice([5, 60, 400]))
        if i % 2:
            p = list(items[r.randrange(30)][1])
            for _ in range(r.randint(0, len(p) // 9)):
                p[r.randrange(len(p))] = r.choice("abcw 0123456789")
            cut = r.randrange(len(t))
            t = t[:cut] + " " + "".join(p).upper() + "\n " + t[cut:]
        rows.append((i, t, "s"))
    got = {(x.doc_id, x.item_id): x.edits for x in decontam.matches(docs_of(spark, rows), bench).collect()}
    want = {}
    for i, t, _ in rows:
        d = decontam.normalize(t)[0]
        for j, x in items[:30]:
            p = decontam.normalize(x)[0]
            if len(set(decontam.grams(p).tolist()) & set(decontam.grams(d).tolist())) > 3:
                e = distance(p, d)
                if e <= decontam.budget(len(p))[0]:
                    want[i, j] = e
        if b" w1 " in b" " + d + b" ":
            want[i, 102] = 0
    assert got == want and sum(e > 0 for e in want.values()) > 10
    left = {x.doc_id for x in decontam.clean(docs_of(spark, rows), bench).collect()}
    assert left == {i for i, _, _ in rows} - {i for i, _ in got}
    assert decontam.clean(odd, bench.limit(30)).collect() == odd.collect()
    assert decontam.matches(odd, bench.limit(0)).count() == 0
    assert np.array_equal(decontam.grams(b"abcdefghij"), [int.from_bytes(b"abcdefghij"[i : i + 8], "little") for i in range(3)])


def test_shuffles_deleted(spark):
    """Files of a query's shuffles go when it ends, and only within."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name, None), files()
    with common.shuffles_deleted(spark):
        rows = common.materialize(spark.range(1000).repartition(3, "id"), "t")
    for _ in range(40):
        if not (left := files() - before):
            break
        time.sleep(0.25)
    assert not left and rows.count() == 1000 and spark.conf.get(name, None) == setting
