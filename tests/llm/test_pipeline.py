"""The stages of corpus_pipeline.py, one after the other, each against a plain recomputation from its own input."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tripleweave.llm import decontam, jaccard, toxicity

jaccard.CELL_BITS, jaccard.SLICES = 14, 8
WORDS = [f"{a}{b}{c}" for a in ("bra", "do", "fli", "gu", "ke", "lo") for b in "aeiou" for c in ("", "n", "rta", "mo", "sk", "ve")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path, rows, labels = random.Random(21), str(tmp_path_factory.mktemp("tables")), [], []
    items = [(i, prose(r, 20)) for i in range(5)]
    for i in range(260):
        w = prose(r, r.choice([8, 40, 90])).split()
        for _ in range(5 if i % 5 == 0 else 0):
            w.insert(r.randrange(len(w)), r.choice(["vile", "scumbag", "zzwret"]))
        if i % 40 == 7:
            w[3:3] = items[i % 5][1].split()
        rows.append((i, " ".join(w), r.choice(["a", "a", "b", None])))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [t for i, t, _ in rows if i % 5 and len(t.split()) > 30]
    rows += [(300 + i, t + " more", "b") for i, t in enumerate(clean[:12])] + [(400 + i, clean[20], "a") for i in range(15)]
    rows += [(500, None, "a"), (501, "", None), (None, prose(r, 30), "b"), (502, prose(r, 9000), "a")]
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.withColumn("row", F.lit(1)).withColumn("hash", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_stages(spark, folder):
    docs = pipeline.load(spark, folder, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        out = pipeline.materialize(stage(spark, docs, folder), f"test-{name}")
        seen[name] = (docs.collect(), out.collect())
        if name != "sharding":
            assert out.columns == columns
            assert stage(spark, docs.limit(0), folder).count() == 0
        docs = out
    before, after = seen["toxicity"]
    model = toxicity.train(toxicity.sample(pipeline.load(spark, folder, "documents"), pipeline.load(spark, folder, "labels")))
    assert sorted(map(str, after)) == sorted(str(x) for x in before if model.score(x.text or "") < 0.5)
    bad = [x for x in before if x.doc_id is not None and x.doc_id < 260 and x.doc_id % 5 == 0]
    assert sum(x in after for x in bad) < 0.1 * len(bad) and len(after) > 0.95 * (len(before) - len(bad))

    before, after = seen["near_copies"]
    sets, parent = [shingles(x.text) for x in before], list(range(len(before)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(before)):
        groups[root(i)].append(before[i])
    assert len(after) == len(groups) and sum(len(g) > 1 for g in groups.values()) >= 10
    assert all(sum(x in after for x in {str(y): y for y in g}.values()) == 1 for g in groups.values() if len(g) > 1)

    before, after = seen["decontamination"]
    items = [decontam.normalize(x.text)[0] for x in pipeline.load(spark, folder, "benchmark").collect()]
    hit = [x for x in before if any(i in decontam.normalize(x.text or "")[0] for i in items)]
    assert len(hit) >= 5 and sorted(map(str, after)) == sorted(str(x) for x in before if x not in hit)

    before, after = seen["mixing"]
    size = lambda x: len((x.text or "").split())
    many = defaultdict(int)
    for x in after:
        many[str(x)] += 1
    assert all(0 <= many[str(x)] <= 2 for x in before) and sum(many.values()) == len(after) and set(many) <= {str(x) for x in before}
    whole = sum(map(size, before))
    assert abs(sum(map(size, after)) - 1.5 * whole) <= 4 * 9000

    before, after = seen["sharding"]
    assert sorted((x.doc_id or -1) for x in after) == sorted((x.doc_id or -1) for x in before)
    assert sum(x.size for x in after) == sum(len((x.text or "").encode()) + 1 for x in before)
    for s in range(8):
        slots = sorted(x.slot for x in after if x.shard == s)
        assert slots == list(range(len(slots))) and slots
