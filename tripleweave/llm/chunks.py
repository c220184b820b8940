"""Substring dedup by content-defined chunking with a gear rolling hash (operator 3).

A text's bytes are cut where the gear hash of the last 32 bytes has its leading bits all zero, with a least and a largest chunk
length; cuts depend on the bytes near them alone, so an insertion moves the cuts beside it and no others. Chunks get a 64-bit
digest. A digest met in more than one place is a repeat: its first place (the smallest row) stays, the others can go. Adjacent
repeated chunks are joined to runs; a run counts if it has `LEAST` bytes or more. The chunks at a passage's edges are not its own,
and few of 50 words keep less than that between them (the README has figures). A run is reported in parts: those whose chunks have their first place here, and the others.

Digests are grouped with partial aggregation (a smallest row and a count each), so a passage that a third of all documents
share is one row a task; nothing lists a digest's places. The places of repeated digests are found by a join that always
shuffles, but for the most frequent digests (at most 1000, over a thousandth of all chunks each), which are sent to the tasks.

Defined results: null and empty texts have no chunks; the repeats within one text count too; equal rows repeat each other,
and one of them has the first places; a null doc_id takes part; a text of any length is cut whole, its chunks (not its bytes)
being what a row of the chunk table holds; other columns, of whatever name, stay as they were; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, load, map_batches, materialize, numbered, texts

#: Leading bits that are zero at a cut; least and largest chunk in bytes; least run in bytes.
BITS, SHORT, LONG, LEAST = 5, 24, 256, 60
_GEAR = np.random.default_rng(17).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of data, the last being its length."""
    n = len(data)
    if not n:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear[i - j] << j: twice as many terms a round
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends, last = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while c - last > LONG:
            last += LONG
            ends.append(last)
        if c - last >= SHORT:
            ends.append(c)
            last = c
    while n - last > LONG:
        last += LONG
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _digests(data: bytes, ends: list[int]) -> list[int]:
    """64 bits a chunk; a run takes two chunks or a long one, so a few chunks that meet by chance make no run."""
    out, a = [], 0
    for z in ends:
        out.append(int.from_bytes(hashlib.blake2b(data[a:z], digest_size=8).digest(), "little", signed=True))
        a = z
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, digests, ends, heads, row) of every row of docs: of each chunk its digest, its end in bytes, and whether no
    earlier chunk of the text has its digest. row numbers rows in the order of the table's files."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"digests": [], "ends": [], "heads": []}
            for t in texts(batch):
                data = t.encode("utf-8", "surrogatepass")
                e = cuts(data)
                found = _digests(data, e)
                first = dict(zip(reversed(found), range(len(found) - 1, -1, -1)))
                out["ends"].append(e)
                out["digests"].append(found)
                out["heads"].append([first[x] == i for i, x in enumerate(found)])
            return out

        return work

    kinds = (("digests", T.LongType()), ("ends", T.LongType()), ("heads", T.BooleanType()))
    new = [T.StructField(n, T.ArrayType(k)) for n, k in kinds]
    return map_batches(docs.select("doc_id", "text"), start, new, ["doc_id"]).withColumn("row", F.monotonically_increasing_id())


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, start, end, n_chunks, first): the parts of runs, in bytes of the text's UTF-8, of chunks that occur
    elsewhere as well; first: the part's chunks have their first place here, so a dedup keeps it."""
    rows = materialize(chunks(docs), "chunks")
    each = rows.select("row", "ends", F.posexplode(F.arrays_zip("digests", "heads")).alias("at", "c"))
    begin = F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1)).otherwise(0)
    each = each.select(F.col("c.digests").alias("digest"), "row", "at", begin.alias("start"), (F.get("ends", "at") - begin).cast("short").alias("size"), F.col("c.heads").alias("head"))
    many = each.groupBy("digest").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = materialize(many, "repeated")
    total = rows.agg(F.sum(F.size("digests"))).first()[0] or 0
    hits = attach(each, many, ["digest"], "n", total, "merge")
    hits = hits.select("row", "at", "start", "size", (F.col("head") & (F.col("row") == F.col("low"))).alias("own"))
    by_row = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "start", "size", "own"))).alias("hits"))  # of one text

    def runs():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"__rows": [], "start": [], "end": [], "n_chunks": [], "first": []}
            for r, found in enumerate(batch.column("hits").to_pylist()):
                i = 0
                while i < len(found):
                    j = i
                    while j + 1 < len(found) and found[j + 1]["at"] == found[j]["at"] + 1:
                        j += 1
                    if found[j]["start"] + found[j]["size"] - found[i]["start"] >= least:
                        while i <= j:
                            k = i
                            while k + 1 <= j and found[k + 1]["own"] == found[i]["own"]:
                                k += 1
                            end = found[k]["start"] + found[k]["size"]
                            for name, v in (("__rows", r), ("start", found[i]["start"]), ("end", end), ("n_chunks", k - i + 1), ("first", found[i]["own"])):
                                out[name].append(v)
                            i = k + 1
                    i = j + 1
            return out

        return work

    new = [T.StructField(n, T.LongType()) for n in ("start", "end", "n_chunks")] + [T.StructField("first", T.BooleanType())]
    found = map_batches(by_row, runs, new, ["row"])
    return found.join(rows.select("row", "doc_id"), "row").select("doc_id", "row", *[f.name for f in new])


def remove(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with all but the first place of each repeated run cut out of the texts; all other columns as they were."""
    tagged = numbered(docs, "__chunk_row")
    spans = repeats(tagged.select(F.col("__chunk_row").alias("doc_id"), "text"), least).where(~F.col("first"))
    spans = spans.groupBy(F.col("doc_id").alias("__chunk_row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    both = tagged.join(spans, "__chunk_row", "left").drop("__chunk_row")

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
                if t is not None and spans:
                    data, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
                    for s in spans:
                        parts.append(data[at : s["start"]])
                        at = max(at, s["end"])
                    t = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
                out.append(t)
            return {"__text": out}

        return work

    done = map_batches(both, start, [T.StructField("__text", T.StringType())], docs.columns)
    return done.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: documents' runs of repeated chunks. (doc_id, start, end, n_chunks, first)."""
    return repeats(load(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_chunks", "first")
