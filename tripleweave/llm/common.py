"""What the training-data operators share: materialising, size-checked joins, connected components, ranks."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of all word-based operators: runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many bytes and rows; beyond, the join shuffles.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 1_000_000
#: Rows of an Arrow batch; texts can be long.
BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary folder only where that is unset and all
    executors are threads of this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


_WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, and a lost executor costs nothing done before."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete what materialize() has written in this process; results that still read it must have been written before."""
    while _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def merged(df: DataFrame, a_core: int = 4) -> DataFrame:
    """df in so many partitions a core at most, without a shuffle, for rows that cost little each: for every file that a task
    writes, Hadoop's local file system starts chmod twice, and each time the JVM's memory counts double until that has started."""
    return df.coalesce(a_core * df.sparkSession.sparkContext.defaultParallelism)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, written down: a plan that is run twice could number rows differently."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if its rows and bytes are within the limits; else as it is, so that the join shuffles. They
    are counted here, so df should be materialised; rows: of a table that the driver made, with short strings at most."""
    if rows is not None:
        return F.broadcast(df) if rows * 32 * len(df.columns) <= BROADCAST_BYTES else df
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema.fields):
        return df
    size = functools.reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide], F.lit(16 * len(df.columns)))
    n, size = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def bit_map(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """2^bits bits (2^15 at least), of which those that the leading bits of a long column's values name are set."""
    out = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
    at = F.shiftrightunsigned(column, 64 - bits) + 1  # bitmap buckets count from 1
    found = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    for r in found.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def in_map(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each key (unsigned) is set: false only for keys that bit_map() hasn't met."""
    bit = keys >> np.uint64(64 - bits)
    return ((bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to
    collect its garbage."""
    for _ in range(2):  # what the first round lets go of is deleted behind the scenes, and may hold more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark (4.1 on; others ignore the setting) deletes a query's shuffle files as soon as it has ended, on all executors.
    Only for DataFrames that run once, as by materialize()."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release() -> None:
    """Give memory that this process no longer uses back to the machine: Python workers live on after a task, and what their
    allocators keep adds up with the next task's memory. Elsewhere than on glibc only Arrow's share is given back."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(
    df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], dict]], new: list[T.StructField], keep: list[str] | None = None
) -> DataFrame:
    """Columns `keep` of df (default: all) plus `new`, made batch by batch: fn() is called once a task and gives a function
    from a batch to a dict of equally long lists or arrays. An optional entry "__rows" (indices) repeats or filters rows."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + new)
    kinds = to_arrow_schema(T.StructType(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            out = work(batch)
            rows = out.pop("__rows", None)
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if rows is not None:
                old = [c.take(pa.array(rows, pa.int64())) for c in old]
            fresh = [pa.array(out[f.name], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*old, *fresh], names=[*keep, *kinds.names])
        del work
        release()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def fold(column: str | Column = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts. A null id has no remainder; it counts as remainder 2 (a training row)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(2))


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a, b): the smallest node that can be reached.

    Alternating large-star and small-star rounds; every round is written to the shared folder and ends when the edges no
    longer change. A node of high degree is met by a partial aggregation and by a join that AQE can split, never by a
    window or a collected list. Loops and repeated edges don't matter; no edges give no rows; edges that still change after max_rounds are an error."""
    u, v = F.col("u"), F.col("v")
    e = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )
    before = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        e = materialize(
            star.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(),
            tag,
        )
    else:
        raise RuntimeError(f"components: edges still change after {max_rounds} rounds")
    return e.select(u.alias("node"), v.alias("component")).unionByName(
        e.select(v.alias("node"), v.alias("component")).distinct()
    )


def ranked(df: DataFrame, group: list[str], salt: Column, order: list[str], name: str, salts: int) -> DataFrame:
    """df with `name`: a gapless rank from 0 within group, whatever the group's size: rows are numbered within (group,
    salt), and each salt starts where the salts below it end. Ties in order are numbered in any order."""
    from pyspark.sql import Window as W

    d = df.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    count = d.groupBy(*group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    start = count.select(*group, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy(*group, "__salt").orderBy(*order))
    return (
        d.withColumn("__own", own).join(start, [*group, "__salt"]).withColumn(name, F.col("__start") + F.col("__own") - 1)
        .drop("__salt", "__own", "__start")
    )


def attach(df: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int, hint: str | None = None) -> DataFrame:
    """Inner join of df with table, unique by keys; table.copies counts df's rows of a key. Keys that hold over a
    thousandth of all rows (at most 1000 of them) are broadcast, so that no hot key is shuffled; the rest shuffles (hint
    "merge": whatever its size, so that the work grows in proportion to the input)."""
    least = max(1000, total // 1000)
    hot, cold = F.broadcast(table.where(F.col(copies) >= least)), table.where(F.col(copies) < least)
    rest = df.join(hot.select(*keys), keys, "left_anti").join(cold.hint(hint) if hint else cold, keys)
    return rest.unionByName(df.join(hot, keys).select(*rest.columns))
