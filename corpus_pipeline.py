"""A training-data pipeline of five stages; each reads what the one before has written.

Every stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame: the columns of documents, and from the
last stage the shard of each row. What a stage does with odd rows: toxicity keeps null and empty texts and judges equal rows
alike; near copies keeps all null and empty texts and one of equal rows; decontamination keeps null and empty texts; mixing
takes texts without words as often as the source's threshold says; sharding puts null and empty texts into one group. Ties,
very long texts, an empty table and further columns are no special case in any: see the operators. The mix repeats rows: a document that it takes twice is two equal rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleweave.llm import decontam, jaccard, mixing, sharding, toxicity
from tripleweave.llm.common import load, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from labelled rows of the table `documents`."""
    model = toxicity.train(toxicity.sample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.take(docs)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    return sharding.query(spark, sf_dir, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]

#: SQL can't express the trained model, the banded alignment or the hashes; tests/llm/test_pipeline.py compares each stage with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
