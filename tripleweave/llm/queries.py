"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import attention, bpe, chunks, decontam, jaccard, mixing, pivots, quality, sharding, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_toxicity": toxicity.query,
    "op2_score_attention": attention.query,
    "op3_dedup_substrings": chunks.query,
    "op4_mix_sources": mixing.query,
    "op5_kneser_ney_quality": quality.query,
    "op6_decontaminate": decontam.query,
    "op7_count_tokens": bpe.query,
    "op8_pivot_near_dedup": pivots.query,
    "op9_shard": sharding.query,
    "op10_jaccard_join": jaccard.query,
}

#: SQL can't say what a run of any of these gives but for hashes and models of their own; tests compare with brute force.
SQL: dict[str, str] = {}
