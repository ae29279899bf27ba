"""Five stages from raw documents to placed training data; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doubtscope.llm.decontam import keep_clean
from doubtscope.llm.language import keep_identified
from doubtscope.llm.mixing import SHARE, keep_mixture
from doubtscope.llm.sharding import assign_shards
from doubtscope.llm.simhash import keep_one
from doubtscope.session import stored

SHARDS = [f"shard-{k:02d}" for k in range(32)]
SLOTS = 1021


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; null ids come last."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet the source, language and topic targets."""
    return keep_mixture(docs, share=SHARE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard."""
    return assign_shards(docs, SHARDS, SLOTS)


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Compression, fingerprints and BM25 search cannot be said in SQL; tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline-stage")
    return docs
