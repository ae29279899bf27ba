"""Stored tables of the workflow: results, embeddings, labels, metrics, weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtscope.operators.selection import best_seed
from doubtscope.sources.shards import read_if_there

LABEL_KEYS = ("label_fn", "topk", "response_idx", "split", "version")
LABEL_VERSION = "regression_v1"


def write_result_tables(out: DataFrame, root: str, result_columns: list[str], logit_columns: list[str]) -> None:
    """Results and logits side by side, both with the row key. ``out`` should be a stored table."""
    out.select("row_id", *result_columns).write.parquet(f"{root}/results")
    out.select("row_id", *logit_columns).write.parquet(f"{root}/logits")


def write_embeddings(df: DataFrame, path: str) -> None:
    """Store (row_id, prompt, label, embedding) unless it is there whole.

    A table counts as whole if its completion marker gives the number of rows it holds; anything
    else, such as what a crashed write left, is overwritten.
    """
    spark = df.sparkSession
    marker = read_if_there(spark, f"{path}.complete", "n bigint")
    promised = marker.first() if marker is not None else None
    if promised is not None:
        there = read_if_there(spark, path, "row_id bigint")
        if there is not None and there.count() == promised["n"]:
            return
    df.write.mode("overwrite").parquet(path)
    done = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}.complete")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors as ARRAY<FLOAT>; vectors of unequal width are refused."""
    df = read_if_there(spark, path)
    if df is None:
        raise FileNotFoundError(f"no embedding table at {path}")
    width = F.size("embedding")
    span = df.agg(F.min(width).alias("lo"), F.max(width).alias("hi")).first()
    if span["lo"] != span["hi"]:
        raise ValueError(f"embedding widths differ: {span['lo']} to {span['hi']}")
    return df.withColumn("embedding", F.col("embedding").cast("array<float>"))


def stored_labels(
    spark: SparkSession,
    path: str,
    key: dict,
    compute: Callable[[], DataFrame],
) -> DataFrame:
    """(row_id, label) of one label key: read its partition, or compute and add it.

    ``key`` gives label_fn, topk, response_idx, split; the version is part of the key, so labels of
    an older method are never returned.
    """
    key = {**key, "version": LABEL_VERSION}
    match = " and ".join(f"{k} = '{key[k]}'" for k in LABEL_KEYS)
    store = read_if_there(spark, path)
    if store is not None:
        hit = store.filter(match)
        if not hit.isEmpty():
            return hit.select("row_id", "label")
    labelled = compute()
    for k in LABEL_KEYS:
        labelled = labelled.withColumn(k, F.lit(str(key[k])))
    (
        labelled.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*LABEL_KEYS)
        .parquet(path)
    )
    return spark.read.parquet(path).filter(match).select("row_id", "label")


def metrics_record(metrics: DataFrame, **context) -> DataFrame:
    """Metrics without per-sample values, with the settings they belong to."""
    return metrics.drop("per_sample").withColumns({k: F.lit(v) for k, v in context.items()})


def write_metrics(metrics: DataFrame, path: str, **context) -> None:
    metrics_record(metrics, **context).write.mode("overwrite").json(path)


def study_report(seeds: DataFrame, averaged: DataFrame, study: str) -> DataFrame:
    """One nested row: study, per-seed records, averages. Rows are seeds and metrics: a handful."""
    per_seed = seeds.agg(F.sort_array(F.collect_list(F.struct(*seeds.columns))).alias("per_seed"))
    mean = averaged.agg(F.sort_array(F.collect_list(F.struct(*averaged.columns))).alias("averaged"))
    return per_seed.withColumn("averaged", mean.scalar()).select(
        F.lit(study).alias("study"), "per_seed", "averaged"
    )


def register_best(weights: DataFrame, reports: DataFrame, study: str, path: str) -> None:
    """Store all weights of a study and, beside them, the marker naming the best seed."""

    root = f"{path}/study={study}"
    weights.write.mode("overwrite").parquet(f"{root}/weights")
    best_seed(reports).withColumn("weights", F.lit(f"{root}/weights")).write.mode("overwrite").json(f"{root}/best")


def read_best(spark: SparkSession, study: str, path: str) -> DataFrame:
    """Weights of the marked seed."""
    root = f"{path}/study={study}"
    marker = spark.read.schema("seed int, weights string").json(f"{root}/best")
    return spark.read.parquet(f"{root}/weights").join(marker.select("seed"), "seed", "left_semi")
