"""Batch scoring as a stream: every micro-batch is a shard, and a replayed batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtscope.session import fresh_path, remove
from doubtscope.sources.shards import write_partitions


def stream_resumable_score(
    stream: DataFrame,
    root: str,
    produce: Callable[[DataFrame], DataFrame],
    result_columns: list[str],
    logit_columns: list[str],
):
    """Start the stream; results, logits and manifest are partitioned by batch number.

    Offsets are in ``{root}/checkpoint``. A batch that is run again after a crash overwrites its own
    partitions, the manifest row last, so nothing is doubled or lost.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = fresh_path(spark, "staged")
        try:
            produce(batch.withColumn("shard_idx", F.lit(int(batch_id)))).write.parquet(staged)
            out = spark.read.parquet(staged)
            write_partitions(out.select("row_id", "shard_idx", *result_columns), f"{root}/results")
            write_partitions(out.select("row_id", "shard_idx", *logit_columns), f"{root}/logits")
            status = out.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("written_rows")).withColumn("completed", F.lit(True))
            write_partitions(status, f"{root}/manifest")
        finally:
            remove(spark, staged)

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
