"""Resumable writes in shards of a fixed number of rows.

A manifest table says which shards are whole. A run processes the other shards only, some at a time,
replaces their partitions, checks the row counts of what was written and then appends to the
manifest, so a run that dies anywhere can simply be started again and keeps what was finished.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from doubtscope.session import fresh_path, remove

ROWS_PER_SHARD_DEFAULT = 10_000
MANIFEST = (
    "shard_idx int, n_shards int, start bigint, end bigint, expected_rows bigint, "
    "written_rows_results bigint, written_rows_logits bigint, completed boolean"
)
#: Write options of tables of nested logits. A row can hold a hundred thousand entries, and a reader decodes up to 4096
#: rows of a row group at once, so groups are short and checked every few rows.
NESTED = {"parquet.block.row.count.limit": "64", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "8"}
PLAN = "n_total bigint, n_shards int, n_per_shard bigint"
RECORD = "inference_time double, num_samples bigint, n_shards int"


def shard_plan(spark: SparkSession, n_total: int, n_per_shard: int) -> DataFrame:
    """(shard_idx, n_shards, start, end, expected_rows); the last shard may be shorter."""
    n_shards = -(-n_total // n_per_shard)
    return spark.range(n_shards).select(
        F.col("id").cast("int").alias("shard_idx"),
        F.lit(n_shards).alias("n_shards"),
        (F.col("id") * n_per_shard).alias("start"),
        F.least((F.col("id") + 1) * n_per_shard, F.lit(n_total)).alias("end"),
        (F.least((F.col("id") + 1) * n_per_shard, F.lit(n_total)) - F.col("id") * n_per_shard).alias("expected_rows"),
    )


def with_shard(df: DataFrame, n_per_shard: int, row_id: str = "row_id") -> DataFrame:
    return df.withColumn("shard_idx", F.expr(f"{row_id} div {n_per_shard}").cast("int"))


def shard_row_counts(df: DataFrame, plan: DataFrame) -> DataFrame:
    """(shard_idx, expected_rows, n_rows) for every shard of the plan."""
    counts = df.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n_rows"))
    return plan.join(counts, "shard_idx", "left").select(
        "shard_idx", "expected_rows", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def pending_shards(plan: DataFrame, complete: DataFrame) -> DataFrame:
    """Shards of the plan that are not complete."""
    return plan.join(complete.select("shard_idx"), "shard_idx", "left_anti")


def complete_shards(manifest: DataFrame, results: DataFrame | None, logits: DataFrame | None) -> DataFrame:
    """Shards that the manifest calls completed and whose tables hold the expected rows."""
    done = manifest.filter("completed").select("shard_idx", "expected_rows").distinct()
    for table in (results, logits):
        if table is None:
            return done.limit(0)
        counts = table.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("__n"))
        done = done.join(counts, "shard_idx").filter(F.col("__n") == F.col("expected_rows")).drop("__n")
    return done


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _check_plan(spark: SparkSession, root: str, n_total: int, n_shards: int, n_per_shard: int) -> None:
    found = read_if_there(spark, f"{root}/plan", PLAN)
    row = found.first() if found is not None else None
    if row is None:
        spark.createDataFrame([(n_total, n_shards, n_per_shard)], PLAN).write.mode("overwrite").parquet(f"{root}/plan")
    elif row["n_per_shard"] != n_per_shard:
        raise ValueError(f"rows per shard changed between runs ({row['n_per_shard']} to {n_per_shard})")
    elif row["n_total"] != n_total or row["n_shards"] != n_shards:
        raise ValueError("the number of rows or shards changed since the first run")


def write_partitions(df: DataFrame, path: str, key: str = "shard_idx", options: dict[str, str] | None = None) -> None:
    """Replace the partitions of ``key`` that occur in df and leave the others alone; no row moves."""
    (
        df.sortWithinPartitions(key, *(["row_id"] if "row_id" in df.columns else []))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(options or {}))
        .partitionBy(key)
        .parquet(path)
    )


def run_record(spark: SparkSession, root: str):
    """(inference_time in seconds, num_samples, n_shards) of a finished run, or None."""
    try:
        return spark.read.schema(RECORD).json(f"{root}/running_info").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _run_wave(samples, shards, root, produce, result_columns, logit_columns, n_per_shard, chunk_rows) -> None:
    """Predict, write and record some shards; whole ones are recorded even if others are not."""
    spark = samples.sparkSession
    low, high = min(shards) * n_per_shard, (max(shards) + 1) * n_per_shard
    rows = with_shard(samples.filter((F.col("row_id") >= low) & (F.col("row_id") < high)), n_per_shard)
    chunks = len(shards) * -(-n_per_shard // chunk_rows)
    # prompts, not logits, are dealt to the tasks: a task's output then holds whole chunks of shards
    dealt = rows.filter(F.col("shard_idx").isin(shards)).repartition(chunks, "shard_idx", F.expr(f"row_id div {chunk_rows}"))
    # a predictor may be random and is dear: its output is stored once, both tables come from it
    staged = fresh_path(spark, "staged")
    try:
        produce(dealt).write.options(**NESTED).parquet(staged)
        out = spark.read.parquet(staged)
        # rows are counted as they are written: no table is read again
        written = {}
        for table, columns in (("results", result_columns), ("logits", logit_columns)):
            seen = Observation(f"{table}-{min(shards)}")
            rows = out.select("row_id", "shard_idx", *columns)
            counts = [F.count_if(F.col("shard_idx") == s).alias(f"shard_{s}") for s in shards]
            write_partitions(rows.observe(seen, *counts), f"{root}/{table}", options=NESTED if table == "logits" else None)
            written[table] = {s: seen.get[f"shard_{s}"] for s in shards}
    finally:
        remove(spark, staged)
    n_total = spark.read.schema(PLAN).parquet(f"{root}/plan").first()["n_total"]
    listed = [(s, *(written[t][s] or None for t in ("results", "logits"))) for s in shards]
    counted = spark.createDataFrame(listed, "shard_idx int, written_rows_results bigint, written_rows_logits bigint")
    status = shard_plan(spark, n_total, n_per_shard).join(counted, "shard_idx")
    whole = (F.col("written_rows_results") == F.col("expected_rows")) & (F.col("written_rows_logits") == F.col("expected_rows"))
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    told = status.withColumn("completed", F.coalesce(whole, F.lit(False))).select(*columns).coalesce(1).collect()
    good = [r for r in told if r["completed"]]
    if good:
        spark.createDataFrame(good, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    bad = sorted(r["shard_idx"] for r in told if not r["completed"])
    if bad:
        raise RuntimeError(f"shards {bad[:20]} were not written whole")


def resumable_sharded_write(
    samples: DataFrame,
    root: str,
    produce: Callable[[DataFrame], DataFrame],
    result_columns: list[str],
    logit_columns: list[str],
    n_per_shard: int = ROWS_PER_SHARD_DEFAULT,
    shards_per_wave: int = 8,
    chunk_rows: int = 1000,
    skip_if_recorded: bool = False,
) -> DataFrame:
    """Run ``produce`` on the rows of pending shards and store results and logits by shard.

    ``samples`` has a dense ``row_id``; ``produce`` keeps it and ``shard_idx`` and gives one row per
    sample (responses as columns), without moving rows. Pending shards are done in waves of
    ``shards_per_wave``; each wave is predicted, written, counted and added to the manifest before
    the next. If a wave fails, its unfinished shards are tried one by one, so that only bad shards
    stay open; the first error is raised when all others are done. Returns the manifest.

    A run that leaves all shards whole stores a record of its time, samples and shards. With ``skip_if_recorded``
    a job that has one is not looked at again; else its tables are counted once more.
    """
    spark = samples.sparkSession
    began = time.time()
    if skip_if_recorded and run_record(spark, root) is not None:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    n_total = samples.count()
    n_shards = -(-n_total // n_per_shard)
    _check_plan(spark, root, n_total, n_shards, n_per_shard)
    plan = shard_plan(spark, n_total, n_per_shard)

    def pending() -> list[int]:
        manifest = read_if_there(spark, f"{root}/manifest", MANIFEST)
        if manifest is None:
            manifest = spark.createDataFrame([], MANIFEST)
        tables = [read_if_there(spark, f"{root}/{t}", "row_id bigint, shard_idx int") for t in ("results", "logits")]
        done = complete_shards(manifest, *tables)
        return sorted(r["shard_idx"] for r in pending_shards(plan, done).select("shard_idx").collect())

    errors: list[Exception] = []

    def attempt(shards: list[int]) -> None:
        try:
            _run_wave(samples, shards, root, produce, result_columns, logit_columns, n_per_shard, chunk_rows)
        except Exception as e:  # noqa: BLE001  kept and raised when the other shards are done
            if len(shards) == 1:
                errors.append(e)
                return
            still = set(pending())
            for shard in (s for s in shards if s in still):
                attempt([shard])

    todo = pending()
    for at in range(0, len(todo), shards_per_wave):
        attempt(todo[at : at + shards_per_wave])
    if errors:
        raise errors[0]
    record = spark.createDataFrame([(time.time() - began, n_total, n_shards)], RECORD)
    record.coalesce(1).write.mode("overwrite").json(f"{root}/running_info")
    found = read_if_there(spark, f"{root}/manifest", MANIFEST)
    return found if found is not None else spark.createDataFrame([], MANIFEST)
