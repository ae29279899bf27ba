"""Reading row-ordered tables that may be cut into ``{stem}-NNNN-of-MMMM.parquet`` shards.

Every row of these tables has an identity: ``shard_idx``, and ``row_id`` over all shards. Tables that
store them keep them, whatever files they lie in. For tables that do not, order is the identity:
shards in the order of their numbers, the files of a shard in the order of their part numbers, rows
as they stand; it is derived from file metadata, without a window and without a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARD = re.compile(r"-(\d+)-of-\d+\.parquet|/shard_idx=(\d+)/")
_PART = re.compile(r"/part-(\d+)-[^/]*$")
_GLOB = "-[0-9]*-of-[0-9]*.parquet"
LOGITS_TYPE = "array<array<struct<token_id:bigint,token:string,logit:double,rank:int>>>"


def _existing(spark: SparkSession, pattern: str) -> list[str]:
    try:
        # a fixed schema: list only, read no footer. Listed URIs are escaped, readers want plain paths
        return [unquote(f) for f in spark.read.schema("x int").parquet(pattern).inputFiles()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def _order(file: str) -> tuple:
    shard, part = _SHARD.search(file), _PART.search(file)
    return (int(shard[1] or shard[2]) if shard else -1, int(part[1]) if part else -1, file)


def list_table_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a file, a directory or a stem with shards, in numeric shard and part order.
    Partial files of interrupted writers are left out."""
    stem = re.sub(r"\.parquet$", "", path.rstrip("/"))
    for pattern in (path, f"{stem}.parquet", f"{stem}{_GLOB}"):
        files = [f for f in _existing(spark, pattern) if ".partial." not in f]
        if files:
            return sorted(files, key=_order)
    raise FileNotFoundError(f"no table and no shards at {path}")


def union_relaxed(tables: list[DataFrame]) -> DataFrame:
    """Union by name: missing columns are null, types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _scans(spark: SparkSession, path: str, files: list[str]) -> list[DataFrame]:
    """One scan of all files if their columns merge, else one per distinct layout of a shard."""
    root = path if any("/shard_idx=" in f for f in files) else None
    reader = spark.read.option("mergeSchema", "true")
    reader = reader.option("basePath", root) if root else reader
    try:
        return [reader.parquet(*files)]
    except AnalysisException as e:
        if "CANNOT_MERGE" not in str(e):
            raise
    except Exception as e:  # noqa: BLE001  footers are merged inside a job, whose error comes wrapped
        if "CANNOT_MERGE" not in str(e):
            raise
    shards: dict[int, list[str]] = {}
    for f in files:
        shards.setdefault(_order(f)[0], []).append(f)
    layouts: dict[str, list[str]] = {}
    for own in shards.values():
        layouts.setdefault(reader.parquet(*own).schema.json(), []).extend(own)
    return [reader.parquet(*own) for own in layouts.values()]


def _derived(tables: list[DataFrame], files: list[str]) -> DataFrame:
    """Rows with shard_idx, row_index and row_id from the files' order and row counts."""
    spark = tables[0].sparkSession
    per_shard: dict[int, list[str]] = {}
    for f in files:
        per_shard.setdefault(_order(f)[0], []).append(f)
    for shard, own in per_shard.items():
        if len(own) > 1 and len({_order(f)[1] for f in own}) < len(own):
            raise ValueError(f"shard {shard} has several files in no known order and no row_id: {sorted(own)[:3]}")
    located = [t.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")) for t in tables]
    counts = union_relaxed([t.groupBy("__file").count() for t in located]).collect()  # no column is read
    placed, before, within = [], 0, {}
    for name, n in sorted(((r["__file"], r["count"]) for r in counts), key=lambda r: _order(unquote(r[0]))):
        shard = _order(unquote(name))[0]
        number = shard if shard >= 0 else (0 if len(per_shard) == 1 else len(placed))
        placed.append((name, number, within.get(number, 0), before))
        before += n
        within[number] = within.get(number, 0) + n
    offsets = spark.createDataFrame(placed, "__file string, shard_idx int, __in_shard bigint, __offset bigint")
    # one short row per file, as many as the driver listed: sent to every task, so no row of the table moves
    whole = union_relaxed(located).join(F.broadcast(offsets), "__file", "left")
    known = F.when(F.col("shard_idx").isNull(), F.raise_error(F.concat(F.lit("file changed while it was read: "), "__file")).cast("int"))
    return whole.withColumn("shard_idx", known.otherwise(F.col("shard_idx"))).withColumns(
        {"row_index": F.col("__in_shard") + F.col("__at"), "row_id": F.col("__offset") + F.col("__at")}
    )


def read_sharded(spark: SparkSession, path: str, columns: list[str] | dict[str, str] | None = None) -> DataFrame:
    """All shards as one table with ``shard_idx``, ``row_index`` (within the shard) and ``row_id``.

    A stored ``row_id`` (and ``shard_idx``) is kept; then ``row_index`` is left out, as it is not
    needed to pair rows. Named ``columns`` reach the scan; those no shard has are null, of the type
    given for them (``{name: type}``) or string.
    """
    files = list_table_files(spark, path)
    tables = _scans(spark, path, files)
    if all("row_id" in t.columns for t in tables):
        keys = ["shard_idx", "row_id"]
        whole = union_relaxed(tables)
        if "shard_idx" not in whole.columns:
            whole = whole.withColumn("shard_idx", F.lit(0))
        whole = whole.withColumn("row_id", F.col("row_id").cast("bigint"))
    else:
        keys = ["shard_idx", "row_index", "row_id"]
        whole = _derived([t.drop("shard_idx", "row_index", "row_id") for t in tables], files)
    data = [c for c in whole.columns if c not in keys and not c.startswith("__")]
    if columns is not None:
        types = columns if isinstance(columns, dict) else dict.fromkeys(columns, "string")
        whole = whole.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in data})
        data = list(types)
    return whole.select(*data, *keys)


def scan_topk_column(spark: SparkSession, path: str, response_idx: int = 0) -> DataFrame:
    """Only one response's logits (as ``logits``) and the row key; null where there is no such response."""
    name = f"gen_topk_logits_{response_idx}"
    return read_sharded(spark, path, {name: LOGITS_TYPE}).withColumnRenamed(name, "logits")


def no_logits(spark: SparkSession) -> DataFrame:
    """What ``scan_topk_column`` gives for a table that does not exist."""
    return spark.createDataFrame([], f"row_id bigint, logits {LOGITS_TYPE}")


def distinct_stems(artifacts: DataFrame, stem: str = "stem", order: str = "ord") -> DataFrame:
    """Each stem once, with its first position."""
    return artifacts.groupBy(stem).agg(F.min(order).alias(order))


def find_artifacts(spark: SparkSession, root: str, task: str, split: str, length: str = "*", method: str = "*", n_responses: str = "*") -> list[str]:
    """Stems of the result tables of a split over all models: whole files first, then sharded ones.

    Logits tables are left out. One listing of the task's folder.
    """
    pattern = f"{root}/{task}/{task}_{length}_*_{method}_nres-{n_responses}_set-{split}"
    stems: list[str] = []
    for glob in (f"{pattern}.parquet", f"{pattern}{_GLOB}"):
        at = spark._jvm.org.apache.hadoop.fs.Path(glob)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
        for name in sorted(f.getPath().toString() for f in found):
            stem = re.sub(r"(-\d+-of-\d+)?\.parquet$", "", name)
            if "_logits" not in name.rsplit("/", 1)[-1] and ".partial" not in name and stem not in stems:
                stems.append(stem)
    return stems


def first_readable(spark: SparkSession, stems: list[str]) -> DataFrame | None:
    """The first of a few candidate tables that loads, or None. Any failure to open one is passed over."""
    for stem in stems:
        try:
            return read_sharded(spark, stem)
        except Exception:  # noqa: BLE001  a candidate may be missing, corrupt or of another kind
            continue
    return None
