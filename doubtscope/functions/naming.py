"""Artifact names as ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def result_name(task, length, model, method, n_responses, split, logits: bool = False) -> Column:
    """``task_length_model_method_nres-N[_logits]_set-split``."""
    mark = "_logits" if logits else ""
    return F.concat(
        task, F.lit("_"), length, F.lit("_"), model, F.lit("_"), method, F.lit("_nres-"),
        n_responses.cast("string"), F.lit(f"{mark}_set-"), split,
    )


def model_tag(path: Column) -> Column:
    """Last path part, then what follows its last ``--``."""
    return F.substring_index(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), "--", -1)


def embedding_tag(model: Column) -> Column:
    """Last path part, then what follows its first ``--``."""
    last = F.element_at(F.split(model, "/"), -1)
    return F.when(last.contains("--"), F.element_at(F.split(last, "--", 2), 2)).otherwise(last)


def embedding_path(root: Column, dataset: Column, split: Column, model: Column) -> Column:
    return F.concat(root, F.lit("/"), dataset, F.lit("_"), embedding_tag(model), F.lit("/"), split, F.lit(".parquet"))


def label_file(label_fn: Column, topk: Column, split: Column, uses_topk: bool = True) -> Column:
    mid = F.concat(F.lit("_topk"), topk.cast("string")) if uses_topk else F.lit("")
    return F.concat(label_fn, mid, F.lit("_"), split, F.lit("_reg"))


def shard_suffix(shard: Column, n_shards: Column) -> Column:
    return F.concat(F.lit("-"), F.lpad(shard.cast("string"), 4, "0"), F.lit("-of-"), F.lpad(n_shards.cast("string"), 4, "0"))


def stem_of(name: Column) -> Column:
    """File name without extension and without a ``-NNNN-of-MMMM`` suffix."""
    return F.regexp_replace(name, r"(-[^-]*-of-[^-]*)?\.parquet$", "")


def size_in_tokens(size: Column) -> Column:
    """``'32k'`` → 32768, else the integer itself."""
    k = F.regexp_extract(size, r"^(\d+)k", 1)
    return F.when(k != "", F.expr("1024L") * k.try_cast("bigint")).otherwise(size.try_cast("bigint"))
