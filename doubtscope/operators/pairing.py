"""Joins that pair tables by row key.

Results, logits and embeddings come from files in the same order; ``read_sharded`` gives every row
a dense ``row_id``, and pairing is an equi-join on it. Scores are computed *below* the join, so the
shuffle carries one number per row and never the logits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zip_result_logits(results: DataFrame, logits: DataFrame, score: Column, name: str = "unc",
                      key: str = "row_id") -> DataFrame:
    """Result rows with the score of their logits row; null where there is none."""
    scored = logits.select(F.col(key), score.alias(name))
    return results.join(scored, key, "left")


def with_labels_by_row(results: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Replace ``label`` by a given, possibly shorter, list of labels (missing → null)."""
    return results.drop("label").join(labels.select(key, "label"), key, "left")


def attach_embeddings(labelled: DataFrame, embeddings: DataFrame, key: str = "row_id") -> DataFrame:
    """Embedding of each labelled row."""
    return labelled.join(embeddings.select(key, "embedding"), key)


def attach_correct_flags(labelled: DataFrame, flags: DataFrame, key: str = "row_id") -> DataFrame:
    """Correct flag of each labelled row, by key, whatever rows were dropped on the way."""
    return labelled.join(flags.select(key, "ok"), key)


def with_value(df: DataFrame, name: str) -> DataFrame:
    """Rows whose ``name`` is not null, for a column that is costly to compute.

    Exploding none or one value drops the others; a filter would be pushed below the projection and the
    shuffles before it, and compute the column a second time there.
    """
    present = F.filter(F.array(name), lambda x: x.isNotNull())
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(present).alias(name)).select(*df.columns)


def with_scalars(df: DataFrame, one_row: DataFrame, names: list[str]) -> DataFrame:
    """Add columns of a one-row table as constants (a scalar subquery, no join)."""
    packed = one_row.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("__s", packed).select(*df.columns, *[F.col(f"__s.{n}").alias(n) for n in names])
