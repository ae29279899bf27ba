"""Training labels: registry of label functions, normalisation, training sets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.functions.tokens import HEAP_DEFAULT, seq_token_scores, topm_mean
from doubtscope.operators.pairing import attach_embeddings, with_scalars, with_value

MIN_SPAN = 1e-8


@dataclass(frozen=True)
class LabelFunction:
    """A label as a Column over the result row and, if ``needs_logits``, its ``logits`` column."""

    build: Callable[..., Column]
    needs_logits: bool = False
    uses_topk: bool = False
    is_regression: bool = False


LABEL_FUNCTIONS: dict[str, LabelFunction] = {}


def register_label(name: str, **traits):
    def add(build):
        LABEL_FUNCTIONS[name] = LabelFunction(build, **traits)
        return build

    return add


@register_label("topm_norm", needs_logits=True, uses_topk=True, is_regression=True)
def topm_norm(topk_worst: int = HEAP_DEFAULT, logits: str = "logits", **_) -> Column:
    """Mean of the highest token norms of the whole answer."""
    return topm_mean(seq_token_scores(F.col(logits)), topk_worst)


def drop_unlabelled(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.filter(F.col(label).isNotNull())


def compute_labels(results: DataFrame, logits: DataFrame | None, name: str, key: str = "row_id", **kwargs) -> DataFrame:
    """(row_id, label FLOAT) of the rows that have a label. Logits are read only if needed."""
    fn = LABEL_FUNCTIONS[name]
    if fn.needs_logits and logits is None:
        raise ValueError(f"label function {name!r} needs a logits table")
    source = logits if fn.needs_logits else results
    labelled = with_value(source.select(key, fn.build(**kwargs).cast("float").alias("label")), "label")
    return results.select(key).join(labelled, key) if fn.needs_logits else labelled


def label_range(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))


def minmax_normalise(labels: DataFrame, train_range: DataFrame, label: str = "label", out: str = "y") -> DataFrame:
    """clip((x - lo) / max(hi - lo, 1e-8), 0, 1) with the *training* range, as FLOAT."""
    wide = with_scalars(labels, train_range, ["lo", "hi"])
    x, lo, hi = (F.col(c).cast("double") for c in (label, "lo", "hi"))
    scaled = (x - lo) / F.greatest(hi - lo, F.lit(MIN_SPAN))
    return wide.withColumn(out, F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)).cast("float")).drop("lo", "hi")


def build_train_set(labels: DataFrame, embeddings: DataFrame, split: str = "split") -> DataFrame:
    """Labels of all splits + embeddings → (row_id, split, y, embedding)."""
    span = label_range(labels.filter(F.col(split) == "train"))
    normalised = minmax_normalise(drop_unlabelled(labels), span)
    return attach_embeddings(normalised, embeddings).select("row_id", split, "y", "embedding")
