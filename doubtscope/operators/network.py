"""The two-layer scorer: weights, scoring, gradients. NumPy inside tasks, Spark around them.

The network is ``w2 · silu(W1 x + b1) + b2`` with D inputs and D // 4 hidden units, and no sigmoid.
Weights are one flat vector of D*H + 2H + 1 doubles, ordered W1 (row-major), b1, w2, b2; its size
depends on the embedding width only, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

PAIR_GAP = 1e-6
LOSSES = ("mse", "rank", "hybrid")
CLIP_NORM = 1.0
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8


def hidden_size(dim: int) -> int:
    return dim // 4


def weight_count(dim: int) -> int:
    h = hidden_size(dim)
    return dim * h + 2 * h + 1


def init_weights(dim: int, seed: int) -> np.ndarray:
    """He-normal weights (deviation sqrt(2 / fan-in)), zero biases."""
    h, rng = hidden_size(dim), np.random.default_rng(seed)
    w1 = rng.normal(0.0, np.sqrt(2.0 / dim), h * dim)
    w2 = rng.normal(0.0, np.sqrt(2.0 / h), h)
    return np.concatenate([w1, np.zeros(h), w2, np.zeros(1)])


def unpack(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    h = hidden_size(dim)
    cut = dim * h
    return flat[:cut].reshape(h, dim), flat[cut : cut + h], flat[cut + h : cut + 2 * h], flat[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def predict(flat: np.ndarray, x: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Scores of rows; ``keep`` is the scaled dropout mask over hidden units, in training."""
    w1, b1, w2, b2 = unpack(flat, x.shape[1])
    z = x @ w1.T + b1
    hidden = z * sigmoid(z)
    return (hidden if keep is None else hidden * keep) @ w2 + b2


def pair_loss(pred: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Sum of softplus(-sign(yi - yj)(pi - pj)) over ordered pairs with |yi - yj| > 1e-6,
    its gradient in pred, and the number of pairs."""
    dy = target[:, None] - target[None, :]
    pairs = np.abs(dy) > PAIR_GAP
    count = int(pairs.sum())
    sign = np.sign(dy)
    margin = -sign * (pred[:, None] - pred[None, :])
    soft = np.maximum(margin, 0.0) + np.log1p(np.exp(-np.abs(margin)))
    pull = np.where(pairs, -sign * sigmoid(margin), 0.0)
    return float(soft[pairs].sum()), pull.sum(axis=1) - pull.sum(axis=0), count


def loss_and_slope(kind: str, lam: float, pred: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a batch and its gradient in the predictions."""
    loss, slope = 0.0, np.zeros_like(pred)
    if kind in ("mse", "hybrid"):
        off = pred - target
        loss, slope = float(np.mean(off * off)), 2.0 * off / len(pred)
    if kind in ("rank", "hybrid"):
        scale = 1.0 if kind == "rank" else lam
        total, pull, count = pair_loss(pred, target)
        if count:
            loss, slope = loss + scale * total / count, slope + scale * pull / count
    return loss, slope


def backprop(flat: np.ndarray, x: np.ndarray, slope_of, keep: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(loss, gradient) where ``slope_of(pred)`` gives the loss and its gradient in pred.
    ``keep`` is the scaled dropout mask over hidden units."""
    w1, b1, w2, b2 = unpack(flat, x.shape[1])
    z = x @ w1.T + b1
    s = sigmoid(z)
    hidden = z * s if keep is None else z * s * keep
    loss, slope = slope_of(hidden @ w2 + b2)
    back = slope[:, None] * w2[None, :] * (s * (1.0 + z * (1.0 - s)))
    if keep is not None:
        back = back * keep
    grad = np.concatenate([(back.T @ x).ravel(), back.sum(axis=0), hidden.T @ slope, [slope.sum()]])
    return loss, grad


@dataclass
class Adam:
    """Decoupled-decay Adam state of one run."""

    m: np.ndarray
    v: np.ndarray
    steps: int = 0

    def update(self, flat: np.ndarray, grad: np.ndarray, rate: float, decay: float) -> np.ndarray:
        norm = float(np.linalg.norm(grad))
        if norm > CLIP_NORM:
            grad = grad * (CLIP_NORM / (norm + 1e-6))
        self.steps += 1
        self.m = BETA1 * self.m + (1 - BETA1) * grad
        self.v = BETA2 * self.v + (1 - BETA2) * grad * grad
        m_hat = self.m / (1 - BETA1**self.steps)
        v_hat = self.v / (1 - BETA2**self.steps)
        return flat * (1 - rate * decay) - rate * m_hat / (np.sqrt(v_hat) + ADAM_EPS)


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Arrow list column of equal-length vectors → n x D doubles, without per-row objects."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def mlp_score(df: DataFrame, weights: dict[int, np.ndarray], vec: str = "embedding",
              keep: list[str] | None = None, out: str = "unc") -> DataFrame:
    """Score every row with every run's weights → (keep…, run_id, out).

    The weights are a broadcast variable of runs x weight_count(D) doubles.
    """
    keep = keep or ["row_id"]
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(vec))
            if not len(x):
                continue
            for run, flat in shared.value.items():
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in keep]
                    + [pa.array(np.full(len(x), run, dtype=np.int32)), pa.array(predict(flat, x))],
                    names=[*keep, "run_id", out],
                )

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + f", run_id int, {out} double"
    return df.select(*keep, vec).mapInArrow(score, schema)


def grad_partial(df: DataFrame, flat: np.ndarray, vec: str = "embedding", y: str = "y") -> DataFrame:
    """Summed squared-error gradient at fixed weights → one row (n, loss, gradient).

    Each task returns one vector; they are added with a tree-shaped partial aggregate.
    """
    shared = df.sparkSession.sparkContext.broadcast(flat)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros_like(shared.value)
        for batch in batches:
            x, t = matrix_of(batch.column(vec)), batch.column(y).to_numpy(zero_copy_only=False)
            if not len(x):
                continue

            def squares(pred, t=t):
                off = pred - t
                return float(off @ off), 2.0 * off

            part, grad = backprop(shared.value, x, squares)
            n, loss, total = n + len(x), loss + part, total + grad
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([loss]), pa.array([total.tolist()])], names=["n", "loss", "grad"]
            )

    parts = df.select(vec, F.col(y).cast("double").alias(y)).mapInArrow(
        partial, "n bigint, loss double, grad array<double>"
    )
    return parts.agg(
        F.sum("n").alias("n"),
        F.sum("loss").alias("loss"),
        vector_to_array(Summarizer.sum(array_to_vector("grad"))).alias("grad"),
    )


@F.pandas_udf(StructType([StructField("loss", DoubleType()), StructField("pairs", LongType())]))
def _pair_loss_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for preds, targets in batches:
        done = [pair_loss(np.asarray(p, float), np.asarray(t, float)) for p, t in zip(preds, targets)]
        yield pd.DataFrame({"loss": [d[0] for d in done], "pairs": [d[2] for d in done]})


def ranknet_loss(df: DataFrame, batch_size: int, row_id: str = "row_id", pred: str = "pred",
                 target: str = "y") -> DataFrame:
    """Pairwise ranking loss per batch of ``batch_size`` consecutive rows → (batch_id, loss, n_pairs).

    A batch holds at most ``batch_size`` rows by construction; its pairs are summed in place by
    a vectorised function and never leave it.
    """
    batched = df.groupBy(F.floor(F.col(row_id) / batch_size).alias("batch_id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(row_id, F.col(pred).cast("double").alias("p"), F.col(target).cast("double").alias("t"))
            )
        ).alias("r")
    )
    scored = batched.withColumn("l", _pair_loss_udf(F.col("r.p"), F.col("r.t")))
    return scored.select(
        "batch_id",
        F.when(F.col("l.pairs") > 0, F.col("l.loss") / F.col("l.pairs")).otherwise(0.0).alias("loss"),
        F.col("l.pairs").alias("n_pairs"),
    )
