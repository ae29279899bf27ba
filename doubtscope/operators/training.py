"""Training the small scorer over a distributed table, all runs of a grid at once.

How a run is trained is the caller's choice and never follows from the number of rows:

- ``exact``: every step is one Spark job. An epoch places the rows in its batches by a keyed permutation of their
  number; each task streams its rows and returns one summed gradient per run, and the sum over all tasks
  makes the step. For a ranking loss another job fetches the batch's predictions first, so that its pairs may
  span tasks. The result does not depend on how rows lie in partitions. Meant for large batches.
- ``averaged``: the rows are dealt once into a given number of parts. Every part takes ordinary
  mini-batch steps for a given number of epochs or up to the next validation; weights and optimiser moments
  are then averaged, weighted by rows (iterative parameter mixing). With one part this is sequential
  mini-batch training. A part is held by one task, so choose parts to fit executors.

What travels is weights, gradients and predictions of a batch, never rows. Row order and dropout are drawn from
(seed, epoch, step), so a retried task repeats its result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# names, not the module: functions sent to workers carry what they name
from doubtscope.operators.metrics import detection_table
from doubtscope.operators.network import (
    Adam,
    backprop,
    hidden_size,
    init_weights,
    loss_and_slope,
    LOSSES,
    matrix_of,
    mlp_score,
    PAIR_GAP,
    predict,
    sigmoid,
    weight_count,
)
from doubtscope.operators.prefix import dense_index

# The published grid and training defaults
GRID = {"lr": [3e-3, 1e-3, 3e-4], "dropout": [0.3], "batch_size": [64, 128, 256]}
EPOCHS_DEFAULT, VAL_STEPS_DEFAULT, WEIGHT_DECAY_DEFAULT = 100, 2000, 1e-4
SEEDS_DEFAULT = (0, 1, 2, 3, 4)

MODES = ("exact", "averaged")
BLOCK = 1 << 16
#: Rows a batch may have under a ranking loss: their predictions come to the driver, and each row meets all others.
MOST_PAIRED = 1 << 16


@dataclass(frozen=True)
class Run:
    run_id: int
    lr: float = 1e-3
    dropout: float = 0.1
    batch_size: int = 64
    seed: int = 0
    weight_decay: float = WEIGHT_DECAY_DEFAULT
    loss: str = "mse"
    rank_lambda: float = 0.5

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss!r}, expected one of {LOSSES}")


@dataclass
class _State:
    flat: np.ndarray
    adam: Adam
    best: np.ndarray
    best_auroc: float = -1.0
    best_step: int = 0
    idle: int = 0
    step: int = 0
    stopped: bool = False
    best_val: dict = field(default_factory=dict)


@dataclass
class Trained:
    weights: dict[int, np.ndarray]
    best_val: dict[int, dict]
    history: list[dict]


def grid_runs(grid: dict | None = None, seed: int = 0, **fixed) -> list[Run]:
    """Every combination of the grid, in order, each with its own seed."""
    grid = grid or GRID
    combos = list(itertools.product(*grid.values()))
    seeds = np.random.default_rng(seed).integers(0, 10001, size=len(combos))
    return [
        Run(run_id=i, seed=int(seeds[i]), **dict(zip(grid, c)), **fixed) for i, c in enumerate(combos)
    ]


def runs_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    return spark.createDataFrame(
        [tuple(asdict(r).values()) for r in runs],
        "run_id int, lr double, dropout double, batch_size int, seed bigint, weight_decay double, "
        "loss string, rank_lambda double",
    )


def _rate(step: int, total: int) -> float:
    warm = max(1, int(0.05 * total))
    if step < warm:
        return step / warm
    return max(0.0, 0.5 * (1.0 + np.cos(np.pi * (step - warm) / max(1, total - warm))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def places(number: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Where an epoch puts rows 0 .. n - 1: a permutation keyed by (seed, epoch), worked out for the given rows only.

    Four rounds of a Feistel network over the next even number of bits; values beyond n go round again.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = _mixed(np.arange(1, 5, dtype=np.uint64) + _mixed(np.array([seed * 1_000_003 + epoch + 1], np.uint64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & low)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        out = once(number.astype(np.uint64))
        while (beyond := out >= n).any():
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _row_keys(row_id: np.ndarray, seed: int, epoch: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([seed * 1_000_003 + epoch + 1], np.uint64))
        return _mixed(row_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)


def _dropout(keys: np.ndarray, step: int, hidden: int, share: float) -> np.ndarray | None:
    """Scaled mask over hidden units, drawn per row and step whatever batch the row came in."""
    if share <= 0:
        return None
    with np.errstate(over="ignore"):
        cell = keys[:, None] + np.arange(1, hidden + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)
    return (((_mixed(cell) >> np.uint64(11)).astype(float) * 2.0**-53) >= share) / (1.0 - share)


def _train_part(part: int, x: np.ndarray, y: np.ndarray, run: Run, state, epoch: int, total: int,
                first: int = 0, last: int | None = None):
    """Mini-batch steps first..last of an epoch over one part → (weights, Adam state, summed loss, rows)."""
    flat, adam = state[0].copy(), Adam(state[1].copy(), state[2].copy(), state[3])
    order = np.random.default_rng([run.seed, epoch, part]).permutation(len(x))
    hidden, lost, seen = hidden_size(x.shape[1]), 0.0, 0
    for k in range(first, -(-len(x) // run.batch_size) if last is None else last):
        rows = order[k * run.batch_size : (k + 1) * run.batch_size]
        if not len(rows):
            break
        mask = None
        if run.dropout > 0:
            rng = np.random.default_rng([run.seed, epoch, part, k])
            mask = (rng.random((len(rows), hidden)) >= run.dropout) / (1.0 - run.dropout)
        target = y[rows]
        loss, grad = backprop(
            flat, x[rows], lambda pred: loss_and_slope(run.loss, run.rank_lambda, pred, target), mask
        )
        flat = adam.update(flat, grad, run.lr * _rate(adam.steps, total), run.weight_decay)
        lost, seen = lost + loss * len(rows), seen + len(rows)
    return flat, adam, lost, seen


def train_runs(
    train: DataFrame,
    val: DataFrame | None,
    runs: list[Run],
    epochs: int = EPOCHS_DEFAULT,
    val_steps: int = VAL_STEPS_DEFAULT,
    mode: str = "exact",
    parts: int | None = None,
    sync_epochs: int = 1,
    initial: dict[int, np.ndarray] | None = None,
) -> Trained:
    """Train all runs on (row_id, embedding, y); validate on (row_id, embedding, ok).

    A run validates every ``val_steps`` steps and after its last one, keeps the weights of its best
    validation AUROC, and stops after 10 % of all steps without improvement. ``averaged`` needs
    ``parts``, and averages them every ``sync_epochs`` epochs and before each validation. ``row_id`` is unique. ``initial`` replaces the drawn starting weights of runs.
    """
    if mode not in MODES or (mode == "averaged") != (parts is not None):
        raise ValueError("mode is 'exact', or 'averaged' with a number of parts")
    spark = train.sparkSession
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not shape["n"]:
        raise ValueError("no labelled training row")
    dim = int(shape["d"])
    data = train.select("row_id", "embedding", F.col("y").cast("double").alias("y"))
    if mode == "exact":
        if any(r.loss != "mse" and min(r.batch_size, shape["n"]) > MOST_PAIRED for r in runs):
            raise ValueError(f"a batch of a ranking loss has at most {MOST_PAIRED} rows")
        data = data.join(dense_index(data.select("row_id"), "row_id", "number"), "row_id")
    if mode == "averaged":
        dealt = data.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int"))
        data = dealt.repartitionById(parts, F.col("part"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    held_val = None if val is None else val.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = shape["n"] if mode == "exact" else data.groupBy("part").count().agg(F.max("count")).first()[0]
        per_epoch = {r.run_id: -(-rows // r.batch_size) for r in runs}
        states = {}
        for r in runs:
            flat = (initial or {}).get(r.run_id)
            flat = init_weights(dim, r.seed) if flat is None else np.asarray(flat, float)
            states[r.run_id] = _State(flat, Adam(np.zeros_like(flat), np.zeros_like(flat)), flat)
        history: list[dict] = []
        while active := [r for r in runs if not states[r.run_id].stopped and states[r.run_id].step < per_epoch[r.run_id] * epochs]:
            spans = {}
            for r in active:
                step, n = states[r.run_id].step, per_epoch[r.run_id]
                # (epoch, first step of the epoch, behind the last one, counted from the same epoch)
                end = step + 1 if mode == "exact" else min(step // n + sync_epochs, epochs) * n
                if val is not None:
                    end = min(end, step - step % val_steps + val_steps)
                spans[r.run_id] = (step // n, step % n, end - step // n * n)
            advance = _exact_step if mode == "exact" else _averaged_steps
            losses = advance(spark, data, active, states, per_epoch, spans, epochs, shape["n"])
            due = []
            for r in active:
                s, (epoch, first, last) = states[r.run_id], spans[r.run_id]
                s.step += last - first
                if val is not None and (s.step % val_steps == 0 or s.step == per_epoch[r.run_id] * epochs):
                    due.append(r)
                history.append({"run_id": r.run_id, "epoch": epoch, "step": s.step, "loss": losses[r.run_id], "val_auroc": None})
            if due:
                _validate(held_val, due, states, per_epoch, epochs, val_steps, history)
        for s in states.values():
            if val is None:
                s.best = s.flat
        return Trained(
            {k: s.best for k, s in states.items()}, {k: s.best_val for k, s in states.items()}, history
        )
    finally:
        data.unpersist()
        if held_val is not None:
            held_val.unpersist()


def _doubles(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(v.values) for v in column]


def pair_slope(pred: np.ndarray, target: np.ndarray, all_pred: np.ndarray, all_target: np.ndarray) -> tuple[float, np.ndarray, int]:
    """This task's part of ``pair_loss`` over a batch that spans tasks: (loss, gradient in its own
    predictions, pairs) of the pairs whose first row is here, against blocks of all rows."""
    loss, slope, count = 0.0, np.zeros_like(pred), 0
    for at in range(0, len(all_pred), 4096):
        dy = target[:, None] - all_target[None, at : at + 4096]
        pairs = np.abs(dy) > PAIR_GAP
        sign = np.sign(dy)
        margin = -sign * (pred[:, None] - all_pred[None, at : at + 4096])
        loss += float((np.maximum(margin, 0.0) + np.log1p(np.exp(-np.abs(margin))))[pairs].sum())
        slope += 2.0 * np.where(pairs, -sign * sigmoid(margin), 0.0).sum(axis=1)  # a row is first in one pair, second in its mirror
        count += int(pairs.sum())
    return loss, slope, count


def _exact_step(spark, data, active, states, per_epoch, spans, epochs, n) -> dict[int, float]:
    """One step of every active run: gradients summed over all tasks, in one job (and one before it for ranking losses)."""
    # plain values only: broadcast data is unpickled by name, and workers need not have this package
    plan = [(asdict(r), states[r.run_id].flat, spans[r.run_id], states[r.run_id].step) for r in active]

    def rows_of(batches: Iterator[pa.RecordBatch], plan: list, ranked: bool):
        """(run, weights, vectors, targets, dropout mask, rows in the batch) of every Arrow batch and run with rows in the step."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix_of(batch.column("embedding")), batch.column("y").to_numpy(zero_copy_only=False)
            ids, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "number"))
            for spec, flat, (epoch, k, _), step in plan:
                run = Run(**spec)
                if ranked and run.loss == "mse":
                    continue
                first, last = k * run.batch_size, min(n, (k + 1) * run.batch_size)
                place = places(number, n, run.seed, epoch)
                mine = (place >= first) & (place < last)
                if mine.any():
                    keep = _dropout(_row_keys(ids[mine], run.seed, epoch), step, hidden_size(x.shape[1]), run.dropout)
                    yield run, flat, x[mine], y[mine], keep, last - first

    whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if any(r.loss != "mse" for r in active):
        shared = spark.sparkContext.broadcast(plan)

        def preds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for run, flat, x, y, keep, _ in rows_of(batches, shared.value, True):
                yield pa.RecordBatch.from_pydict({"run_id": pa.array([run.run_id] * len(y), pa.int32()), "pred": pa.array(predict(flat, x, keep)), "y": pa.array(y)})

        found = data.mapInArrow(preds, "run_id int, pred double, y double").toArrow()
        shared.destroy()
        for r in active:
            mine = found.filter(pc.equal(found["run_id"], r.run_id))
            whole[r.run_id] = (mine["pred"].to_numpy(), mine["y"].to_numpy())
    shared = spark.sparkContext.broadcast((plan, whole))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, whole = shared.value
        sums: dict[tuple[int, bool], list] = {}

        def add(key: tuple[int, bool], size: int, lost: float, grad: np.ndarray) -> None:
            held = sums.setdefault(key, [0, 0.0, 0.0])
            sums[key] = [held[0] + size, held[1] + lost, held[2] + grad]

        for run, flat, x, y, keep, _ in rows_of(batches, plan, False):

            def squares(pred, target=y):
                off = pred - target
                return float(off @ off), 2.0 * off

            if run.loss != "rank":
                add((run.run_id, False), len(y), *backprop(flat, x, squares, keep))
            if run.loss != "mse":
                lost, slope, count = pair_slope(predict(flat, x, keep), y, *whole[run.run_id])
                add((run.run_id, True), count, lost, backprop(flat, x, lambda pred, slope=slope: (0.0, slope), keep)[1])
        if sums:
            yield pa.RecordBatch.from_pydict(
                {
                    "run_id": pa.array([k[0] for k in sums], pa.int32()),
                    "pairs": pa.array([k[1] for k in sums], pa.bool_()),
                    "n": pa.array([v[0] for v in sums.values()], pa.int64()),
                    "lost": pa.array([v[1] for v in sums.values()], pa.float64()),
                    "grad": pa.array([v[2] for v in sums.values()], pa.list_(pa.float64())),
                }
            )

    partial = data.mapInArrow(work, "run_id int, pairs boolean, n bigint, lost double, grad array<double>")
    summed = (
        partial.groupBy("run_id", "pairs")
        .agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"), vector_to_array(Summarizer.sum(array_to_vector("grad"))).alias("grad"))
        .toArrow()
    )
    shared.destroy()
    found = {(r, p): v for r, p, *v in zip(*(summed[c].to_pylist() for c in ("run_id", "pairs", "n", "lost")), _doubles(summed["grad"]), strict=True)}
    losses = {}
    for r in active:
        s, total, loss, grad = states[r.run_id], per_epoch[r.run_id] * epochs, 0.0, np.zeros(len(states[r.run_id].flat))
        for pairs, scale in ((False, 1.0), (True, 1.0 if r.loss == "rank" else r.rank_lambda)):
            size, lost, part = found.get((r.run_id, pairs), (0, 0.0, None))
            if size:
                loss, grad = loss + scale * lost / size, grad + scale * part / size
        losses[r.run_id] = loss
        s.flat = s.adam.update(s.flat, grad, r.lr * _rate(s.step, total), r.weight_decay)
    return losses


def _averaged_steps(spark, data, active, states, per_epoch, spans, epochs, n) -> dict[int, float]:
    """Steps of every part and run up to the end of their spans, then the weighted mean of the parts."""
    plan = [
        (asdict(r), (s.flat, s.adam.m, s.adam.v, s.adam.steps), spans[r.run_id], per_epoch[r.run_id])
        for r in active
        for s in [states[r.run_id]]
    ]
    shared = spark.sparkContext.broadcast(plan)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("row_id", "ascending")])
        x, y, p = matrix_of(table["embedding"]), table["y"].to_numpy(), table["part"][0].as_py()
        for spec, state, (epoch, first, last), n_batches in shared.value:
            run, lost, seen, at = Run(**spec), 0.0, 0, first
            while at < last:  # epoch by epoch
                ahead, k = divmod(at, n_batches)
                upto = min(n_batches, k + last - at)
                flat, adam, loss, rows = _train_part(p, x, y, run, state, epoch + ahead, n_batches * epochs, k, upto)
                state, lost, seen, at = (flat, adam.m, adam.v, adam.steps), lost + loss, seen + rows, at + upto - k
            whole = np.concatenate([flat, adam.m, adam.v])
            starts = range(0, len(whole), BLOCK)
            yield pa.RecordBatch.from_pydict(
                {
                    "run_id": pa.array([run.run_id] * len(starts), pa.int32()),
                    "block": pa.array(range(len(starts)), pa.int32()),
                    "n_rows": pa.array([len(x)] * len(starts), pa.int64()),
                    "steps": pa.array([adam.steps] * len(starts), pa.int32()),
                    "lost": pa.array([lost] * len(starts), pa.float64()),
                    "seen": pa.array([seen] * len(starts), pa.int64()),
                    "vals": pa.array([whole[i : i + BLOCK] for i in starts], pa.list_(pa.float64())),
                }
            )

    out = data.mapInArrow(work, "run_id int, block int, n_rows bigint, steps int, lost double, seen bigint, vals array<double>")
    mixed = (
        out.groupBy("run_id", "block")
        .agg(
            vector_to_array(Summarizer.mean(array_to_vector("vals"), F.col("n_rows").cast("double"))).alias("vals"),
            F.max("steps").alias("steps"),
            (F.sum("lost") / F.sum("seen")).alias("loss"),
        )
        .toArrow()
        .sort_by([("run_id", "ascending"), ("block", "ascending")])
    )
    shared.destroy()
    losses = {}
    for r in active:
        size = len(states[r.run_id].flat)
        rows = mixed.filter(pc.equal(mixed["run_id"], r.run_id))
        whole = np.concatenate(_doubles(rows["vals"]))
        s = states[r.run_id]
        s.flat, s.adam = whole[:size], Adam(whole[size : 2 * size], whole[2 * size :], rows["steps"][0].as_py())
        losses[r.run_id] = rows["loss"][0].as_py()
    return losses


def _validate(val, due, states, per_epoch, epochs, val_steps, history) -> None:
    scored = mlp_score(val, {r.run_id: states[r.run_id].flat for r in due}, keep=["row_id", "ok"])
    found = {m["run_id"]: m.asDict() for m in detection_table(scored, ["run_id"]).collect()}
    for r in due:
        s, total = states[r.run_id], per_epoch[r.run_id] * epochs
        got = found.get(r.run_id)
        if got is None:
            continue
        for h in reversed(history):
            if h["run_id"] == r.run_id:
                h["val_auroc"] = got["auroc"]
                break
        if got["auroc"] > s.best_auroc:
            s.best_auroc, s.best_step, s.idle = got["auroc"], s.step, 0
            s.best = s.flat.copy()
            s.best_val = {k: v for k, v in got.items() if k != "run_id"}
        elif s.step % val_steps == 0:  # the validation after the last step counts no idle time
            s.idle += val_steps
        s.stopped = s.idle >= int(0.1 * total) and s.step > max(1, int(0.05 * total))


def seed_runs(best: Run, seeds=SEEDS_DEFAULT) -> list[Run]:
    """The winner's settings once per seed."""
    return [replace(best, run_id=i, seed=s) for i, s in enumerate(seeds)]


def weights_table(spark: SparkSession, weights: dict[int, np.ndarray], name: str = "run_id") -> DataFrame:
    """(run, weights): one row of doubles per run."""
    rows = [(int(k), [float(v) for v in w]) for k, w in weights.items()]
    return spark.createDataFrame(rows, f"{name} int, weights array<double>")


def read_weights(table: DataFrame, name: str = "run_id") -> dict[int, np.ndarray]:
    """Back to vectors on the driver; as many rows as runs."""
    return {r[name]: np.asarray(r["weights"]) for r in table.select(name, "weights").collect()}
