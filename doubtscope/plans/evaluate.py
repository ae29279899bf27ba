"""End-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtscope.functions.text import with_correct
from doubtscope.functions.tokens import HEAP_DEFAULT, PATIENCE_DEFAULT, patience_from_topk
from doubtscope.operators import labels as lab
from doubtscope.operators import training as tr
from doubtscope.operators.metrics import (
    NAN,
    class_counts,
    detection_summary,
    detection_table,
    pseudo_ok,
)
from doubtscope.operators.network import mlp_score
from doubtscope.operators.pairing import attach_correct_flags, zip_result_logits
from doubtscope.operators.resample import bootstrap_runs_ci, seed_report
from doubtscope.operators.scoring import embed_prompts, infer_wide
from doubtscope.operators.selection import best_run
from doubtscope.session import stored
from doubtscope.sources.artifacts import read_best, register_best, study_report, write_embeddings, write_metrics
from doubtscope.sources.corpus import numbered_samples
from doubtscope.sources.sharded import find_artifacts, first_readable, no_logits, read_sharded, scan_topk_column
from doubtscope.sources.shards import resumable_sharded_write

RESULT_COLUMNS = ["prompt", "label"]


CorrectFn = Callable[[Column, Column], Column]


def flags(results: DataFrame, dataset: Column, pred: str, correct_fn: CorrectFn | None = None) -> DataFrame:
    """(row_id, ok): by ``correct_fn(label, prediction)`` if given, else by the rule of the dataset."""
    slim = results.select("row_id", "label", F.col(pred).alias("__pred"), dataset.alias("__dataset"))
    if correct_fn is None:
        return with_correct(slim, F.col("__dataset"), "label", "__pred").select("row_id", "ok")
    return slim.select("row_id", F.coalesce(correct_fn(F.col("label"), F.col("__pred")).cast("boolean"), F.lit(False)).alias("ok"))


def sequence_scores(results: DataFrame, logits: DataFrame | None, dataset: Column, m: int = HEAP_DEFAULT,
                    w: int = PATIENCE_DEFAULT, pred: str = "answer_0", correct_fn: CorrectFn | None = None) -> DataFrame:
    """(row_id, unc, ok): the early-halting score and the correctness of every result row.

    Rows without logits, or all rows if there is no logits table, have a null score.
    """
    logits = no_logits(results.sparkSession) if logits is None else logits
    flagged = flags(results, dataset, pred, correct_fn)
    return zip_result_logits(flagged, logits, patience_from_topk(F.col("logits"), m, w)["mean"])


def evaluate_sequence_score(results: DataFrame, logits: DataFrame | None, dataset: Column, m: int = HEAP_DEFAULT,
                            w: int = PATIENCE_DEFAULT, pred: str = "answer_0", correct_fn: CorrectFn | None = None) -> DataFrame:
    """Result + logits tables → mean, std, auroc, aurac, balanced_acc."""
    return detection_summary(sequence_scores(results, logits, dataset, m, w, pred, correct_fn))


def evaluate_files(spark: SparkSession, results: str, logits: str | None, dataset: str, response_idx: int = 0,
                   m: int = HEAP_DEFAULT, w: int = PATIENCE_DEFAULT, correct_fn: CorrectFn | None = None) -> DataFrame:
    """``evaluate_sequence_score`` on stored (sharded) tables; only the needed columns are read.

    Without a logits table, or without that response in it, the scores are null.
    """
    pred = f"answer_{response_idx}"
    table = read_sharded(spark, results, ["label", pred])
    try:
        found = None if logits is None else scan_topk_column(spark, logits, response_idx)
    except FileNotFoundError:
        found = None
    return evaluate_sequence_score(table, found, F.lit(dataset), m, w, pred, correct_fn)


def evaluate_scored(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(unc, ok, label) → metrics against true flags, against pseudo flags, and class counts."""
    keys = keys or []
    true = detection_summary(scored, keys)
    names = ["mean", "std", "auroc", "aurac", "balanced_acc"]
    pseudo = detection_summary(scored.withColumn("ok", pseudo_ok(F.col("label"))), keys).select(
        *keys, *[F.col(n).alias(f"pseudo_{n}") for n in names]
    )
    counts = class_counts(scored, keys)
    if keys:
        return true.join(pseudo, keys).join(counts, keys)
    packed = [t.select(F.struct("*").alias("s")).scalar() for t in (pseudo, counts)]
    wide = true.withColumn("__p", packed[0]).withColumn("__c", packed[1])
    return wide.select(*names, "__p.*", "__c.*")


def evaluate_learned_score(results: DataFrame, logits: DataFrame, embeddings: DataFrame, weights: np.ndarray,
                           dataset: Column, topk_worst: int = HEAP_DEFAULT, pred: str = "answer_0",
                           correct_fn: CorrectFn | None = None) -> DataFrame:
    """Result + logits + embeddings + weights → metrics of the learned score. Rows pair by key."""
    labels = lab.compute_labels(results, logits, "topm_norm", topk_worst=topk_worst)
    scored = mlp_score(embeddings, {0: weights}).select("row_id", "unc")
    table = attach_correct_flags(labels.join(scored, "row_id"), flags(results, dataset, pred, correct_fn))
    return evaluate_scored(stored(table, "scored"))


def encode_dataset(spark: SparkSession, stems: dict[str, list[str]], out: str, embedder=None, dim: int = 64) -> list[str]:
    """Per split: the first readable result table → embedding table. Returns the splits written."""
    done = []
    for split, candidates in stems.items():
        results = first_readable(spark, candidates)
        if results is None:
            continue
        write_embeddings(embed_prompts(results, embedder, dim), f"{out}/{split}")
        done.append(split)
    return done


def encode_task(spark: SparkSession, root: str, task: str, out: str, splits: list[str], length: str = "*", method: str = "*",
                n_responses: str = "*", embedder=None, dim: int = 64) -> list[str]:
    """As ``encode_dataset`` with the candidates that a listing of the task's folder finds: whole files first."""
    stems = {split: find_artifacts(spark, root, task, split, length, method, n_responses) for split in splits}
    return encode_dataset(spark, stems, out, embedder, dim)


def infer_corpus(corpus: DataFrame, root: str, predictor: Callable, split: str = "train", method: str = "raw",
                 n_responses: int = 1, n_per_shard: int = 10_000, validation: DataFrame | None = None) -> DataFrame:
    """Corpus → prompts → answers and logits in resumable shards. Returns the manifest."""
    # stored once, in order of row_id: counted, and read by each wave in its own range
    samples = stored(numbered_samples(corpus, split, method, validation).select("row_id", "prompt", "label"), "samples")
    answers = [f"{f}_{i}" for i in range(n_responses)
               for f in ("generated_text", "answer", "answer_token_index", "answer_token_topk_logits")]
    return resumable_sharded_write(
        samples,
        root,
        lambda rows: infer_wide(rows, predictor, n_responses),
        [*RESULT_COLUMNS, *answers],
        [f"gen_topk_logits_{i}" for i in range(n_responses)],
        n_per_shard,
    )


METRICS = ["auroc", "aurac", "balanced_acc"]


def train_and_measure(train: DataFrame, val: DataFrame, test: DataFrame, runs: list[tr.Run],
                      **how) -> tuple[tr.Trained, DataFrame]:
    """Train all runs; one row per run with its validation and test metrics. ``how`` as in ``train_runs``."""
    spark = train.sparkSession
    trained = tr.train_runs(train, val, runs, **how)
    tested = detection_table(mlp_score(test, trained.weights, keep=["row_id", "ok"]), ["run_id"], metrics=METRICS)
    best = spark.createDataFrame(
        [(r.run_id, *[float(trained.best_val[r.run_id].get(n, NAN)) for n in METRICS]) for r in runs],
        "run_id int, " + ", ".join(f"val_{n} double" for n in METRICS),
    )
    renamed = tested.select("run_id", *[F.col(n).alias(f"test_{n}") for n in METRICS])
    return trained, tr.runs_table(spark, runs).join(best, "run_id").join(renamed, "run_id", "left")


@dataclass
class Seeded:
    """The winner trained over several seeds: weights by seed, per-seed records, bootstrap intervals."""

    weights: dict[int, np.ndarray]
    records: DataFrame  # seed, threshold, val_<metric>, test_<metric>
    intervals: DataFrame  # seed, metric, mean, std, ci_low, ci_high


def multi_seed_train(train: DataFrame, val: DataFrame, test: DataFrame, best: tr.Run, seeds=tr.SEEDS_DEFAULT,
                     n_resamples: int = 1000, resample: str = "split", **how) -> Seeded:
    """The best settings over several seeds: best validation and test point per seed, threshold from
    validation, bootstrap on test. All seeds are trained, scored and resampled together."""
    runs = tr.seed_runs(best, seeds)
    trained, measured = train_and_measure(train, val, test, runs, **how)
    cuts = detection_table(mlp_score(val, trained.weights, keep=["row_id", "ok"]), ["run_id"], metrics=["threshold"])
    cuts = stored(cuts, "thresholds")
    found = {r["run_id"]: r["threshold"] for r in cuts.collect()}
    scored = mlp_score(test, trained.weights, keep=["row_id", "ok"])
    intervals = bootstrap_runs_ci(
        scored, "row_id", {r.run_id: r.seed for r in runs}, {r.run_id: found.get(r.run_id, 0.5) for r in runs}, n_resamples, resample
    )
    names = train.sparkSession.createDataFrame([(r.run_id, r.seed) for r in runs], "run_id int, seed int")
    points = [f"{p}_{m}" for p in ("val", "test") for m in METRICS]
    records = measured.drop("seed").join(cuts, "run_id", "left").join(names, "run_id").select("seed", "threshold", *points)
    return Seeded({r.seed: trained.weights[r.run_id] for r in runs}, records, intervals.join(names, "run_id").drop("run_id"))


@dataclass
class Selection:
    best: tr.Run
    table: DataFrame  # the grid with validation and test metrics
    seeded: Seeded
    report: DataFrame  # metric, mean_of_bootstrapped_means, std_across_seeds, and the settings


def sweep_and_select(train: DataFrame, val: DataFrame, test: DataFrame, grid: dict | None = None,
                     seeds=tr.SEEDS_DEFAULT, n_resamples: int = 1000, run: dict | None = None,
                     grid_how: dict | None = None, seed_how: dict | None = None, **how) -> Selection:
    """Grid search → best run by validation AUROC → seeds → averaged bootstrap metrics.

    ``run`` gives settings that all runs share; ``grid_how`` and ``seed_how`` add to ``how`` for one
    of the two trainings.
    """
    runs = tr.grid_runs(grid, **(run or {}))
    _, table = train_and_measure(train, val, test, runs, **how, **(grid_how or {}))
    table = stored(table.withColumn("path", F.format_string("sweep-%05d", F.col("run_id"))), "sweep")
    won = best_run(table, auroc="val_auroc").first()
    if won is None:
        raise ValueError("no run has a validation AUROC")
    best = runs[won["run_id"]]
    seeded = multi_seed_train(train, val, test, best, seeds, n_resamples, **how, **(seed_how or {}))
    settings = [F.lit(getattr(best, n)).alias(n) for n in ("lr", "dropout", "batch_size", "weight_decay")]
    report = seed_report(stored(seeded.intervals, "intervals"), ["metric"]).select(
        "metric", "mean_of_bootstrapped_means", "std_across_seeds", *settings
    )
    return Selection(best, table, seeded, report)


def learn_and_evaluate(results: DataFrame, logits: DataFrame, embeddings: DataFrame, dataset: Column, study: str,
                       registry: str, label_fn: str = "topm_norm", topk_worst: int = HEAP_DEFAULT, pred: str = "answer_0",
                       correct_fn: CorrectFn | None = None, **sweep) -> DataFrame:
    """Tables → labels → sweep → seeds → stored report, weights and marker → metrics of the best seed on test.

    ``results`` has a ``split`` of train, val and test; row ids are unique over all splits. What is
    stored below ``{registry}/study={study}``: ``optimal`` (the winning run), ``report``, ``weights``
    and ``best``.
    """
    spark = results.sparkSession
    labels = lab.compute_labels(results, logits, label_fn, topk_worst=topk_worst).join(results.select("row_id", "split"), "row_id")
    labels = stored(labels, "labels")  # read twice: for the range of train, and to be scaled by it
    rows = lab.build_train_set(labels, embeddings).join(flags(results, dataset, pred, correct_fn), "row_id")
    rows = stored(rows, "train-set")
    train, val, test = (rows.filter(F.col("split") == s) for s in ("train", "val", "test"))
    chosen = sweep_and_select(train, val, test, **sweep)
    root = f"{registry}/study={study}"
    records = stored(chosen.seeded.records, "records")
    # seeds in the order they were asked for settle ties
    reports = records.select("seed", F.col("test_auroc").alias("auroc"), F.col("seed").alias("ord"))
    register_best(tr.weights_table(spark, chosen.seeded.weights, "seed"), reports, study, registry)
    study_report(records, chosen.report, study).write.mode("overwrite").json(f"{root}/report")
    write_metrics(chosen.table.filter(F.col("run_id") == chosen.best.run_id), f"{root}/optimal", study=study)
    weights = tr.read_weights(read_best(spark, study, registry), "seed")
    tested = results.filter(F.col("split") == "test")
    return evaluate_learned_score(
        tested, logits, embeddings, next(iter(weights.values())), dataset, topk_worst, pred, correct_fn
    )


__all__ = [
    "encode_dataset", "encode_task", "evaluate_files", "evaluate_learned_score", "evaluate_scored", "evaluate_sequence_score",
    "infer_corpus", "learn_and_evaluate", "multi_seed_train", "sequence_scores", "sweep_and_select", "train_and_measure",
]
