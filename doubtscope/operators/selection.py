"""Choosing runs and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtscope.operators.prefix import running_totals


def best_run(runs: DataFrame, keys: list[str] | None = None, auroc: str = "auroc", path: str = "path") -> DataFrame:
    """Run with the highest validation AUROC, the first path on ties; a missing or NaN one never wins.

    ``min_by`` is a partial aggregate: no group is sorted.
    """
    score = F.coalesce(F.col(auroc), F.lit(-1.0))
    fit = runs.filter(~F.isnan(score) & (score > -1.0))
    rank = F.struct((-score).alias("s"), F.col(path).alias("p"))
    whole = F.struct(*[F.col(c) for c in runs.columns if c not in (keys or [])])
    picked = fit.groupBy(*(keys or [])).agg(F.min_by(whole, rank).alias("r"))
    return picked.filter(F.col("r").isNotNull()).select(*(keys or []), "r.*")


def best_seed(reports: DataFrame, keys: list[str] | None = None, auroc: str = "auroc", order: str = "ord") -> DataFrame:
    """First seed with the highest AUROC; a missing or NaN one counts as -1."""
    rank = F.struct((-F.coalesce(F.nanvl(F.col(auroc), F.lit(-1.0)), F.lit(-1.0))).alias("s"), F.col(order).alias("o"))
    return reports.groupBy(*(keys or [])).agg(F.min_by("seed", rank).alias("seed"))


def early_stop(points: DataFrame, total_steps: int, val_steps: int, keys: list[str]) -> DataFrame:
    """Per validation point: best AUROC so far, steps without improvement, and whether to stop here.

    A run stops at its first point that has gone 10 % of all steps without a strictly better AUROC
    and is past the warm-up. Running maxima are cut into step ranges, so a run of any length is
    spread over tasks.
    """
    warmup, patience = max(1, int(0.05 * total_steps)), int(0.1 * total_steps)
    # NaN never improves, and nothing improves on the start value of -1 from below
    seen = "if(isnan(auroc) or auroc is null, -1D, greatest(auroc, -1D))"
    best = running_totals(points, keys, "step", {"at": "1L"}, maxima={"auroc": seen})
    # better: a new maximum, first of its value: its rank by (value, earliest step) is unique
    firsts = best.groupBy(*keys, F.col("top_auroc").alias("best_auroc")).agg(F.min("step").alias("__first"))
    marked = best.withColumnRenamed("top_auroc", "best_auroc").join(firsts, [*keys, "best_auroc"])
    marked = marked.withColumn("better", F.expr("step = __first and best_auroc > -1D")).drop("__first")
    since = marked.withColumnRenamed("cum_at", "__at").drop("all_at")
    since = running_totals(since, keys, "step", {"one": "1L"}, maxima={"last": "if(better, __at, null)"})
    since = since.withColumn("idle_steps", F.expr(f"(__at - coalesce(top_last, 0L)) * {val_steps}L"))
    hit = f"if(idle_steps >= {patience} and step > {warmup}, step, null)"
    stops = since.groupBy(*keys).agg(F.expr(f"min({hit}) as __stop"))
    return since.join(stops, keys).select(
        *points.columns, "best_auroc", "better", "idle_steps",
        F.expr("coalesce(step = __stop, false) as stop"),
    )


def lr_factor(step, total_steps: int):
    """Linear warm-up over 5 % of the steps, then cosine to zero; step 0 has rate 0. A Column."""
    warmup = max(1, int(0.05 * total_steps))
    progress = (step - warmup) / float(max(1, total_steps - warmup))
    cosine = F.greatest(F.lit(0.0), (F.cos(F.pi() * progress) + 1.0) * 0.5)
    return F.when(step < warmup, step / float(warmup)).otherwise(cosine)
