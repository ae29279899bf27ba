"""Registered queries: detection metrics, bootstrap, run selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtscope.operators import metrics as mt
from doubtscope.operators import resample as rs
from doubtscope.operators import selection as sel
from doubtscope.operators.pairing import with_scalars
from doubtscope.plans import fixtures as fx
from doubtscope.plans.registry import query, shown, table

_GRP = f"WITH {fx.SCORES_SQL}, {fx.metrics_sql('scores', ['grp'])}"
_ALL = f"WITH {fx.SCORES_SQL}, {fx.metrics_sql('scores', [])}"
FIVE = ["mean", "std", "auroc", "aurac", "balanced_acc"]


def _show(df, keys, names):
    return df.select(*keys, *[shown(n).alias(n) for n in names])


@query("finite_only", f"WITH {fx.SCORES_SQL} SELECT row_id, unc, ok FROM scores WHERE unc IS NOT NULL AND isfinite(unc)")
def finite_only(spark, sf):
    return mt.finite_only(fx.scores(spark, sf)).select("row_id", "unc", "ok")


@query("score_summary", f"{_GRP} SELECT grp, mean, std FROM metrics")
def score_summary(spark, sf):
    return _show(mt.score_summary(fx.scores(spark, sf), ["grp"]), ["grp"], ["mean", "std"])


@query("auroc", f"{_ALL} SELECT auroc FROM metrics")
def auroc(spark, sf):
    return _show(mt.auroc(fx.scores(spark, sf)), [], ["auroc"])


@query("auroc_grouped", f"{_GRP} SELECT grp, auroc FROM metrics")
def auroc_grouped(spark, sf):
    return _show(mt.auroc(fx.scores(spark, sf), ["grp"]), ["grp"], ["auroc"])


@query("youden_threshold", f"{_GRP} SELECT grp, threshold FROM metrics")
def youden_threshold(spark, sf):
    return _show(mt.youden_threshold(fx.scores(spark, sf), ["grp"]), ["grp"], ["threshold"])


@query("balanced_acc_youden", f"{_GRP} SELECT grp, balanced_acc FROM metrics")
def balanced_acc_youden(spark, sf):
    return _show(mt.balanced_acc_youden(fx.scores(spark, sf), ["grp"]), ["grp"], ["balanced_acc"])


@query("aurac", f"{_ALL} SELECT aurac FROM metrics")
def aurac(spark, sf):
    return _show(mt.aurac(fx.scores(spark, sf)), [], ["aurac"])


@query(
    "accuracy_at_quantile",
    f"""{_GRP}, c AS (SELECT grp, quantile_cont(unc, 0.25) AS cut FROM fin GROUP BY grp)
        SELECT f.grp, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS accuracy
        FROM fin f JOIN c ON c.grp = f.grp WHERE f.unc <= c.cut GROUP BY f.grp""",
)
def accuracy_at_quantile(spark, sf):
    return _show(mt.accuracy_at_quantile(fx.scores(spark, sf), "0.25", ["grp"]), ["grp"], ["accuracy"])


@query("detection_summary", f"{_GRP} SELECT grp, {', '.join(FIVE)} FROM metrics")
def detection_summary(spark, sf):
    return _show(mt.detection_summary(fx.scores(spark, sf), ["grp"]), ["grp"], FIVE)


@query(
    "roc_curve",
    f"""{_GRP}, pts AS (SELECT grp, unc AS threshold, p - cp + pos AS tp, n - cn + neg AS fp, p, n FROM rk
        UNION ALL SELECT grp, 1e9, 0, 0, any_value(p), any_value(n) FROM rk GROUP BY grp)
        SELECT grp, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
               CASE WHEN p > 0 THEN round(CAST(tp AS DOUBLE) / p, 9) ELSE -1 END AS tpr,
               CASE WHEN n > 0 THEN round(CAST(fp AS DOUBLE) / n, 9) ELSE -1 END AS fpr FROM pts""",
)
def roc_curve(spark, sf):
    c = mt.roc_curve(fx.scores(spark, sf), ["grp"])
    return c.select("grp", shown("threshold").alias("threshold"), "tp", "fp", shown("tpr").alias("tpr"), shown("fpr").alias("fpr"))


@query(
    "class_counts",
    f"""WITH {fx.SCORES_SQL} SELECT grp, count(*) AS n_samples, count(*) FILTER (ok) AS n_correct,
        count(*) FILTER (NOT ok) AS n_incorrect FROM scores GROUP BY grp""",
)
def class_counts(spark, sf):
    return mt.class_counts(fx.scores(spark, sf), ["grp"])


@query(
    "label_distribution",
    f"""WITH {fx.VECTORS_SQL} SELECT split, count(*) FILTER (y = 0) AS n_zero, count(*) FILTER (y = 1) AS n_one
        FROM vectors GROUP BY split""",
)
def label_distribution(spark, sf):
    return mt.label_distribution(fx.vectors(spark, sf), ["split"], "y")


@query(
    "pseudo_label_metrics",
    f"""WITH src AS (SELECT event_id % 4 AS grp, CAST(floor(value) AS DOUBLE) AS unc,
                            CAST(trunc(value / 20) AS INTEGER) = 0 AS ok FROM events),
        {fx.metrics_sql('src', ['grp'])} SELECT grp, {', '.join(FIVE)} FROM metrics""",
)
def pseudo_label_metrics(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("event_id") % 4).alias("grp"), F.floor("value").cast("double").alias("unc"), (F.col("value") / 20).alias("label")
    )
    d = e.withColumn("ok", mt.pseudo_ok(F.col("label")))
    return _show(mt.detection_summary(d, ["grp"]), ["grp"], FIVE)


@query(
    "flag_at_threshold",
    f"""{_GRP} SELECT s.row_id, s.unc >= m.threshold AS flagged FROM scores s JOIN metrics m ON m.grp = s.grp
        WHERE s.unc IS NOT NULL AND isfinite(s.unc)""",
)
def flag_at_threshold(spark, sf):
    s = mt.finite_only(fx.scores(spark, sf))
    cut = mt.youden_threshold(fx.scores(spark, sf), ["grp"])
    return s.join(cut, "grp").select("row_id", mt.flag_at_threshold(F.col("unc"), F.col("threshold")).alias("flagged"))


@query(
    "broadcast_scalar",
    f"{_ALL} SELECT s.row_id, s.unc >= m.threshold AS flagged FROM fin s, metrics m",
)
def broadcast_scalar(spark, sf):
    s = mt.finite_only(fx.scores(spark, sf))
    wide = with_scalars(s, mt.youden_threshold(fx.scores(spark, sf)), ["threshold"])
    return wide.select("row_id", (F.col("unc") >= F.col("threshold")).alias("flagged"))


def _boot_sql(n_resamples: int, seed: int, source: str, threshold: float | None) -> str:
    bal = "balanced_acc" if threshold is None else f"""(SELECT round((count(*) FILTER (NOT ok AND unc >= {threshold}) / CAST(count(*) FILTER (NOT ok) AS DOUBLE)
        + count(*) FILTER (ok AND NOT unc >= {threshold}) / CAST(count(*) FILTER (ok) AS DOUBLE)) / 2, 12) FROM drawn d WHERE d.resample = metrics.resample)"""
    return f"""
num AS (SELECT unc, ok, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM {source}),
sz AS (SELECT count(*) AS n FROM num),
draws AS (SELECT b AS resample, CAST('0x' || substr(md5('{seed}:' || b || ':' || i), 1, 15) AS BIGINT) % sz.n AS row_index
          FROM sz, range({n_resamples}) r(b), (SELECT row_index AS i FROM num)),
drawn AS (SELECT d.resample, n.unc, n.ok FROM draws d JOIN num n ON n.row_index = d.row_index),
{fx.metrics_sql('drawn', ['resample'])},
vals AS (SELECT auroc, aurac, {bal} AS balanced_acc FROM metrics WHERE balanced_acc >= 0),
long AS (SELECT 'auroc' AS metric, auroc AS v FROM vals UNION ALL SELECT 'aurac', aurac FROM vals
         UNION ALL SELECT 'balanced_acc', balanced_acc FROM vals)"""


_EVENT_SQL = """answers AS (SELECT event_id AS row_id, CAST(floor(value) AS DOUBLE) AS unc, event_type <> 'error' AS ok FROM events)"""


def _answers(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.floor("value").cast("double").alias("unc"), (F.col("event_type") != "error").alias("ok")
    )


@query("bootstrap_metrics")
def bootstrap_metrics(spark, sf):
    return rs.bootstrap_metrics(_answers(spark, sf), "row_id", n_resamples=1000, seed=0)


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return rs.bootstrap_ci(_answers(spark, sf), "row_id", n_resamples=1000, seed=7, threshold=60.0)


@query(
    "bootstrap_metrics_draws",
    f"""WITH {_EVENT_SQL}, {_boot_sql(1000, 0, 'answers', None)}
        SELECT metric, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std FROM long GROUP BY metric""",
)
def bootstrap_metrics_draws(spark, sf):
    return rs.bootstrap_metrics(_answers(spark, sf), "row_id", n_resamples=1000, seed=0, method="draws")


@query(
    "bootstrap_ci_draws",
    f"""WITH {_EVENT_SQL}, {_boot_sql(1000, 7, 'answers', 60.0)}
        SELECT metric, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std,
               round(quantile_cont(v, 0.025), 3) AS ci_low, round(quantile_cont(v, 0.975), 3) AS ci_high
        FROM long GROUP BY metric""",
)
def bootstrap_ci_draws(spark, sf):
    return rs.bootstrap_ci(_answers(spark, sf), "row_id", n_resamples=1000, seed=7, threshold=60.0, method="draws")


def _runs(spark, sf):
    """Orders as runs: one study per customer; some runs without AUROC, some NaN."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    auroc = F.when(k % 11 == 0, None).when(k % 13 == 0, float("nan")).otherwise(F.floor(F.col("o_totalprice") / 50000) / 10.0)
    return o.select(F.col("o_custkey").alias("study"), F.format_string("sweep-%07d", k).alias("path"), auroc.alias("auroc"), k.alias("seed"))


_RUNS_SQL = """runs AS (SELECT o_custkey AS study, 'sweep-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS path, o_orderkey AS seed,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST('NaN' AS DOUBLE)
         ELSE floor(o_totalprice / 50000) / CAST(10 AS DOUBLE) END AS auroc FROM orders)"""


@query(
    "best_run",
    f"""WITH {_RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY auroc DESC, path) AS place FROM runs
        WHERE auroc IS NOT NULL AND NOT isnan(auroc)) SELECT study, path, auroc FROM r WHERE place = 1""",
)
def best_run(spark, sf):
    return sel.best_run(_runs(spark, sf).drop("seed"), ["study"])


@query(
    "best_seed",
    f"""WITH {_RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY CASE WHEN auroc IS NULL OR isnan(auroc) THEN -1 ELSE auroc END DESC, seed) AS place
        FROM runs) SELECT study, seed FROM r WHERE place = 1""",
)
def best_seed(spark, sf):
    runs = _runs(spark, sf).withColumn("ord", F.col("seed"))
    return sel.best_seed(runs, ["study"])


@query(
    "seed_report",
    f"""WITH {_RUNS_SQL} SELECT study,
        round(coalesce(avg(auroc) FILTER (NOT isnan(auroc)), -1), 9) AS mean_of_bootstrapped_means,
        round(coalesce(stddev_pop(auroc) FILTER (NOT isnan(auroc)), -1), 9) AS std_across_seeds FROM runs GROUP BY study""",
)
def seed_report(spark, sf):
    r = rs.seed_report(_runs(spark, sf), ["study"], "auroc")
    return _show(r, ["study"], ["mean_of_bootstrapped_means", "std_across_seeds"])


@query(
    "early_stop",
    """WITH pts AS (SELECT conv_id AS run_id, (turn + 1) * 200 AS step, turn + 1 AS i,
                   (length(text) * 7919 % 1000) / CAST(1000 AS DOUBLE) AS auroc FROM conversations),
    a AS (SELECT *, coalesce(max(auroc) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS was FROM pts),
    b AS (SELECT *, auroc > was AS better, greatest(was, auroc) AS best_auroc FROM a),
    c AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY step)
                     - coalesce(max(CASE WHEN better THEN rn END) OVER (PARTITION BY run_id ORDER BY step), 0)) * 200 AS idle_steps
          FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM b)),
    d AS (SELECT *, min(CASE WHEN idle_steps >= 400 AND step > 200 THEN step END) OVER (PARTITION BY run_id) AS first FROM c)
    SELECT run_id, step, auroc, best_auroc, better, CAST(idle_steps AS BIGINT) AS idle_steps, coalesce(step = first, false) AS stop FROM d""",
)
def early_stop(spark, sf):
    c = table(spark, sf, "conversations")
    pts = c.select(
        F.col("conv_id").alias("run_id"), ((F.col("turn") + 1) * 200).alias("step"),
        ((F.length("text") * 7919 % 1000) / 1000.0).alias("auroc"),
    )
    return sel.early_stop(pts, total_steps=4000, val_steps=200, keys=["run_id"])


@query(
    "lr_schedule",
    """WITH n AS (SELECT count(*) AS total, greatest(1, CAST(floor(0.05 * count(*)) AS BIGINT)) AS warm FROM events)
    SELECT event_id AS step, round(CASE WHEN event_id < warm THEN CAST(event_id AS DOUBLE) / warm
        ELSE greatest(0, 0.5 * (1 + cos(pi() * (event_id - warm) / CAST(greatest(1, total - warm) AS DOUBLE)))) END, 9) AS factor
    FROM events, n""",
)
def lr_schedule(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("step"), shown(sel.lr_factor(F.col("event_id"), e.count())).alias("factor"))
