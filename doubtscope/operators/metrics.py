"""Detection metrics: how well an uncertainty score finds wrong answers.

All metrics come from one table of cells, one row per (group, distinct score) with the number of
wrong and right answers. Cells are built with partial aggregation, so ties cost nothing and a hot
group is spread over its scores. Conventions: the positive class is a *wrong* answer; rows whose
score is null, NaN or infinite take no part in the ranking metrics; mean and standard deviation
take all non-null scores.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.operators.prefix import running_totals

NAN = float("nan")
INF = float("inf")
COVERAGE_STEPS = 20


# SQL text of the pieces the metrics are made of, over the columns of ``ranked_cells``
_SEEN = "n_wrong + n_right > 0"
_CAUGHT = "all_wrong - cum_wrong + n_wrong"  # wrong answers at or above the cell's score
_ALARMS = "all_right - cum_right + n_right"  # right answers at or above it
_N = "all_wrong + all_right"
_UPTO = "cum_wrong + cum_right"


def _exact(count: str) -> str:
    """Counts as decimals: products of two counts stay exact beyond 2**63."""
    return f"cast({count} as decimal(19,0))"


# Youden's J times P*N, an exact integer: no float ties
_YOUDEN = f"{_exact(_CAUGHT)} * {_exact('all_right')} - {_exact(_ALARMS)} * {_exact('all_wrong')}"


def _ranks_below(x: str) -> str:
    """How many of the 20 cut ranks floor((n-1)(19+9i)/190), i = 0…19, are below x.

    Rank i is below x iff 9i(n-1) < 190x - 19(n-1), so the count is one integer division.
    """
    gap = f"({_N} - 1)"
    room = f"(({x}) * 190 - {gap} * 19)"
    some = f"least((({room} - 1) div greatest({gap} * 9, 1)) + 1, {COVERAGE_STEPS})"
    single = f"if({x} > 0, {COVERAGE_STEPS}, 0)"
    return f"(case when {gap} <= 0 then {single} when {room} <= 0 then 0 else {some} end)"


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def finite_only(df: DataFrame, unc: str = "unc") -> DataFrame:
    return df.filter(is_finite(F.col(unc)))


def score_cells(df: DataFrame, keys: list[str], unc: str = "unc", ok: str = "ok", times: str | None = None) -> DataFrame:
    """One row per (keys, score): ``n_wrong``, ``n_right`` (finite scores), ``n_any`` (non-null scores),
    and ``w_all``, ``r_all``, the wrong and right rows whatever their score. A row counts ``times`` times."""
    x = f"cast(`{unc}` as double)"
    finite = f"{x} is not null and not isnan({x}) and abs({x}) <> double('infinity')"

    def rows(which: str) -> str:
        return f"sum(if({which}, `{times}`, 0L))" if times else f"count_if({which})"

    return df.groupBy(*keys, F.expr(f"{x} as score")).agg(
        F.expr(f"{rows(f'{finite} and not `{ok}`')} as n_wrong"),
        F.expr(f"{rows(f'{finite} and `{ok}`')} as n_right"),
        F.expr(f"{rows(f'{x} is not null')} as n_any"),
        F.expr(f"{rows(f'not `{ok}`')} as w_all"),
        F.expr(f"{rows(f'`{ok}`')} as r_all"),
    )


def ranked_cells(df: DataFrame, keys: list[str], unc: str = "unc", ok: str = "ok", times: str | None = None) -> DataFrame:
    """Cells with ascending running counts (``cum_*``) and group totals (``all_*``)."""
    # The filter is always true and there for its columns: each of the three readers of the cells
    # then needs all of them, so none prunes one, the shuffle is reused and the source scanned once.
    cells = score_cells(df, keys, unc, ok, times).filter("n_wrong + n_right + n_any + w_all + r_all >= 0")
    return running_totals(
        cells,
        keys,
        "score",
        {"wrong": "n_wrong", "right": "n_right"},
        {"any": "n_any", "sum": "if(n_any > 0, score * n_any, null)"},
        keep=f"{_SEEN} and n_any > 0",
    )


def _metric_columns(with_threshold: bool, at: str | None = None) -> list[Column]:
    """The aggregates over ranked cells from which every metric is finished.

    Finding where J is highest needs a struct buffer and so a sorted aggregate; J alone does not.
    """
    # mean over all non-null scores; NaN and infinities take part
    mean = "if(all_any > 0, all_sum / all_any, null)"
    wins = f"{_exact('n_right')} * (2 * {_exact('all_wrong - cum_wrong')} + {_exact('n_wrong')})"
    cuts = f"({_ranks_below(_UPTO)} - {_ranks_below(f'{_UPTO} - n_wrong - n_right')})"
    columns = [
        f"max(if({_SEEN}, {_YOUDEN}, null)) as j",
        "max(all_any) as n_any",
        "max(all_wrong) as p",
        "max(all_right) as n",
        f"max({mean}) as mean",
        f"sum(if(n_any > 0, power(score - {mean}, 2) * n_any, null)) as spread",
        f"sum({wins}) as wins",
        f"sum(if({_SEEN}, cum_right / ({_UPTO}) * {cuts}, null)) as covered",
    ]
    if at is not None:
        # at a given threshold every row counts; a null score is on neither side, NaN above all
        columns += [
            "sum(w_all) as w_rows",
            "sum(r_all) as r_rows",
            f"sum(if(score >= {at}, w_all, 0L)) as caught",
            f"sum(if(score < {at}, r_all, 0L)) as passed",
        ]
    if with_threshold:
        columns.append(f"max(if({_SEEN}, struct({_YOUDEN} as j, score as at), null)) as best")
    return [F.expr(c) for c in columns]


_TWO = "coalesce(p, 0) > 0 and coalesce(n, 0) > 0"
_PAIRS = f"cast({_exact('p')} * {_exact('n')} as double)"

# Final expressions over the aggregates of ``_metric_columns``
_FINISHED = {
    "mean": "if(n_any > 0, mean, double('NaN'))",
    "std": "if(n_any > 1, sqrt(spread / (n_any - 1)), double('NaN'))",
    "auroc": f"case when {_TWO} then cast(wins as double) / (2 * {_PAIRS}) else 0.5D end",
    "aurac": "if(coalesce(p + n, 0) > 0, covered * (0.9D / 19), double('NaN'))",
    "balanced_acc": f"case when {_TWO} then (1D + cast(greatest(j, 0) as double) / {_PAIRS}) / 2 else double('NaN') end",
    "threshold": f"case when not ({_TWO}) then 0.5D when j > 0 then best.at else double('infinity') end",
    "n_samples": "coalesce(n_any, 0L)",
    "n_ranked": "coalesce(p + n, 0L)",
    "n_wrong": "coalesce(p, 0L)",
}
_AT_THRESHOLD = "if(w_rows > 0 and r_rows > 0, (caught / w_rows + passed / r_rows) / 2, null)"


def detection_table(
    df: DataFrame,
    keys: list[str] | None = None,
    unc: str = "unc",
    ok: str = "ok",
    metrics: list[str] | None = None,
    at: float | str | None = None,
    times: str | None = None,
) -> DataFrame:
    """One row per group with the named metrics; the source is read once for all of them. A row counts ``times`` times.

    With ``at``, ``balanced_acc`` is taken at that threshold (a number, or SQL over the keys), over
    all rows, and null for one class.
    """
    keys = keys or []
    names = metrics or list(_FINISHED)
    finished = _FINISHED if at is None else _FINISHED | {"balanced_acc": _AT_THRESHOLD}
    return (
        ranked_cells(df, keys, unc, ok, times)
        .groupBy(*keys)
        .agg(*_metric_columns("threshold" in names, f"double('{at}')" if isinstance(at, float | int) else at))
        .selectExpr(*keys, *[f"{finished[m]} as {m}" for m in names])
    )


def detection_summary(df, keys=None, unc="unc", ok="ok") -> DataFrame:
    """mean, std, auroc, aurac, balanced_acc per group."""
    return detection_table(df, keys, unc, ok, ["mean", "std", "auroc", "aurac", "balanced_acc"])


def score_summary(df: DataFrame, keys: list[str] | None = None, unc: str = "unc") -> DataFrame:
    """Mean and sample deviation of all non-null scores; NaN where undefined."""
    x = F.col(unc).cast("double")
    return df.groupBy(*(keys or [])).agg(
        F.coalesce(F.avg(x), F.lit(NAN)).alias("mean"),
        F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(NAN).alias("std"),
    )


def auroc(df, keys=None, unc="unc", ok="ok") -> DataFrame:
    return detection_table(df, keys, unc, ok, ["auroc"])


def aurac(df, keys=None, unc="unc", ok="ok") -> DataFrame:
    return detection_table(df, keys, unc, ok, ["aurac"])


def youden_threshold(df, keys=None, unc="unc", ok="ok") -> DataFrame:
    return detection_table(df, keys, unc, ok, ["threshold"])


def balanced_acc_youden(df, keys=None, unc="unc", ok="ok") -> DataFrame:
    return detection_table(df, keys, unc, ok, ["balanced_acc"])


def roc_curve(df: DataFrame, keys: list[str] | None = None, unc="unc", ok="ok") -> DataFrame:
    """One point per distinct finite score, plus the origin at +inf, per group."""
    keys = keys or []
    cells = ranked_cells(df, keys, unc, ok)
    # the highest cell of each group also opens its curve at the origin
    points = (
        f"explode(if({_CAUGHT} = n_wrong and {_ALARMS} = n_right,"
        f" array(struct(score as threshold, {_CAUGHT} as tp, {_ALARMS} as fp), struct(double('infinity') as threshold, 0L as tp, 0L as fp)),"
        f" array(struct(score as threshold, {_CAUGHT} as tp, {_ALARMS} as fp)))) as pt"
    )
    return (
        cells.filter(_SEEN)
        .selectExpr(*keys, points, "all_wrong", "all_right")
        .selectExpr(
            *keys,
            "pt.threshold",
            "pt.tp",
            "pt.fp",
            "if(all_wrong > 0, pt.tp / all_wrong, double('NaN')) as tpr",
            "if(all_right > 0, pt.fp / all_right, double('NaN')) as fpr",
        )
    )


def accuracy_at_quantile(
    df: DataFrame, quantile: str | float, keys: list[str] | None = None, unc="unc", ok="ok"
) -> DataFrame:
    """Mean accuracy of the rows at or below the linearly interpolated score quantile.

    The cut keeps exactly the ties of rank floor(q(n-1)), so ranks replace the interpolation.
    """
    keys = keys or []
    q = Decimal(str(quantile))
    rank = f"floor({q}BD * ({_exact(f'{_N} - 1')}))"
    holds = f"{_SEEN} and {_UPTO} > {rank} and {_UPTO} - n_wrong - n_right <= {rank}"
    return (
        ranked_cells(df, keys, unc, ok)
        .groupBy(*keys)
        .agg(F.expr(f"coalesce(max(if({holds}, cum_right / ({_UPTO}), null)), double('NaN')) as accuracy"))
    )


def class_counts(df: DataFrame, keys: list[str] | None = None, ok: str = "ok") -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col(ok)).alias("n_correct"),
        F.count_if(~F.col(ok)).alias("n_incorrect"),
    )


def label_distribution(df: DataFrame, keys: list[str] | None = None, label: str = "label") -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.count_if(F.col(label) == 0).alias("n_zero"),
        F.count_if(F.col(label) == 1).alias("n_one"),
    )


def pseudo_ok(label: Column) -> Column:
    """Stand-in correctness from a training label: its integer part is zero."""
    return label.cast("int") == 0


def flag_at_threshold(unc: Column, threshold: Column) -> Column:
    return unc >= threshold
