import hashlib

import numpy as np
import pytest
from models import aurac, auroc, youden
from pyspark.sql import functions as F

from doubtscope.functions import mixing
from doubtscope.operators import metrics as mt
from doubtscope.operators import resample as rs
from doubtscope.operators.prefix import dense_index, running_totals

DDL = "g int, unc double, ok boolean"


def table_of(df, keys=None):
    return mt.detection_table(df, keys)


def random_frame(n, seed, levels):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 3)), float(rng.integers(0, levels)) / 4, bool(rng.random() < 0.7)) for _ in range(n)]


@pytest.mark.parametrize("n,levels", [(2, 3), (60, 5), (700, 40), (700, 10**6)])
def test_against_models(spark, n, levels):
    rows = random_frame(n, n + levels, levels)
    df = spark.createDataFrame(rows, DDL)
    for r in table_of(df, ["g"]).collect():
        unc = np.array([u for g, u, _ in rows if g == r["g"]])
        ok = np.array([o for g, _, o in rows if g == r["g"]])
        at, bal = youden(unc, ok)
        assert r["auroc"] == pytest.approx(auroc(unc, ok))
        assert r["aurac"] == pytest.approx(aurac(unc, ok))
        assert r["balanced_acc"] == pytest.approx(bal, nan_ok=True)
        assert r["threshold"] == pytest.approx(at)
        assert r["mean"] == pytest.approx(unc.mean())
        assert r["std"] == pytest.approx(unc.std(ddof=1) if len(unc) > 1 else np.nan, nan_ok=True)


def test_one_hot_group(spark):
    """A group with nearly all rows and few distinct scores beside many small groups."""
    rng = np.random.default_rng(1)
    rows = [(0, float(rng.integers(0, 2000)), bool(rng.random() < 0.5)) for _ in range(20000)]
    rows += [(i, float(rng.random()), bool(i % 2)) for i in range(1, 200)]
    got = {r["g"]: r for r in table_of(spark.createDataFrame(rows, DDL), ["g"]).collect()}
    unc = np.array([u for g, u, _ in rows if g == 0])
    ok = np.array([o for g, _, o in rows if g == 0])
    assert len(got) == 200
    assert got[0]["auroc"] == pytest.approx(auroc(unc, ok)) and got[0]["aurac"] == pytest.approx(aurac(unc, ok))


def test_special_values(spark):
    rows = [(0, None, True), (0, 1.0, True), (0, 2.0, False), (1, float("nan"), True), (1, 1.0, False), (2, None, True),
            (3, float("inf"), False), (3, 5.0, True), (None, 1.0, True), (None, 3.0, False)]
    got = {r["g"]: r for r in table_of(spark.createDataFrame(rows, DDL), ["g"]).collect()}
    assert got[0]["mean"] == 1.5 and got[0]["auroc"] == 1.0 and got[0]["n_samples"] == 2
    assert np.isnan(got[1]["mean"]) and got[1]["auroc"] == 0.5 and got[1]["threshold"] == 0.5
    assert np.isnan(got[2]["mean"]) and np.isnan(got[2]["aurac"]) and got[2]["auroc"] == 0.5
    assert got[3]["mean"] == float("inf") and got[3]["n_ranked"] == 1
    assert got[None]["auroc"] == 1.0  # a null key is a group


def test_empty_input_gives_one_row(spark):
    r = table_of(spark.createDataFrame([], DDL)).collect()
    assert len(r) == 1 and np.isnan(r[0]["mean"]) and r[0]["auroc"] == 0.5 and np.isnan(r[0]["balanced_acc"])


def test_hand_auroc_and_all_correct(spark):
    rows = [(0, s, False) for s in (0.35, 0.8, 0.4)] + [(0, s, True) for s in (0.1, 0.4)]
    assert table_of(spark.createDataFrame(rows, DDL)).first()["auroc"] == 0.75
    right = spark.createDataFrame([(0, float(i), True) for i in range(7)], DDL)
    assert table_of(right).first()["aurac"] == pytest.approx(0.9473684210526315)


def test_invariants(spark):
    df = spark.createDataFrame(random_frame(400, 9, 50), DDL)
    a = table_of(df).first()
    assert table_of(df.withColumn("unc", -F.col("unc"))).first()["auroc"] == pytest.approx(1 - a["auroc"])
    assert table_of(df.withColumn("unc", F.exp("unc"))).first()["auroc"] == pytest.approx(a["auroc"])
    assert table_of(df.repartition(13)).first()["aurac"] == pytest.approx(a["aurac"], abs=1e-12)


def test_accuracy_at_quantile(spark):
    rows = random_frame(300, 4, 30)
    unc, ok = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for q in ("0.1", "0.5", "1"):
        got = mt.accuracy_at_quantile(spark.createDataFrame(rows, DDL), q).first()["accuracy"]
        assert got == pytest.approx(ok[unc <= np.quantile(unc, float(q))].mean())


def test_accuracy_at_quantile_by_group(spark):
    """Ties at the cut stay in; null, NaN and infinite scores take no part; a null key is a group."""
    rows = [(0, 1.0, True), (0, 2.0, False), (0, 2.0, True), (0, 9.0, False), (0, None, False), (0, float("inf"), True),
            (1, float("nan"), True), (None, 3.0, False), (None, 4.0, True)]
    got = {r["g"]: r["accuracy"] for r in mt.accuracy_at_quantile(spark.createDataFrame(rows, DDL), "0.5", ["g"]).collect()}
    assert got[0] == pytest.approx(2 / 3) and np.isnan(got[1]) and got[None] == 0.0


def _records_read(spark):
    store, gw = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gw.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).inputRecords() for i in range(stages.size())}


@pytest.mark.parametrize("names", [None, ["auroc"], ["mean", "std"], ["threshold"], ["aurac", "n_samples"]])
def test_source_is_scanned_once(spark, sf_dir, names):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 3).alias("g"), F.col("value").alias("unc"), (F.col("event_type") != "error").alias("ok")
    )
    before = _records_read(spark)
    mt.detection_table(df, ["g"], metrics=names).collect()
    read = sum(n for stage, n in _records_read(spark).items() if stage not in before)
    assert read == 1000


@pytest.mark.parametrize("curve", [mt.roc_curve, lambda d, k: mt.accuracy_at_quantile(d, "0.5", k)])
def test_curves_scan_once(spark, sf_dir, curve):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 3).alias("g"), F.col("value").alias("unc"), (F.col("event_type") != "error").alias("ok")
    )
    before = _records_read(spark)
    curve(df, ["g"]).collect()
    assert sum(n for stage, n in _records_read(spark).items() if stage not in before) == 1000


def test_running_totals_and_index(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(x), int(v)) for x, (k, v) in enumerate(rng.integers(0, 4, (500, 2)))]
    got = running_totals(spark.createDataFrame(rows, "k int, x bigint, v bigint"), ["k"], "x", {"v": "v"}, maxima={"w": "v"}).collect()
    for r in got:
        seen = [v for k, x, v in rows if k == r["k"] and x <= r["x"]]
        assert r["cum_v"] == sum(seen) and r["top_w"] == max(seen)
        assert r["all_v"] == sum(v for k, _, v in rows if k == r["k"])
    idx = dense_index(spark.range(0, 3000, 3).withColumnRenamed("id", "x"), "x").collect()
    assert sorted((r["x"] // 3, r["row_id"]) for r in idx) == [(i, i) for i in range(1000)]


def test_bootstrap_edges(spark):
    ddl = "row_id bigint, unc double, ok boolean"
    single = spark.createDataFrame([(0, 1.0, True)], ddl)
    assert all(np.isnan(r["mean"]) for r in rs.bootstrap_metrics(single, "row_id", n_resamples=5).collect())
    one_class = spark.createDataFrame([(i, float(i), True) for i in range(9)], ddl)
    rows = rs.bootstrap_ci(one_class, "row_id", n_resamples=5).collect()
    assert sorted(r["metric"] for r in rows) == sorted(rs.METRICS) and all(np.isnan(r["ci_low"]) for r in rows)


def test_bootstrap_is_repeatable_and_sound(spark):
    rng = np.random.default_rng(5)
    ok = rng.random(300) < 0.6
    unc = np.where(ok, rng.normal(0, 1, 300), rng.normal(1, 1, 300)).round(3)
    df = spark.createDataFrame([(i, float(unc[i]), bool(ok[i])) for i in range(300)], "row_id bigint, unc double, ok boolean")
    a = {r["metric"]: r for r in rs.bootstrap_ci(df, "row_id", n_resamples=200, seed=3).collect()}
    b = {r["metric"]: r for r in rs.bootstrap_ci(df.repartition(7), "row_id", n_resamples=200, seed=3).collect()}
    assert a == b
    assert a["auroc"]["ci_low"] < auroc(unc, ok) < a["auroc"]["ci_high"]
    assert a["auroc"]["mean"] == pytest.approx(auroc(unc, ok), abs=0.02)


def test_a_threshold_costs_no_second_draw(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 3 > 0) for i in range(40)], "row_id bigint, unc double, ok boolean")

    def draws(threshold):
        plan = rs.resample_metrics(df, "row_id", n_resamples=5, threshold=threshold, method="draws")._jdf.queryExecution().optimizedPlan()
        return plan.toString().count("Range (")

    assert draws(3.0) == draws(None) > 0


def test_runs_resampled_together_equal_runs_alone(spark):
    rows = [(i, r, float((i * (5 + r)) % 11), i % 3 > 0) for i in range(60) for r in (0, 1)]
    df = spark.createDataFrame(rows, "row_id bigint, run_id int, unc double, ok boolean")
    together = rs.bootstrap_runs_ci(df, "row_id", {0: 4, 1: 9}, {0: 5.0, 1: float("inf")}, 40, "draws").collect()
    for run, seed, cut in ((0, 4, 5.0), (1, 9, float("inf"))):
        alone = rs.bootstrap_ci(df.filter(f"run_id = {run}"), "row_id", n_resamples=40, seed=seed, threshold=cut, method="draws").collect()
        assert sorted(tuple(r)[1:] for r in together if r["run_id"] == run) == sorted(map(tuple, alone))


def test_running_floor_of_long_answers_is_quick(spark):
    import time

    from doubtscope.functions.tokens import running_floor

    scores = F.transform(F.sequence(F.lit(1), F.lit(16_000)), lambda i: F.pmod(F.xxhash64(i), F.lit(10**6)).cast("double"))
    start = time.time()
    spark.range(8).select(running_floor(scores)).write.format("noop").mode("overwrite").save()
    assert time.time() - start < 15


@pytest.mark.parametrize("prefix", ["0:0:", "7:999:", "-12:3:", "123456789:12:", "a", "-9223372036854775808:1000000:"])
def test_digests_of_arrays_equal_hashlib(prefix):
    """Where the number of digits grows, at the ends of a step and across words of the message."""
    n = mixing.STEP * 4 + 7
    got = np.concatenate(list(mixing.digest_ints(prefix, n)))
    assert len(got) == n
    for i in [*range(1200), *range(9990, 10010), *range(24990, 25010), *range(99990, n)]:
        assert int(got[i]) == int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:15], 16)
    for low in (35_975_000, 10**9, 10**12):
        a, b = mixing._digested(mixing._message(prefix.encode(), low, low + 2), 2)
        assert a[:1].tobytes() + b[:1].tobytes() == hashlib.md5(f"{prefix}{low}".encode()).digest()[:8]


def test_draws_of_arrays_equal_the_column(spark):
    drawn = [r["row_index"] for r in rs.resample_draws(spark, 300, 2, 5).collect()]
    assert drawn == [int(x) for b in (0, 1) for x in np.concatenate(list(rs.drawn_rows(300, 5, b)))]


def test_split_draws_are_multinomial():
    """Counts per range against the multinomial they must follow: chi-square of the sums, variances and covariances."""
    weights, n, resamples = np.array([5, 0, 40, 1, 20, 9, 25]), 100, 4000
    drawn = np.stack([rs.draws_in_range(weights, k, np.full(resamples, n), 7, 2)[1] for k in range(7)])
    below = np.stack([rs.draws_in_range(weights, k, np.full(resamples, n), 7, 2)[0] for k in range(7)])
    assert (drawn.sum(axis=0) == n).all() and (below[1:] == np.cumsum(drawn, axis=0)[:-1]).all() and not drawn[1].any()
    share = weights / weights.sum()
    seen = share > 0
    chi = ((drawn.sum(axis=1) - n * resamples * share)[seen] ** 2 / (n * resamples * share[seen])).sum()
    assert chi < 20.5  # 99.9 % of a chi-square of 5 degrees
    spread = np.cov(drawn)
    want = n * (np.diag(share) - np.outer(share, share))
    assert np.abs(spread - want).max() < 0.06 * n * share.max()


def test_range_metrics_add_up_to_the_plain_metrics():
    rng = np.random.default_rng(2)
    score = np.sort(rng.choice(np.arange(60) / 7, 40, replace=False))
    wrong, right = rng.integers(0, 4, (25, 40)), rng.integers(0, 5, (25, 40))
    p, n = wrong.sum(axis=1), right.sum(axis=1)
    parts = []
    for a, b in ((0, 3), (3, 17), (17, 18), (18, 40)):
        below = wrong[:, :a].sum(axis=1), right[:, :a].sum(axis=1)
        parts.append(rs.range_metrics(score[a:b], wrong[:, a:b], right[:, a:b], *below, p, n, 4.0))
    for r in range(25):
        unc = np.repeat(np.r_[score, score], np.r_[wrong[r], right[r]])
        ok = np.repeat([False, True], [p[r], n[r]])
        total = {k: sum(x[k][r] for x in parts) for k in parts[0]}
        assert total["wins"] / (2 * p[r] * n[r]) == pytest.approx(auroc(unc, ok))
        assert total["covered"] * 0.9 / 19 == pytest.approx(aurac(unc, ok))
        j = max(x["j"][r] for x in parts)
        assert (1 + max(j, 0) / (p[r] * n[r])) / 2 == pytest.approx(youden(unc, ok)[1])
        assert (total["caught"], total["passed"]) == (((unc >= 4.0) & ~ok).sum(), ((unc < 4.0) & ok).sum())


@pytest.mark.parametrize("ties", [True, False])
def test_split_and_drawn_bootstrap_agree(spark, ties):
    rng = np.random.default_rng(5)
    x = rng.normal(size=600)
    rows = [(i, float(np.round(v, 1) if ties else v), bool(v + rng.normal() < 0.4)) for i, v in enumerate(x)]
    rows += [(600, float("nan"), True), (601, None, False), (602, float("inf"), False), (603, float("-inf"), True)]
    df = spark.createDataFrame(rows, "row_id bigint, unc double, ok boolean")
    for cut in (None, 0.3):
        a, b = (
            {r["metric"]: r for r in rs.bootstrap_ci(df, "row_id", n_resamples=800, seed=4, threshold=cut, method=m).collect()} for m in ("split", "draws")
        )
        for m in rs.METRICS:
            assert a[m]["mean"] == pytest.approx(b[m]["mean"], abs=4 * b[m]["std"] / 800**0.5 * 2**0.5 + 0.001)
            assert a[m]["std"] == pytest.approx(b[m]["std"], rel=0.15, abs=0.002)
            assert a[m]["ci_low"] == pytest.approx(b[m]["ci_low"], abs=0.5 * b[m]["std"] + 0.001)
    with pytest.raises(ValueError):
        rs.bootstrap_ci(df, "row_id", method="other")
