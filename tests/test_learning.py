import numpy as np
import pytest
from pyspark.sql import functions as F

from doubtscope.operators import network as net
from doubtscope.operators import selection as sel
from doubtscope.operators import training as tr
from doubtscope.operators.pooling import pool_tokens
from doubtscope.operators.scoring import answer_fields, batch_embedder, batch_score, embed_prompts

DIM = 8


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, DIM)).astype(np.float32)
    y = 1 / (1 + np.exp(-x[:, 0].astype(float) - 0.5 * x[:, 1]))
    return x, y


@pytest.fixture(scope="module")
def frame(spark, rows):
    x, y = rows
    data = [(i, [float(v) for v in x[i]], float(y[i]), bool(y[i] < 0.5)) for i in range(len(x))]
    return spark.createDataFrame(data, "row_id bigint, embedding array<float>, y double, ok boolean")


@pytest.mark.parametrize("kind", net.LOSSES)
def test_gradient_equals_finite_differences(rows, kind):
    x, y = rows[0][:20].astype(float), rows[1][:20]
    flat = net.init_weights(DIM, 1)
    keep = (np.random.default_rng(2).random((20, net.hidden_size(DIM))) > 0.3) / 0.7
    slope = lambda p: net.loss_and_slope(kind, 0.5, p, y)
    _, grad = net.backprop(flat, x, slope, keep)
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        diff = (net.backprop(flat + step, x, slope, keep)[0] - net.backprop(flat - step, x, slope, keep)[0]) / 2e-5
        assert grad[i] == pytest.approx(diff, abs=1e-6)


def test_rank_loss_corner_cases():
    assert net.loss_and_slope("rank", 0.5, np.array([1.0]), np.array([1.0]))[0] == 0.0
    assert net.loss_and_slope("rank", 0.5, np.array([1.0, 2.0]), np.array([1.0, 1.0]))[0] == 0.0
    loss, _ = net.loss_and_slope("rank", 0.5, np.array([0.0, 0.0]), np.array([0.0, 1.0]))
    assert loss == pytest.approx(np.log(2))
    with pytest.raises(ValueError):
        tr.Run(0, loss="other")


def test_one_part_is_sequential_training(spark, frame, rows):
    """With one part the distributed job equals the same loop run here."""
    x, y = rows[0].astype(float), rows[1]
    run = tr.Run(0, lr=1e-2, dropout=0.2, batch_size=32, seed=5)
    got = tr.train_runs(frame, None, [run], epochs=3, mode="averaged", parts=1).weights[0]
    flat = net.init_weights(DIM, run.seed)
    state = (flat, np.zeros_like(flat), np.zeros_like(flat), 0)
    for epoch in range(3):
        flat, adam, *_ = tr._train_part(0, x, y, run, state, epoch, 3 * 8)
        state = (flat, adam.m, adam.v, adam.steps)
    np.testing.assert_allclose(got, flat, rtol=1e-9, atol=1e-12)


def test_epochs_between_averages_are_ordinary_epochs(frame):
    run = tr.Run(0, lr=1e-2, dropout=0.2, batch_size=32, seed=5)
    each = tr.train_runs(frame, None, [run], epochs=5, mode="averaged", parts=1)
    once = tr.train_runs(frame, frame, [run], epochs=5, mode="averaged", parts=1, sync_epochs=3, val_steps=30)
    assert [h["step"] for h in once.history] == [24, 30, 40] and [h["step"] for h in each.history] == [8, 16, 24, 32, 40]
    last = tr.train_runs(frame, None, [run], epochs=5, mode="averaged", parts=1, sync_epochs=4).weights[0]
    np.testing.assert_allclose(each.weights[0], last, rtol=1e-9, atol=1e-12)


def test_training_is_repeatable_and_independent_of_layout(frame):
    runs = [tr.Run(i, lr=1e-2, dropout=0.1, batch_size=16, seed=i) for i in range(2)]
    a = tr.train_runs(frame, None, runs, epochs=2, mode="averaged", parts=3).weights
    b = tr.train_runs(frame.repartition(7), None, runs, epochs=2, mode="averaged", parts=3).weights
    alone = tr.train_runs(frame, None, runs[1:], epochs=2, mode="averaged", parts=3).weights
    np.testing.assert_allclose(a[0], b[0], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(a[1], alone[1], rtol=1e-9, atol=1e-12)


def test_exact_training_does_not_depend_on_partitions(frame):
    runs = [tr.Run(0, lr=1e-2, dropout=0.2, batch_size=64, seed=3), tr.Run(1, lr=3e-3, dropout=0.0, batch_size=10**6)]
    a = tr.train_runs(frame.repartition(1), None, runs, epochs=2).weights
    b = tr.train_runs(frame.repartition(9, "y"), None, runs, epochs=2).weights
    for k in (0, 1):
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=1e-12)


def plain_steps(x, y, run, epochs):
    """The same mini-batches, dropout and steps in one loop over the whole table."""
    flat, n = net.init_weights(x.shape[1], run.seed), len(x)
    adam, per_epoch, ids = net.Adam(np.zeros_like(flat), np.zeros_like(flat)), -(-n // run.batch_size), np.arange(n)
    for step in range(per_epoch * epochs):
        epoch, k = divmod(step, per_epoch)
        place = tr.places(ids, n, run.seed, epoch)
        mine = np.flatnonzero(place // run.batch_size == k)
        keep = tr._dropout(tr._row_keys(ids[mine], run.seed, epoch), step, net.hidden_size(x.shape[1]), run.dropout)
        _, grad = net.backprop(flat, x[mine], lambda p, t=y[mine]: net.loss_and_slope(run.loss, run.rank_lambda, p, t), keep)
        flat = adam.update(flat, grad, run.lr * tr._rate(step, per_epoch * epochs), run.weight_decay)
    return flat


def test_exact_mini_batches_equal_a_plain_loop(frame, rows):
    runs = [tr.Run(k, lr=1e-2 / (k + 1), dropout=0.3 if k < 3 else 0.0, batch_size=(64, 100, 240)[k % 3], seed=7 + k, loss=net.LOSSES[k % 3]) for k in range(5)]
    got = tr.train_runs(frame.repartition(5), None, runs, epochs=3).weights
    for r in runs:
        np.testing.assert_allclose(got[r.run_id], plain_steps(rows[0].astype(float), rows[1], r, 3), rtol=1e-7, atol=1e-10)


def test_an_epoch_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        whole = tr.places(np.arange(n), n, 3, 1)
        assert sorted(whole) == list(range(n))
        assert (tr.places(np.arange(n)[n // 2 :], n, 3, 1) == whole[n // 2 :]).all()
    assert (tr.places(np.arange(1000), 1000, 3, 2) != tr.places(np.arange(1000), 1000, 3, 1)).mean() > 0.9


def test_pairs_of_a_batch_may_span_tasks(rows):
    rng = np.random.default_rng(4)
    pred, target = rng.normal(size=5000), np.round(rng.normal(size=5000), 1)
    loss, slope, count = net.pair_loss(pred, target)
    parts = [tr.pair_slope(pred[a:b], target[a:b], pred, target) for a, b in ((0, 7), (7, 7), (7, 3000), (3000, 5000))]
    assert sum(p[2] for p in parts) == count and sum(p[0] for p in parts) == pytest.approx(loss)
    np.testing.assert_allclose(np.concatenate([p[1] for p in parts]), slope, rtol=1e-9, atol=1e-9)


def test_exact_full_batch_equals_local_steps(frame, rows):
    x, y = rows[0].astype(float), rows[1]
    run = tr.Run(0, lr=1e-2, dropout=0.0, batch_size=240)
    got = tr.train_runs(frame, None, [run], epochs=4).weights[0]
    flat = net.init_weights(DIM, 0)
    adam = net.Adam(np.zeros_like(flat), np.zeros_like(flat))
    for step in range(4):
        _, grad = net.backprop(flat, x, lambda p: net.loss_and_slope("mse", 0.5, p, y))
        flat = adam.update(flat, grad, run.lr * tr._rate(step, 4), run.weight_decay)
    np.testing.assert_allclose(got, flat, rtol=1e-9, atol=1e-12)


def test_validation_comes_every_val_steps(frame):
    run = tr.Run(0, lr=1e-2, dropout=0.1, batch_size=8)  # 30 steps an epoch
    done = tr.train_runs(frame, frame, [run], epochs=3, val_steps=12, mode="averaged", parts=1)
    assert [h["step"] for h in done.history if h["val_auroc"] is not None][:5] == [12, 24, 36, 48, 60]
    whole = tr.train_runs(frame, None, [run], epochs=3, mode="averaged", parts=1).weights[0]
    cut = tr.train_runs(frame, frame.limit(0), [run], epochs=3, val_steps=7, mode="averaged", parts=1)
    assert cut.history[-1]["step"] == 90 and len({h["step"] for h in cut.history}) > 12
    rows = frame.orderBy("row_id").limit(5)  # one class only: AUROC 0.5 throughout, so training stops early
    one = tr.train_runs(frame, rows.withColumn("ok", F.lit(True)), [run], epochs=20, val_steps=10, mode="averaged", parts=1)
    assert one.history[-1]["step"] == 70  # the first validation is the best; 60 idle steps are 10 % of 600
    assert np.isfinite(whole).all()


def test_modes_are_checked(frame):
    for how in ({"mode": "averaged"}, {"parts": 2}, {"mode": "other"}):
        with pytest.raises(ValueError):
            tr.train_runs(frame, None, [tr.Run(0)], epochs=1, **how)


def test_loss_falls_and_scorer_learns(frame):
    done = tr.train_runs(frame, frame, [tr.Run(0, lr=2e-2, dropout=0.0, batch_size=16)], epochs=12, val_steps=40, mode="averaged", parts=2)
    losses = [h["loss"] for h in done.history]
    assert losses[-1] < losses[0] / 2
    assert done.best_val[0]["auroc"] > 0.9


def test_grid_has_nine_runs_in_order():
    runs = tr.grid_runs()
    assert [(r.lr, r.batch_size) for r in runs] == [(lr, b) for lr in (3e-3, 1e-3, 3e-4) for b in (64, 128, 256)]
    assert {r.dropout for r in runs} == {0.3} and len({r.seed for r in runs}) == 9
    assert [r.seed for r in tr.seed_runs(runs[0])] == [0, 1, 2, 3, 4]


def test_weights_table_round_trip(spark):
    w = {0: net.init_weights(DIM, 0), 3: net.init_weights(DIM, 1)}
    back = tr.read_weights(tr.weights_table(spark, w))
    assert all((back[k] == w[k]).all() for k in w)


def test_gradient_job_equals_local_sum(frame, rows):
    x, y = rows[0].astype(float), rows[1]
    flat = net.init_weights(DIM, 3)
    r = net.grad_partial(frame.repartition(5), flat).first()
    _, want = net.backprop(flat, x, lambda p: (0.0, 2 * (p - y)))
    np.testing.assert_allclose(r["grad"], want, rtol=1e-9, atol=1e-9)
    assert r["n"] == 240 and r["loss"] == pytest.approx(((net.predict(flat, x) - y) ** 2).sum())


def test_best_run_rules(spark):
    ddl = "path string, auroc double"
    rows = [("c", 0.7), ("b", 0.9), ("a", float("nan")), ("d", 0.9), ("e", None)]
    assert sel.best_run(spark.createDataFrame(rows, ddl)).first()["path"] == "b"
    assert sel.best_run(spark.createDataFrame([("a", None), ("b", float("nan"))], ddl)).count() == 0


def test_early_stop_model(spark):
    rng = np.random.default_rng(0)
    pts = [(k, (i + 1) * 10, float(rng.integers(0, 6)) / 10) for k in range(3) for i in range(40)]
    got = sel.early_stop(spark.createDataFrame(pts, "run int, step bigint, auroc double"), 400, 10, ["run"]).collect()
    for k in range(3):
        best, idle, stop = -1.0, 0, None
        for _, step, a in [p for p in pts if p[0] == k]:
            better = a > best
            best, idle = (a, 0) if better else (best, idle + 10)
            row = next(r for r in got if r["run"] == k and r["step"] == step)
            assert (row["better"], row["idle_steps"], row["best_auroc"]) == (better, idle, best)
            if stop is None and idle >= 40 and step > 20:
                stop = step
        assert [r["step"] for r in got if r["run"] == k and r["stop"]] == ([stop] if stop else [])


def test_lr_factor(spark):
    f = [r[0] for r in spark.range(100).select(sel.lr_factor(F.col("id"), 100)).collect()]
    assert f[0] == 0.0 and f[5] == 1.0 and f[1] == pytest.approx(0.2) and f[99] < 0.01
    assert [tr._rate(i, 100) for i in range(100)] == pytest.approx(f)


def test_pooling(spark):
    ddl = "seq int, pos int, vec array<float>, valid boolean"
    df = spark.createDataFrame([(0, 0, [1.0, 3.0], True), (0, 1, [3.0, 5.0], True), (0, 2, [9.0, 9.0], False), (1, 0, [4.0, 4.0], False)], ddl)
    assert {r["seq"]: r["embedding"] for r in pool_tokens(df).collect()} == {0: [2.0, 4.0], 1: [0.0, 0.0]}
    assert {r["seq"]: r["embedding"] for r in pool_tokens(df, "last").collect()} == {0: [3.0, 5.0]}
    with pytest.raises(ValueError):
        pool_tokens(df, "max")


def test_predictor_and_embedder_callables(spark):
    df = spark.createDataFrame([(i, [("user", f"q{i}")], None) for i in range(7)],
                               "row_id bigint, prompt array<struct<role:string,content:string>>, label string")
    scored = answer_fields(batch_score(df, lambda texts: [[(f" {t} ", [])] for t in texts], batch_size=3))
    assert sorted(r["answer"] for r in scored.collect()) == [f"q{i}" for i in range(7)]
    assert scored.filter("answer_token_index is null").count() == 7
    emb = embed_prompts(df, batch_embedder(lambda texts: np.array([[len(t), 1.0] for t in texts]), 2)).collect()
    assert all(r["embedding"] == [2.0, 1.0] and r["label"] == "" for r in emb)
