import random

import pytest
from models import patience

from doubtscope.streaming.patience import run_to_table, stream_patience

DDL = "seq bigint, pos bigint, score double, is_last boolean, at timestamp"


def _run(spark, root, batches, **how):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{root}/in/b{i:03d}")
        stream = spark.readStream.schema(DDL).parquet(f"{root}/in/*")
        run_to_table(stream_patience(stream, 3, 5, **how), f"{root}/out", f"{root}/ck")
    return {r["seq"]: r for r in spark.read.parquet(f"{root}/out").collect()}


def test_out_of_order_tokens_over_several_batches(spark, root):
    rng = random.Random(0)
    seqs = {s: [float(rng.randint(0, 9)) for _ in range(rng.randint(1, 40))] for s in range(12)}
    rows = [(s, p, x, p == len(v) - 1, None) for s, v in seqs.items() for p, x in enumerate(v)]
    rng.shuffle(rows)
    got = _run(spark, root, [rows[i::3] for i in range(3)])
    assert len(got) == 12
    for s, v in seqs.items():
        mean, tau, trig = patience(v, 3, 5)
        assert got[s]["mean"] == pytest.approx(mean) and (got[s]["tau"], got[s]["triggered"]) == (tau, trig)


def test_late_and_repeated_tokens_are_ignored(spark, root):
    first = [(1, p, 5.0, False, None) for p in range(10)]  # three fill the heap, five idle: halt at 8
    late = [(1, p, 99.0, p == 12, None) for p in (2, 9, 10, 11, 12)]
    got = _run(spark, root, [first, late])
    assert (got[1]["tau"], got[1]["triggered"], got[1]["mean"]) == (8, True, 5.0)


def test_watermark_closes_an_answer_without_end(spark, root):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    open_ = [(1, 0, 4.0, False, t0), (1, 2, 6.0, False, t0)]  # position 1 never comes
    later = [(2, 0, 1.0, True, t0 + dt.timedelta(hours=2))]
    last = [(3, 0, 1.0, True, t0 + dt.timedelta(hours=4))]
    got = _run(spark, root, [open_, later, last], event_time="at", delay="1 minute", delay_ms=60_000)
    assert (got[1]["mean"], got[1]["tau"], got[1]["triggered"]) == (5.0, 2, False)


def test_missing_scores_and_nan(spark, root):
    """A null score is no token, NaN is one; both in order and packed over batches."""
    nan = float("nan")
    v = [3.0, None, 4.0, 8.0, nan, 2.0, None, 0.0, nan, 0.0, 9.0]
    rows = [(1, p, x, p == len(v) - 1, None) for p, x in enumerate(v)]
    got = _run(spark, root, [rows[6:], rows[:6]])
    mean, tau, stop = patience([x for x in v if x is not None], 3, 5)
    assert (got[1]["tau"], got[1]["triggered"]) == (tau, stop) and got[1]["mean"] == mean == 5.0


def test_a_long_answer_over_two_batches(spark, root):
    rising = [(7, p, float(p), p == 99_999, None) for p in range(100_000)]
    got = _run(spark, root, [rising[50_000:], rising[:50_000]])
    assert (got[7]["tau"], got[7]["triggered"], got[7]["mean"]) == (100_000, False, 99_998.0)
