import math
import random

import pytest
from models import patience
from pyspark.sql import functions as F

from doubtscope.functions import tokens as tok
from doubtscope.operators import longform
from doubtscope.operators.longform import patience_long

SEQ = "q array<array<struct<logit:double>>>"


def one(spark, value, expr, ddl="x array<double>"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "scores,m,w,expected",
    [
        ([5, 4, 3, 1, 1, 9], 3, 2, (4.0, 5, True)),
        ([2, 2, 2, 2], 2, 2, (2.0, 4, True)),
        ([7], 5, 20, (7.0, 1, False)),
        ([1, 2, 3], 1, 1, (3.0, 3, False)),
        ([], 5, 20, (None, 0, False)),
    ],
)
def test_patience_hand_cases(spark, scores, m, w, expected):
    r = one(spark, [float(s) for s in scores], tok.patience_agg(F.col("x"), m, w))
    assert (r["mean"], r["tau"], r["triggered"]) == expected


def test_patience_refuses_zero_sizes():
    with pytest.raises(ValueError):
        tok.patience_agg(F.lit(None), 0, 1)
    with pytest.raises(ValueError):
        tok.patience_agg(F.lit(None), 1, 0)


def test_nan_score_never_updates_a_full_heap(spark):
    r = one(spark, [3.0, 2.0, math.nan, math.nan], tok.patience_agg(F.col("x"), 2, 2))
    assert (r["mean"], r["tau"], r["triggered"]) == (2.5, 4, True)


def test_token_norm_and_null_positions(spark):
    seq = [[(3.0,), (-1.0,), (4.0,)], [(-1.0,), (-2.0,)], None, [], [None], [(None,)]]
    assert one(spark, seq, tok.seq_token_scores(F.col("q")), SEQ) == [5.0, 0.0]
    assert one(spark, [None, []], tok.seq_token_scores(F.col("q")), SEQ) is None
    assert one(spark, None, tok.seq_token_scores(F.col("q")), SEQ) is None
    assert one(spark, [None], tok.patience_from_topk(F.col("q")), SEQ) is None
    assert one(spark, [], tok.answer_token_index(F.col("q")), SEQ) is None


def test_topm(spark):
    assert one(spark, [1.0, 5.0, 3.0], tok.topm_mean(F.col("x"), 2)) == 4.0
    assert one(spark, [1.0, 5.0, 3.0], tok.topm_mean(F.col("x"), 0)) == 3.0
    assert one(spark, [1.0, 5.0, 3.0], tok.topm_mean(F.col("x"), 9)) == 3.0
    assert one(spark, [], tok.topm_mean(F.col("x"), 2)) is None


def _random_rows(n=300, seed=0):
    rng = random.Random(seed)
    return [(i, [float(rng.randint(0, 30)) for _ in range(rng.randint(1, 120))]) for i in range(n)]


@pytest.mark.parametrize("m,w", [(5, 20), (3, 4), (1, 1)])
def test_all_patience_forms_equal_the_heap(spark, m, w):
    rows = _random_rows()
    df = spark.createDataFrame(rows, "seq bigint, x array<double>").repartition(5)
    want = {i: patience(s, m, w) for i, s in rows}
    got = {r["seq"]: (r["r"]["mean"], r["r"]["tau"], r["r"]["triggered"])
           for r in df.select("seq", tok.patience_agg(F.col("x"), m, w).alias("r")).collect()}
    # as logits: a lone non-negative logit is its own norm
    as_logits = df.select("seq", F.transform("x", lambda v: F.array(F.struct(v.alias("logit")))).alias("q"))
    fused = {r["seq"]: tuple(r["r"]) for r in as_logits.select("seq", tok.patience_from_topk(F.col("q"), m, w).alias("r")).collect()}
    long = df.select("seq", F.posexplode("x").alias("pos", "score"))
    for block in (7, 64, 4096):
        rowsf = {r["seq"]: (r["mean"], r["tau"], r["triggered"]) for r in patience_long(long, m, w, block).collect()}
        _same(rowsf, want)
    _same(got, want)
    _same(fused, want)


def _same(got, want):
    assert got.keys() == want.keys()
    for k, (mean, tau, trig) in want.items():
        assert got[k][0] == pytest.approx(mean, abs=1e-12) and got[k][1:] == (tau, trig), k


def test_long_form_with_one_hot_sequence(spark):
    """One sequence holds most rows; blocks keep it out of a single task."""
    rng = random.Random(3)
    hot = [rng.random() for _ in range(20000)]
    rising = [float(i) for i in range(5000)]  # every token updates: never halts
    rows = [(0, i, s) for i, s in enumerate(hot)] + [(1, i, s) for i, s in enumerate(rising)]
    got = {r["seq"]: r for r in patience_long(spark.createDataFrame(rows, "seq bigint, pos bigint, score double"), 5, 50, 256).collect()}
    for seq, scores in ((0, hot), (1, rising)):
        mean, tau, trig = patience(scores, 5, 50)
        assert got[seq]["mean"] == pytest.approx(mean) and (got[seq]["tau"], got[seq]["triggered"]) == (tau, trig)


def test_long_patience_equals_topm_when_it_cannot_halt(spark):
    df = spark.createDataFrame(_random_rows(50, 2), "seq bigint, x array<double>")
    r = df.select(tok.patience_agg(F.col("x"), 5, 1000)["mean"].alias("a"), tok.topm_mean(F.col("x"), 5).alias("b")).collect()
    assert all(x["a"] == pytest.approx(x["b"], abs=1e-12) for x in r)


def test_topk_entries_rules(spark):
    ddl = "m array<map<bigint,struct<logprob:double,decoded_token:string,rank:int>>>"
    ranked = {1: (1.0, "a", 2), 2: (3.0, "b", 1), 3: (9.0, "c", 3)}
    unranked = {1: (1.0, "a", None), 2: (3.0, "b", None), 5: (-3.0, "z", 0)}
    r = one(spark, [ranked, unranked, None], tok.topk_entries(F.col("m"), 2), ddl)
    assert [e["token_id"] for e in r[0]] == [2, 1]
    assert [e["token_id"] for e in r[1]] == [2, 1, 5]  # the chosen entry is appended
    assert r[2] is None


def test_long_form_with_odd_scores_and_many_levels(spark, monkeypatch):
    """NaN, infinities, nulls, gaps in position and three levels of summaries, against the fold over arrays."""
    monkeypatch.setattr(longform, "FAN", 3)
    rng = random.Random(8)
    odd = [float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, [rng.choice(odd) if rng.random() < (0.3 if i % 3 else 0.02) else float(rng.randint(0, 9)) for _ in range(rng.randint(1, 150))]) for i in range(120)]
    rows += [(500, [None] * 9), (501, [float("nan")] * 40), (502, [float(i) for i in range(400)])]
    df = spark.createDataFrame(rows, "seq bigint, x array<double>").repartition(4)
    long = df.select("seq", F.posexplode("x").alias("pos", "score")).withColumn("pos", F.expr("pos * 3 + seq % 2"))
    for m, w in ((1, 2), (4, 9)):
        kept = F.filter("x", lambda v: v.isNotNull())
        want = {r["seq"]: tuple(r["r"]) for r in df.select("seq", tok.patience_agg(kept, m, w).alias("r")).collect()}
        got = {r["seq"]: (r["mean"], r["tau"], r["triggered"]) for r in patience_long(long, m, w, 16).collect()}
        assert got.keys() == want.keys()
        for k, (mean, tau, stop) in want.items():
            assert got[k][1:] == (tau, stop) and (got[k][0] == mean or str(got[k][0]) == str(mean) or got[k][0] == pytest.approx(mean)), k


def test_rows_of_the_long_form_stay_short(spark, monkeypatch):
    """A sequence whose every token raises the floor: no stored row holds more than the summaries of a few blocks."""
    sizes = []
    kept = longform.stored

    def watched(df, name):
        out = kept(df, name)
        arrays = [c for c, kind in out.dtypes if kind.startswith("array")]
        sizes.extend(out.agg(*[F.max(F.size(c)) for c in arrays]).first() if arrays else [])
        return out

    monkeypatch.setattr(longform, "stored", watched)
    rising = spark.range(30_000).selectExpr("1L as seq", "id as pos", "cast(id as double) as score")
    r = patience_long(rising, 5, 20, 256).first()
    assert (r["mean"], r["tau"], r["triggered"]) == (29_997.0, 30_000, False) and max(sizes) <= 5
