"""Recall and exactness of the neighbour search against brute force."""

import numpy as np

from doubtscope.llm import ann

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def brute(data, k=10):
    out = {}
    for q, v in data.items():
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in data.items() if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def run(table, **kw):
    got = {}
    for r in ann.nearest(table, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in table.collect()}
    got, want = run(table, rows_per_shard=150), brute(data)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 11))
        for _, i, score in rows:
            assert abs(score - np.sqrt(((data[i] - data[q]) ** 2).sum())) < 1e-12
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)


def test_bad_vectors_copies_and_lengths(make):
    rng = np.random.default_rng(2)
    good = {k: rng.normal(size=8).astype(np.float32).tolist() for k in range(300)}
    for k in range(50, 150):
        good[k] = good[50]  # one vector a hundred times
    rows = [(k, v, 1, "mine") for k, v in good.items()]
    rows += [(400, None, 1, ""), (500, [0.0] * 8, 1, ""), (600, [1.0, None] * 4, 1, ""), (700, [float("nan")] * 8, 1, ""), (800, [float("inf")] + [1.0] * 7, 1, "")]
    rows += [(None, good[3], 1, ""), (900, [1.0, 2.0], 1, ""), (901, [2.0, 2.0], 1, ""), (1000, [1.0], 1, ""), (1100, [], 1, ""), (200, good[200], 1, "")]
    data = {k: np.array(v) for k, v in good.items()} | {900: np.array([1.0, 2.0]), 901: np.array([2.0, 2.0])}
    got, want = run(make(rows, VECTORS), rows_per_shard=90), brute(data)
    assert got.keys() == {q for q in want if want[q]} == {0, 100, 200, 900}
    assert [i for _, i, _ in got[100]] == [*range(50, 60)] and [i for _, i, _ in got[900]] == [901]
    assert sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in got) >= 0.9 * sum(len(want[q]) for q in got)


def test_empty(make):
    assert ann.nearest(make([], VECTORS)).count() == 0
    assert ann.nearest(make([(1, [1.0], 1, "")], VECTORS)).count() == 0
