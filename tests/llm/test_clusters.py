"""Integer k-means against plain Python, the search's bounds, and edges."""

import hashlib
import math
import random

import numpy as np

from doubtscope.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k=8, rounds=10):
    """(cluster, distance) per row, and centroids, in Python integers."""
    v = [[math.floor(1024 * np.float64(np.float32(x))) if abs(x) < 1e30 else int(np.float64(np.float32(x))) * 1024 for x in e] for _, e in rows]
    seeds = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), [np.float32(x) for x in rows[i][1]]))[:k]
    centroids = [v[i] for i in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for x in v]

    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            mine = [x for x, (_, c) in zip(v, where) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(c, d) for d, c in assign()], centroids


def check(make, rows, **parts):
    found, centroids = clusters.cluster(make([(i, e, "mine") for i, e in rows], SCHEMA, **parts))
    want, final = plain(rows)
    assert centroids == final
    got = sorted((r.vec_id, r.cluster, r.distance) for r in found.collect())
    assert got == sorted((i, c, d if d < 1 << 63 else None) for (i, _), (c, d) in zip(rows, want))
    return found


def random_rows(n, seed=0, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 5, 1) * scale for _ in range(64)]) for i in range(n)]


def test_equals_plain_python(make):
    found = check(make, random_rows(300))
    again, _ = clusters.cluster(make([(i, e, "") for i, e in random_rows(300)], SCHEMA, parts=7))
    assert sorted(found.collect()) == sorted(again.collect())


def test_query_on_the_given_table(spark, sf_dir):
    import __spark_entry__ as entry

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, centroids = plain(rows)
    inertia = sum(d for _, d in want)
    got = {r.vec_id: r for r in entry.queries()["op11_centroid_clusters"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (i, _), (c, d) in zip(rows, want):
        assert (got[i].cluster, got[i].distance, got[i].inertia) == (c, d, inertia)
        assert got[i].cluster_inertia == sum(x for k, x in want if k == c)
        assert got[i].centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()


def test_large_components_repeats_and_few_rows(make):
    rows = random_rows(40, 1) + random_rows(10, 2, 1e6)[3:] + [(900, [3e38] * 64), (901, [-3e38] * 32 + [0.0] * 32), (7, random_rows(40, 1)[7][1])]
    check(make, rows)
    check(make, [(i, [float(i % 3)] * 64) for i in range(30)])
    check(make, random_rows(3))
    check(make, [(1, [0.0] * 64), (2, [-0.0] * 64)])


def test_what_is_left_out(make):
    good = [(1, [0.5] * 64), (2, [1.5] * 64)]
    odd = [(3, None), (4, []), (5, [1.0] * 63), (6, [1.0] * 65), (7, [None] + [1.0] * 63), (8, [float("nan")] + [1.0] * 63), (9, [float("inf")] * 64)]
    found, _ = clusters.cluster(make([(i, e, "") for i, e in good + odd + [(None, [0.25] * 64)]], SCHEMA))
    assert {r.vec_id for r in found.collect()} == {1, 2, None}
    assert clusters.digest(*clusters.cluster(make([], SCHEMA))).count() == 0
    assert clusters.digest(*clusters.cluster(make([(i, e, "") for i, e in odd], SCHEMA))).count() == 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (64, 1)) + rng.integers(-300, 300, (64, 16))
    v = centers[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 16))
    where, best, computed = clusters.nearest_centroid(v, centers)
    whole = ((v[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (where == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()
    assert computed.mean() < 12
