"""Centroid clustering by equal-average equal-variance nearest-centroid search, exact in integers.

Centroids lie sorted by the sum of their components. A vector starts at the place of its own sum and
looks outward: with d components, the squared distance is at least (difference of sums)² / d, which
ends a direction, and at least that plus the squared difference of the deviations' lengths, which
rejects one centroid. What is left is compared exactly. Every round is one pass over the vectors;
a task returns exact sums per centroid and component, Spark adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtscope.session import stored

SCALE = 1024
#: Below this size of components all sums and squares fit in 64 bits; beyond it the same code runs on Python integers.
SMALL = 1 << 24
LOW_BITS = 80  # of a component's two parts, whose sums fit in 38 digits
LARGEST = (1 << 63) - 1
SUMS = "cluster int, part int, high decimal(38,0), low decimal(38,0), n bigint"


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of doubles: as int64 if all are small, else as Python integers."""
    scaled = np.floor(vectors * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], dtype=object).reshape(scaled.shape)


def _lengths(v: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Length of each row's deviation from its own mean, in doubles."""
    return np.sqrt(np.maximum(0.0, np.square(v.astype(float) - sums.astype(float)[:, None] / v.shape[1]).sum(axis=1)))


def nearest_centroid(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, distances computed) of every row, exact; ties to the smaller number."""
    if v.dtype == object or centroids.dtype == object or max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) >= SMALL:
        v, centroids = v.astype(object), centroids.astype(object)
    n, d = v.shape
    sums, middle = v.sum(axis=1), centroids.sum(axis=1)
    order = np.array(sorted(range(len(centroids)), key=lambda c: (middle[c], c)))
    sorted_sums = middle[order]
    spread, spreads = _lengths(v, sums), _lengths(centroids, middle)
    right = np.searchsorted(sorted_sums, sums)
    left = right - 1
    best, where = np.zeros(n, v.dtype), np.full(n, -1)
    computed = np.zeros(n, np.int64)
    open_rows = np.arange(n)
    while len(open_rows):
        lo, hi = left[open_rows], right[open_rows]
        own = sums[open_rows]
        gap_lo, gap_hi = own - sorted_sums[np.maximum(lo, 0)], sorted_sums[np.minimum(hi, len(order) - 1)] - own
        down = (lo >= 0) & ((hi >= len(order)) | (gap_lo <= gap_hi))
        gap = np.where(down, gap_lo, gap_hi)
        first = where[open_rows] < 0
        # the nearer side decides: if its mean is too far off, so are all the rest on both sides
        going = ((lo >= 0) | (hi < len(order))) & (first | (gap * gap <= d * best[open_rows]).astype(bool))
        open_rows, down, gap, first = open_rows[going], down[going], gap[going], first[going]
        tried = order[np.where(down, left[open_rows], np.minimum(right[open_rows], len(order) - 1))]
        left[open_rows] -= down
        right[open_rows] += ~down
        bound = np.square(gap.astype(float)) / d + np.square(spread[open_rows] - spreads[tried])
        # doubles only reject with room to spare for their rounding; the rest is decided in integers
        room = 1e-9 * (np.square(spread[open_rows]) + np.square(spreads[tried]) + np.square(gap.astype(float))) + 1e-6
        close = first | (bound - room <= best[open_rows].astype(float))
        rows, tried = open_rows[close], tried[close]
        off = v[rows] - centroids[tried]
        dist = (off * off).sum(axis=1)
        computed[rows] += 1
        better = (where[rows] < 0) | (dist < best[rows]).astype(bool) | ((dist == best[rows]).astype(bool) & (tried < where[rows]))
        best[rows[better]], where[rows[better]] = dist[better], tried[better]
    return where, best, computed


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """List column of equal lengths → n x d doubles."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, exact component sums)} after assigning every vector."""
    wide = pa.decimal128(38, 0)
    schema = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("high", wide), ("low", wide), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = integers(_rows(batch, "vector"))
            where, _, _ = nearest_centroid(v, centroids)
            for c in np.unique(where).tolist():
                mine = v[where == c]
                n, total = sums.get(c, (0, 0))
                sums[c] = (n + len(mine), total + mine.sum(axis=0).astype(object))
        flat = [(c, j, int(x) >> LOW_BITS, int(x) & ((1 << LOW_BITS) - 1), n) for c, (n, total) in sums.items() for j, x in enumerate(total)]
        if flat:
            c, j, high, low, n = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, high), wide), pa.array(map(Decimal, low), wide), pa.array(n, pa.int64())], schema=schema
            )

    added = vectors.mapInArrow(work, SUMS).groupBy("cluster", "part").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(added.collect(), key=lambda r: (r.cluster, r.part)):  # clusters x components rows
        out.setdefault(r.cluster, (r.n, []))[1].append((int(r.high) << LOW_BITS) + int(r.low))
    return out


def _array(rows: list[list[int]]) -> np.ndarray:
    largest = max((abs(x) for row in rows for x in row), default=0)
    return np.array(rows, dtype=np.int64 if largest < SMALL else object)


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3
) -> tuple[DataFrame, list[list[int]]]:
    """Integer k-means: (one row per kept vector: vec_id, cluster, distance, compared; the final centroids).

    Kept are vectors of exactly ``dim`` components, none null, NaN or infinite, each turned to
    floor(1024 x). The first centroids are the k vectors with the smallest sha256 of "seed:id" (with
    fewer vectors, all of them); rows with a null id come last, equal hashes go by the vector. Repeated
    rows count each. A round assigns all and replaces every non-empty centroid by floor(sum / count) of
    its vectors; an empty one stays. ``compared`` counts the distances computed for the row. A distance
    that no 64-bit integer holds is null; sums stay exact up to components of the size of a float's.
    Other columns are not read; an empty table gives no rows and no centroids.
    """
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.5e38))
    kept = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where((F.size(vector) == dim) & ~odd)
    vectors = stored(kept, "cluster-vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(drawn.asc_nulls_last(), "vector").limit(k).collect()
    if not start:
        schema = "vec_id long, cluster int, distance long, compared int"
        return table.sparkSession.createDataFrame([], schema), []
    centroids = [[int(x) for x in row] for row in integers(np.array([r.vector for r in start]))]
    for _ in range(rounds):
        for c, (n, total) in _sums(vectors, _array(centroids)).items():
            centroids[c] = [x // n for x in total]
    final = _array(centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("compared", pa.int32())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                where, best, computed = nearest_centroid(integers(_rows(batch, "vector")), final)
                distance = pa.array([x if x <= LARGEST else None for x in best.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(where, pa.int32()), distance, pa.array(computed, pa.int32())], schema=schema)

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long, compared int"), centroids


def digest(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): sums that no 64-bit integer holds are null."""
    if not centroids:
        return assigned.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    found = stored(assigned, "cluster-rows")
    whole = F.count("distance") == F.count(F.lit(1))
    sums = found.groupBy("cluster").agg(F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("inertia"))
    by = {r.cluster: r.inertia for r in sums.collect()}  # a row per centroid
    fits = lambda x: x if x is not None and x <= LARGEST else None
    total = None if None in by.values() else sum(map(int, by.values()))
    named = [(c, fits(None if x is None else int(x)), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in by.items()]
    rows = found.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
