"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id; each shard builds its own graph over its distinct
vectors and stores it as flat neighbour arrays. Queries visit every shard in blocks, and the shards'
answers are merged. Distances that are returned are computed on the original vectors in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doubtscope.session import stored

M = 16  # links of a node on upper levels; twice as many at the bottom
EF_BUILD, EF_SEARCH = 64, 96


class Graph:
    """Levels of an HNSW graph: ``links[l]`` is (n, width) of int32, -1 where a slot is free."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.links, self.entry = vectors, links, entry

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.vectors[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def layer(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes that a best-first walk of one level finds, as (squared distance, node)."""
        links = self.links[level]
        seen = np.zeros(len(self.vectors), bool)
        ahead, best = [], []
        for d, node in starts:
            seen[node] = True
            heappush(ahead, (d, node))
            heappush(best, (-d, node))
        while len(best) > ef:
            heappop(best)
        while ahead:
            d, node = heappop(ahead)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            ds = self._distances(q, near)
            if len(best) >= ef:
                closer = ds < -best[0][0]
                near, ds = near[closer], ds[closer]
            for x, n in zip(ds.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heappush(best, (-x, n))
                    heappush(ahead, (x, n))
                elif x < -best[0][0]:
                    heapreplace(best, (-x, n))
                    heappush(ahead, (x, n))
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        at = [(float(self._distances(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            at = self.layer(q, at, 1, level)[:1]
        return self.layer(q, at, ef, 0)


def _spread(vectors: np.ndarray, found: list[tuple[float, int]], width: int) -> list[int]:
    """Up to ``width`` of the nearest nodes, preferring ones that no nearer chosen node covers."""
    near = vectors[[n for _, n in found]]
    size = np.einsum("ij,ij->i", near, near)
    apart = (size[:, None] + size - 2 * (near @ near.T)).tolist()
    chosen: list[int] = []
    passed: list[int] = []
    for k, (d, _) in enumerate(found):
        if len(chosen) == width:
            break
        row = apart[k]
        (passed if any(row[c] < d for c in chosen) else chosen).append(k)
    return [found[k][1] for k in (chosen + passed)[:width]]


def build_graph(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 1) -> Graph:
    """Insert the rows one by one; levels are drawn from a fixed seed, so a repeated task builds the same graph."""
    n = len(vectors)
    levels = np.minimum((-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 12)
    links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
    used = [np.zeros(n, np.int32) for _ in links]
    graph = Graph(vectors, links, 0)
    top = int(levels[0])
    for node in range(1, n):
        q, level = vectors[node], int(levels[node])
        at = [(float(graph._distances(q, np.array([graph.entry]))[0]), graph.entry)]
        for k in range(top, level, -1):
            at = graph.layer(q, at, 1, k)[:1]
        for k in range(min(top, level), -1, -1):
            at = graph.layer(q, at, ef, k)
            width = links[k].shape[1]
            for other in _spread(vectors, at, m):
                links[k][node, used[k][node]] = other
                used[k][node] += 1
                if used[k][other] < width:
                    links[k][other, used[k][other]] = node
                    used[k][other] += 1
                else:
                    around = np.append(links[k][other], node)
                    ds = graph._distances(vectors[other], around)
                    order = np.argsort(ds, kind="stable")
                    keep = _spread(vectors, list(zip(ds[order].tolist(), around[order].tolist(), strict=True)), width)
                    links[k][other] = -1
                    links[k][other, : len(keep)] = keep
                    used[k][other] = len(keep)
        if level > top:
            top, graph.entry = level, node
    return graph


def usable(vector: Column) -> Column:
    """Whether a vector is non-null, non-empty, non-zero and all of its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _spread_out(df: DataFrame, n_shards: int) -> DataFrame:
    """Deal shards to tasks of their own: little data, much work, so partitions are not merged by size."""
    limit = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(2 * n_shards, limit)), "dim", "shard")


INDEX = "dim int, shard int, ids array<long>, copies array<int>, vectors array<float>, entry int, widths array<int>, links array<int>"


def build_index(vectors: DataFrame, rows_per_shard: int = 2048) -> DataFrame:
    """One row per shard of (vec_id, embedding): ids by distinct vector, vectors and neighbour arrays, all flat.

    ``copies`` counts the ids of each distinct vector; ids are in order of vector, then id. Vectors of
    different lengths are in different shards. A shard's size does not grow with the table.
    """
    rows = vectors.withColumn("dim", F.size("embedding"))
    sizes = {r["dim"]: -(-r["count"] // rows_per_shard) for r in rows.groupBy("dim").count().collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], INDEX)
    n_shards = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), n_shards).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf.vec_id.to_numpy()
        whole = np.stack([np.asarray(v, np.float32) for v in pdf.embedding])
        distinct, which = np.unique(whole, axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.lexsort((ids, which))
        mixed = np.random.default_rng(0).permutation(len(distinct))  # sorted rows would make a poor graph
        back = np.argsort(mixed)
        order = order[np.argsort(back[which[order]], kind="stable")]
        graph = build_graph(distinct[mixed])
        return pd.DataFrame(
            {
                "dim": [key[0]], "shard": [key[1]], "ids": [ids[order]], "copies": [np.bincount(which)[mixed].astype(np.int32)],
                "vectors": [graph.vectors.reshape(-1)], "entry": [graph.entry], "widths": [np.array([x.shape[1] for x in graph.links], np.int32)],
                "links": [np.concatenate([x.reshape(-1) for x in graph.links])],
            }
        )

    return _spread_out(dealt, sum(sizes.values())).groupBy("dim", "shard").applyInPandas(build, INDEX)


def _search_shard(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, int, float]]:
    dim, ids, copies = row["dim"], row["ids"], row["copies"]
    vectors = row["vectors"].reshape(-1, dim)
    cuts = np.cumsum(row["widths"] * len(vectors))
    links = [part.reshape(len(vectors), -1) for part in np.split(row["links"], cuts[:-1])]
    graph = Graph(vectors, links, row["entry"])
    first = np.r_[0, np.cumsum(copies)]
    exact = vectors.astype(np.float64)
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        hits = []
        for node in [n for _, n in graph.search(q.astype(np.float32), max(ef, k + 1))]:
            own = ids[first[node] : first[node + 1]]  # ascending
            d = float(np.sqrt(np.square(exact[node] - q).sum()))
            hits += [(d, i) for i in own[: k + 1].tolist() if i != query_id]
        for d, i in sorted(hits)[:k]:
            yield query_id, i, d


def nearest(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, rows_per_shard: int = 2048,
    ef: int = EF_SEARCH, block: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``, the k nearest
    other rows found, by Euclidean distance, ties to the smaller id.

    Null ids and unusable vectors (see ``usable``) take no part, as query or candidate. Rows that
    repeat an id and vector count once, and an id is never its own neighbour. A query meets vectors of
    its own length only. Fewer than k candidates are all returned; an empty table gives none.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    index = stored(build_index(rows, rows_per_shard), "ann-index")
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("dim", F.size("embedding"))
    counts = queries.groupBy("dim").count().withColumn("n_blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    # a few rows: one per vector length
    plan = {r.dim: (r.n_blocks, r.last) for r in counts.join(shards, "dim").collect()}
    if not plan:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    looked_up = F.create_map(*[x for dim, (n, last) in plan.items() for x in (F.lit(dim), F.struct(F.lit(n).alias("n"), F.lit(last).alias("last")))])
    of = F.element_at(looked_up, F.col("dim"))
    blocks = (
        queries.groupBy("dim", F.pmod(F.xxhash64("vec_id"), of["n"]).alias("block"))
        .agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("embedding")).alias("query_vectors"))
        .select("dim", "query_ids", "query_vectors", F.explode(F.sequence(F.lit(0), of["last"])).alias("shard"))
    )
    n_shards = sum(last + 1 for _, last in plan.values())
    pairs = _spread_out(index, n_shards).join(_spread_out(blocks, n_shards), ["dim", "shard"])
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for at in range(batch.num_rows):
                cells = {n: batch.column(c)[at] for c, n in enumerate(names)}
                row = {n: np.asarray(v.values) if isinstance(v, pa.ListScalar) else v.as_py() for n, v in cells.items()}
                found = list(_search_shard(row, row["query_ids"], row["query_vectors"].reshape(-1, row["dim"]).astype(np.float64), k, ef))
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    hits = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
