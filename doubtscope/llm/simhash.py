"""SimHash near-duplicate groups by tiled exact comparison.

Every text becomes a 64-bit fingerprint; fingerprints that differ in at most ``radius`` bits are
linked, and a group is a connected component. The links are found exactly: distinct fingerprints are
packed into tiles by population count, each pair of tiles whose counts lie within the radius is one
unit of work, and inside it numpy compares only cells whose four 16-bit population counts differ by
no more than the radius in sum (two words cannot be closer than that). A unit gives back a spanning
forest of its links, never the links themselves, so a group of k near copies costs O(k) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doubtscope.llm.components import component_members
from doubtscope.session import stored

SEED = 42
_HASH_BLOCK = 1 << 16
_PAIR_BLOCK = 1 << 20


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``width`` words (of the whole text if it has fewer), in blocks."""
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = max(0, len(words) - width)
    first, final = starts[: last + 1], ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, last + 1, _HASH_BLOCK):
        cut = slice(at, at + _HASH_BLOCK)
        yield np.array(
            [digest(joined[a:b], SEED) for a, b in zip(first[cut].tolist(), final[cut].tolist(), strict=True)], np.uint64
        )


def simhash(text: bytes | None, width: int = 4) -> int:
    """Fingerprint of UTF-8 text as a signed 64-bit integer; 0 for null, empty and blank texts."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes((text or b"").lower().split(), width):  # bytes: only A-Z fold, only ASCII space splits
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """Fingerprint of a text column, in Arrow batches over whole texts."""

    @F.arrow_udf(T.LongType())
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), width) for t in texts.cast(pa.binary())], pa.int64())

    return fingerprint(text.cast("string"))


class _Forest:
    """Union-find over positions 0..n-1 with whole-array steps; roots are the smallest positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the four 16-bit population counts: (order, cell counts, first row of each cell)."""
    counts = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T)
    counts = counts[order]
    first = np.flatnonzero(np.r_[True, (counts[1:] != counts[:-1]).any(axis=1)])
    return order, counts[first], first


def tile_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (node, root) fingerprints, of the links between two tiles (or within one)."""
    order, cells, first = _cells(left)
    left = left[order]
    if right is None:
        nodes, other, other_cells, other_first, shift = left, left, cells, first, 0
    else:
        order, other_cells, other_first = _cells(right)
        other, shift = right[order], len(left)
        nodes = np.concatenate([left, other])
    sizes = np.diff(np.r_[other_first, len(other)])
    ends = np.r_[first[1:], len(left)]
    forest = _Forest(len(nodes))
    for k, counts in enumerate(cells):
        near = np.abs(other_cells - counts).sum(axis=1) <= radius
        if right is None:
            near[:k] = False  # each pair of cells once
        if not near.any():
            continue
        columns = np.flatnonzero(np.repeat(near, sizes))
        candidates = other[columns]
        step = max(1, _PAIR_BLOCK // len(candidates))
        for at in range(first[k], ends[k], step):
            rows = np.arange(at, min(at + step, ends[k]))
            i, j = np.nonzero(np.bitwise_count(left[rows][:, None] ^ candidates) <= radius)
            forest.join(rows[i], columns[j] + shift)
    linked = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[linked], nodes[forest.root[linked]]


def link_forest(fingerprints: DataFrame, radius: int = 4, tile_size: int = 1 << 16) -> DataFrame:
    """(a, b) links spanning the components of distinct long ``fp`` values.

    ``tile_size`` bounds what one task holds. The table of tiles per population count has 65 entries.
    """
    session = fingerprints.sparkSession
    per_count = dict(fingerprints.groupBy(F.bit_count("fp").alias("p")).count().collect())
    n_tiles = [-(-per_count.get(p, 0) // tile_size) for p in range(65)]
    tiles_of = F.lit(n_tiles)
    n_pairs = sum(n_tiles[p] * n_tiles[q] for p in range(65) for q in range(p, min(65, p + radius + 1)))
    pieces = max(1, min(n_pairs, 8 * int(session.conf.get("spark.sql.shuffle.partitions"))))

    tiles = (
        fingerprints.select("fp", F.bit_count("fp").alias("p"))
        .withColumn("s", F.pmod(F.xxhash64("fp"), F.element_at(tiles_of, F.col("p") + 1)).cast("int"))
        .groupBy("p", "s")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.struct("p", "s").alias("tile"), "fps")
    )
    around = F.sequence(F.greatest(F.col("tile.p") - radius, F.lit(0)), F.least(F.col("tile.p") + radius, F.lit(64)))
    partners = F.flatten(
        F.transform(
            around,
            lambda q: F.transform(
                F.filter(F.sequence(F.lit(0), F.element_at(tiles_of, q + 1)), lambda t: t < F.element_at(tiles_of, q + 1)),
                lambda t: F.struct(q.alias("p"), t.alias("s")),
            ),
        )
    )
    pairs = (
        tiles.select("tile", "fps", F.explode(partners).alias("partner"))
        .select(F.struct(F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high")).alias("pair"), "tile", "fps")
        .repartition(pieces, "pair")
        .groupBy("pair")
        .agg(F.collect_list("fps").alias("sides"))
        .select("sides")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in batch.column(0):
                tiles = [np.asarray(side.values).astype(np.int64).view(np.uint64) for side in sides]
                a, b = tile_forest(tiles[0], tiles[1] if len(tiles) > 1 else None, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _classes(marked: DataFrame, radius: int, tile_size: int) -> DataFrame:
    """(fp, root, first_id) of every distinct fingerprint of (doc_id, fp): equal roots, same group."""
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    members = component_members(link_forest(classes.select("fp"), radius, tile_size)).withColumnRenamed("node", "fp")
    return classes.join(members, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tile_size: int = 1 << 16
) -> DataFrame:
    """One row of each near-duplicate group of docs, all columns: the one with the smallest id, then the least digest of its text.

    A row is chosen, not an id: an id that stands on several texts keeps only the row that won its group. Null ids come
    last. Rows that repeat an id and text are one. Null and empty texts form a group.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    columns = [F.col(id_col).alias("doc_id"), digest.alias("digest"), fingerprint_column(F.col(text_col), width).alias("fp")]
    marked = stored(docs.select(*columns), "simhash-prints")
    roots = _classes(marked, radius, tile_size).select("fp", "root")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest"))
    # least of each fingerprint first, so that a large group of copies never meets in one task
    first = marked.groupBy("fp").agg(least.alias("row")).join(roots, "fp").groupBy("root").agg(F.min("row").alias("row"))
    stay = first.select("row.doc_id", "row.digest")
    digest = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    kept = docs.join(stay, docs[id_col].eqNullSafe(stay["doc_id"]) & (digest == stay["digest"]), "left_semi")
    return kept.dropDuplicates([id_col, text_col])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tile_size: int = 1 << 16
) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id).

    component_id is the smallest id reachable over links, the row's own included. Null, empty and
    blank texts have fingerprint zero and link like any other. A row with a null id gets the smallest
    non-null id of its group (null if there is none); repeated rows are repeated in the result. Other
    columns of docs are not read. An empty table gives an empty result.
    """
    marked = stored(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp")), "simhash-prints"
    )
    classes = _classes(marked, radius, tile_size)
    groups = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = classes.join(groups, "root").select("fp", "component_id")
    return marked.join(by_class, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
