"""Fingerprints and groups against a plain all-pairs version."""

import random
import re

import numpy as np
import xxhash

from doubtscope.llm import simhash
from doubtscope.llm.components import component_members


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    runs = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(pairs, radius):
    """{position: smallest id reachable} over all pairs of (id, fingerprint)."""
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [least.get(find(k)) for k in range(len(pairs))]


def texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(12)]
    out = [None, "", "  \t\n ", "one", "One two", "one two three four", "É é ÀB", "\x0bx\x0cy\rz w v", " a b c d"]
    for b in base:
        out += [b, b.upper(), b.replace("w7 ", "w8 ", 1), b + " end"]
    return [*out, " ".join(rng.choices(words, k=70_000)), base[0]]


def test_groups_equal_all_pairs(docs):
    rows = list(enumerate(texts())) + [(None, texts()[12]), (3, "one")]
    got = simhash.near_duplicates(docs(rows)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(prints, plain_groups(prints, 4))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_null_ids_only(docs):
    got = simhash.near_duplicates(docs([(None, "a b c"), (None, "a b c")])).collect()
    assert [r.component_id for r in got] == [None, None]


def test_tile_forest_spans_all_links():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([1 << int(b) for b in rng.integers(0, 64, 600)], np.uint64)
    fps = np.unique(np.concatenate([seeds, np.repeat(seeds, 15) ^ flips, np.repeat(seeds, 15) ^ flips ^ np.roll(flips, 1)]))
    left, right = fps[::2].copy(), fps[1::2].copy()
    edges = [*zip(*simhash.tile_forest(left, None, 4)), *zip(*simhash.tile_forest(right, None, 4)), *zip(*simhash.tile_forest(left, right, 4))]
    assert all((int(a) ^ int(b)).bit_count() > 0 for a, b in edges)
    root = {int(f): int(f) for f in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        root[find(int(a))] = find(int(b))
    want = plain_groups([(k, int(f)) for k, f in enumerate(fps)], 4)
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(find(int(f)), set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_tiles_smaller_than_a_count(docs, spark):
    rows = [(k, " ".join(f"x{(k * 7 + j) % 40}" for j in range(30))) for k in range(120)]
    df = docs(rows)
    one = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    assert one == sorted(map(tuple, simhash.near_duplicates(df, tile_size=5).collect()))


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(200)]
    shuffled = list(range(1000, 1200))
    random.Random(1).shuffle(shuffled)
    edges = chain + list(zip(shuffled, shuffled[1:])) + [(5000, 5000 + k) for k in range(1, 300)] + [(7, 7), (9000, 9001), (9001, 9000)]
    got = component_members(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) == 201 + 200 + 300 + 2
    roots = {}
    for r in got:
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [2, 200, 201, 300]
    assert component_members(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_row_of_each_group_stays(docs):
    a = "a long enough text with many words in it so that one more hardly matters " * 6
    b = "something else altogether which shares nothing with the other text at all " * 6
    rows = [(1, a), (5, a + "now"), (5, b), (None, a + "null"), (None, "lonely words without an id"), (None, "lonely words without an id"), (7, None), (8, ""), (1, a)]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert got == sorted([("1", a), ("5", b), ("None", "lonely words without an id"), ("7", None)], key=lambda x: (x[0], x[1]))
    assert simhash.keep_one(docs([])).count() == 0
