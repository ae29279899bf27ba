"""Periodic runs against a direct search of every period, and the query's edges."""

import hashlib
import random
import zlib

import __spark_entry__ as entry
from hypothesis import given, settings
from hypothesis import strategies as st

from doubtscope.llm import periodic


def plain_runs(words):
    """Every maximal run of every period, smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_of_repetitive_words(parts):
    words = [b"%d" % x for piece, times in parts for x in piece * times]
    assert periodic.runs_of([words])[0] == plain_runs(words)


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        block = [b"%d" % rng.randrange(rng.choice([2, 3, 40])) for _ in range(rng.randrange(1, 60))]
        texts.append([b"%d" % rng.randrange(3) for _ in range(rng.randrange(30))] + block * rng.randrange(1, 9) + block[: rng.randrange(len(block))])
    texts += [[], [b"x"], [b"x"] * 5, [b"x"] * 6, [b"x"] * 3000, [b"a", b"b"] * 700 + [b"a"] * 900]
    assert periodic.runs_of(texts) == [plain_runs(t) for t in texts]


def test_fibonacci_word():
    a, b = [b"0"], [b"0", b"1"]
    while len(b) < 1500:
        a, b = b, b + a
    for k in range(3):
        assert periodic.runs_of([b[k:] * 2])[0] == plain_runs(b[k:] * 2)


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = plant(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    cut = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (
        len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in cut)).hexdigest(),
    )


def rows_of(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.doc_id, []).append((r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
    return out


def test_query_on_the_small_table(spark, sf_dir):
    found = rows_of(entry.queries()["op12_periodic_runs"](spark, sf_dir))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sum(r[0][0] > 0 for r in found.values()) > 5
    assert found == {r.doc_id: [expected(r.doc_id, r.text)] for r in rows}


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 8), (5, "x" * 500_000 + " y"), (6, "w " * 30_000), (None, "b c " * 9), (7, "é è " * 7 + "z\x0bz\x0cz z z z"), (4, "a " * 8), (13, "one two " * 40)]
    rows += [(k, "p q r s t u v w x y z " * 3) for k in range(20, 60)]
    found = rows_of(periodic.digest(periodic.with_runs(periodic.repeated_words(docs(rows)))))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(expected(i, t))
    assert found == want
    assert periodic.with_runs(docs([])).count() == 0
    clashing = docs(rows).withColumnRenamed("slot", "runs")
    kept = periodic.with_runs(clashing)
    assert kept.columns == [c for c in clashing.columns if c != "runs"] + ["runs", "collapsed"] and kept.count() == len(rows)
