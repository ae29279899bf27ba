"""Raking against a plain version, and the shard table's promises."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doubtscope.llm import mixing, sharding


def plain_rates(cells, powers, rounds):
    total = sum(cells.values())
    weights = {k: v / total for k, v in cells.items()}
    targets = []
    for d, name in enumerate(mixing.DIMENSIONS):
        by = Counter()
        for k, v in cells.items():
            by[k[d]] += v
        raised = {k: v ** powers[name] for k, v in by.items()}
        targets.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(rounds):
        for d in range(3):
            have = Counter()
            for k, w in weights.items():
                have[k[d]] += w
            weights = {k: w * targets[d][k[d]] / have[k[d]] for k, w in weights.items()}
    rates = {k: weights[k] / cells[k] for k in cells}
    return {k: r / max(rates.values()) for k, r in rates.items()}


def rows():
    out = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        text = None if k % 50 == 0 else " ".join(["a | b" if k % 11 == 0 else "word"] * (5 + k * 13 % 900))
        out.append((k, text, [None, "en", "de"][k % 3], source if k % 40 else None))
    return out + [(None, "null id", "en", "hot"), (7, out[7][1], out[7][2], out[7][3])]


def test_rates_and_draws(docs):
    data = rows()
    got = mixing.sample_mixture(docs(data)).select("doc_id", "__mix.*", "__p", "__kept").collect()
    assert len(got) == len(data)
    cells = Counter()
    for r in got:
        cells[r.source, r.lang, r.topic] += r.tokens
    want = plain_rates(cells, mixing.POWERS, 6)
    for r in got:
        assert r["__p"] == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-9)
        u = int(hashlib.md5(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / (1 << 48)
        assert r["__kept"] == (u < r["__p"])
    assert {r.source for r in got if r.doc_id is not None and r.doc_id % 40 == 0} == {mixing.MISSING}


def test_marginals_are_met(docs):
    data = [(k, "word " * (1 + k * 37 % 5000), ["en", "de", None][k * k % 11 % 3], f"s{k * 7 % 13 % 4}") for k in range(600)]
    marked = mixing.keyed(docs(data), F.col("text"), F.col("source"), F.col("lang"), mixing.format_topic(F.col("text")))
    cells = marked.groupBy("__mix.source", "__mix.lang", "__mix.topic").agg(F.sum("__mix.tokens").alias("tokens"))
    raked = mixing.rake(cells, mixing.POWERS, 12).toPandas()
    for d in mixing.DIMENSIONS:
        share = raked.groupby(d).tokens.sum() ** mixing.POWERS[d]
        assert (raked.groupby(d).weight.sum() - share / share.sum()).abs().max() < 1e-3


def test_empty_and_single(docs):
    assert mixing.sample_mixture(docs([])).count() == 0
    one = mixing.sample_mixture(docs([(1, "a b", "en", "s")])).collect()
    assert one[0]["__p"] == pytest.approx(1.0) and one[0]["__kept"]


def test_table_is_even_and_stable():
    names = [f"n{k}" for k in range(10)]
    table = sharding.fill_table(names, 1021)
    counts = Counter(table)
    assert len(table) == 1021 and set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1021)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.25 * 1021
    assert sharding.fill_table(["only"], 2) == [0, 0]
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_placement(docs):
    data = [(k, "t") for k in range(500)] + [(None, "t"), (3, "again"), (None, None)]
    got = sharding.assign_shards(docs(data), ["a", "b", "c"], 101)
    assert got.columns == [c for c in docs([]).columns if c != "slot"] + ["slot", "shard"]
    table = sharding.fill_table(["a", "b", "c"], 101)
    rows = got.collect()
    assert len(rows) == len(data)
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:12], 16) % 101
        assert (r.slot, r.shard) == (slot, "abc"[table[slot]])
    assert sharding.assign_shards(docs([]), ["a"], 2).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan
