"""Language-model scores: the base by plain counting, the mixer bit by bit in plain Python, and edges."""

import math
import sys
import tracemalloc
import zlib
from collections import Counter

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pytest

from doubtscope.llm import lmscore


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(rows):
    """(n_tokens, n_known, N, base) per row."""
    split = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    counts = Counter(w for (i, _), words in zip(rows, split) if not held(i) for w in words)
    total, below = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    return [(len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10((counts[w] + 1) / below) for w in words)) for words in split]


def plain_tables(texts):
    """The predictors' stored odds from plain dictionaries, the bytes' codes and what comes on top of them."""
    grams, words = Counter(), Counter()
    for text in texts:
        padded = b"\n" * 4 + text
        for k in range(4, len(padded)):
            grams[int.from_bytes(padded[k - 4 : k + 1])] += 1
            words[word_hash(text, k - 4), padded[k]] += 1
    total, tables = sum(grams.values()), []
    n = Counter(b for text in texts for b in text)
    order = sorted(range(256), key=lambda b: (-n[b], b))
    codes = np.array([min(order.index(b), 63) for b in range(256)])
    among = sum(n[b] for b in order[63:])
    more = np.array([math.log((among + 193) / (n[b] + 1)) if codes[b] == 63 else 0.0 for b in range(256)])
    for order in (*lmscore.ORDERS, 0):
        found = words
        if order:
            found = Counter()
            for key, n in grams.items():
                found[(key >> 8) & ((1 << 8 * order) - 1), key & 255] += n
        kept = {k: n for k, n in found.items() if n * lmscore.CONTEXT_SHARE >= total}
        tables.append(lmscore.odds_table(np.array([k for k, _ in kept], np.int64), codes[np.array([b for _, b in kept], np.int64)], np.array(list(kept.values()), np.int64)))
    return np.stack(tables), codes, more


def word_hash(text, k):
    """Hash of the beginning of the word that place k of a text is in."""
    begun = text.rfind(b" ", 0, k) + 1
    h = sum((x + 1) * pow(lmscore.BASE, j, 1 << 64) for j, x in enumerate(text[begun : min(k, begun + lmscore.WORD_BYTES)])) % (1 << 64)
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 32


def logistic(x):
    """Within a few thousandths; the exact form of the operator is a quotient of polynomials."""
    y = min(max(x, -lmscore.ODDS), lmscore.ODDS) / 2
    return 0.5 + 0.5 * y * (10395 + 1260 * y**2 + 21 * y**4) / (10395 + 4725 * y**2 + 210 * y**4 + y**6)


def plain_nats(predictors, text):
    """One text, bit by bit, blocks apart."""
    tables, codes, more = predictors
    cost = 0.0
    for at in range(0, len(text), lmscore.BLOCK):
        weights = [[np.float32(x) for x in lmscore.START] for _ in range(6)]
        slopes, shifts = [1.0] * 6, [0.0] * 6
        for k in range(at, min(at + lmscore.BLOCK, len(text))):
            last = int.from_bytes((b"\n" * 4 + text[:k])[-4:])
            lines = lmscore._lines(np.array([*(last & ((1 << 8 * o) - 1) for o in lmscore.ORDERS), word_hash(text, k)], np.uint32))
            code = int(codes[text[k]])
            cost += more[text[k]]
            for j in range(6):
                slot = (1 << j) | (code >> (6 - j))
                odds = [int(t[line + slot]) * 8 / 127 for t, line in zip(tables, lines)]
                bit = code >> (5 - j) & 1
                dot = sum(w * x for w, x in zip(weights[j], odds))
                p, refined = logistic(dot), logistic(slopes[j] * dot + shifts[j])
                weights[j] = [w + (bit - p) * lmscore.RATE * x for w, x in zip(weights[j], odds)]
                shifts[j] += (bit - refined) * lmscore.SHIFT_RATE
                slopes[j] += (bit - refined) * dot * lmscore.SLOPE_RATE
                mixed = (p + refined) / 2
                cost -= math.log(mixed if bit else 1 - mixed)
    return cost


def text_of(t):
    return b" ".join([*(t or "").encode().lower().split()]) + b"\n"


def rows_of(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def agrees(found, rows, mixer_rows):
    predictors = plain_tables([text_of(t) for i, t in rows if not held(i)])
    want = {}
    for (i, t), base in zip(rows, base_scores(rows)):
        want.setdefault(i, []).append((t, base))
    assert {i: len(x) for i, x in found.items()} == {i: len(x) for i, x in want.items()}
    for i, rows_here in want.items():
        for r, (t, (n, known, total, base)) in zip(sorted(found[i], key=lambda r: r.n_tokens), sorted(rows_here, key=lambda x: x[1][0])):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
            if i in mixer_rows:
                assert r.score == pytest.approx(-plain_nats(predictors, text_of(t)) / math.log(10), rel=2e-3)


def test_edges(docs):
    rows = [(k, f"the small cat number {k} sat on the mat again and again " * (1 + k % 3)) for k in range(40)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "THE Cat É é"), (54, "z" * 3000 + " tail of the text"), (55, "the mat " * 2000), (None, "the cat"), (3, rows[3][1]), (3, "another the"), (56, "word\x0bparted\x0cthe cat")]
    found = rows_of(lmscore.score(docs(rows)))
    agrees(found, rows, {1, 2, 50, 51, 52, 53, 54, None, 56})
    assert found[51][0].n_tokens == 1 and found[50][0].score == found[52][0].score


def test_query_on_the_small_table(spark, sf_dir):
    found = rows_of(entry.queries()["op13_lm_score"](spark, sf_dir))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [i for i, t in rows if len(t or "") < 700][:4]
    agrees(found, rows, set(short))
    assert all(r[0].score < 0 for r in found.values())


def test_rows_do_not_depend_on_partitions(spark, docs):
    rows = [(k, f"some words {k} and more " * (k % 7)) for k in range(60)]
    table = docs(rows)
    assert sorted(lmscore.score(table.repartition(1)).select("doc_id", "score").collect()) == sorted(lmscore.score(table.repartition(9)).select("doc_id", "score").collect())


def test_held_out_prose_costs_less_than_noise(spark):
    """Held-out texts of the corpus against the same bytes shuffled: learned contexts must tell them apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(0)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    noise = [(10_000_000 + i, bytes(rng.permutation(np.frombuffer(t.lower().encode(), np.uint8))).decode("latin-1")) for i, t in rows if held(10_000_000 + i) and t and t.isascii()][:60]
    found = rows_of(lmscore.score(docs.unionByName(spark.createDataFrame(noise, docs.schema))))
    size = {i: len(text_of(t)) for i, t in rows + noise}
    prose = sorted(found[i][0].score / size[i] for i, t in rows if held(i) and len(t) > 200)
    shuffled = sorted(found[i][0].score / size[i] for i, t in noise if len(t) > 200)
    assert prose[len(prose) // 20] > shuffled[-1]


def test_nothing_to_learn(docs):
    lone = next(k for k in range(100) if held(k))
    r = lmscore.score(docs([(lone, "ab c")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < -10
    assert lmscore.score(docs([])).count() == 0


def test_squash_is_nearly_the_logistic_function():
    x = np.linspace(-14, 14, 2001).astype(np.float32)
    got = lmscore.squash(x)
    assert np.abs(got - 1 / (1 + np.exp(-x.astype(float)))).max() < 1e-3 and 0 < got.min() < got.max() < 1
    assert (np.diff(got) >= -1e-6).all() and np.abs(got + lmscore.squash(-x) - 1).max() < 1e-6


def test_chances_sum_to_one():
    """Over all bytes that may come next, the mixer's probabilities add up to 1."""
    mixer = lmscore.Mixer(*plain_tables([b"abra cadabra abra\n", b"cad abra\n"]))
    before = float(mixer.nats([b"abra c"])[0])
    after = mixer.nats([b"abra c" + bytes([x]) for x in range(256)])
    assert np.exp(before - after).sum() == pytest.approx(1.0, abs=1e-4)


def test_rare_contexts_are_learned_from(spark):
    """A pair seen once in four million bytes has its cell, whatever its share of the corpus."""
    key = int.from_bytes(b"abcde")
    often = int.from_bytes(b"zzzzz")
    grams = [(1, None, k, n) for k, n in ((key, 1), (often, 4_000_000), (lmscore._WORD_TAG | 77 << 8 | 101, 1), (lmscore._WORD_TAG | 78 << 8 | 122, 4_000_000))]
    tables, codes, _ = lmscore.fit_predictors(spark.createDataFrame(grams, lmscore.GATHERED))
    for table, context in zip(tables, (int.from_bytes(b"bcd"), int.from_bytes(b"abcd"), 77), strict=True):
        line = int(lmscore._lines(np.array([context], np.uint32))[0])
        assert table[line + 1] != 0
    both = (np.array([int.from_bytes(b"bcd"), int.from_bytes(b"zzz")]), codes[np.array([101, 122])], np.array([1, 4_000_000]))
    assert (tables[0] == lmscore.odds_table(*both)).all()


def gathered(batches):
    """(token counts, pair counts) from the rows of ``counted``, and in how many rows they came."""
    tokens, pairs, rows = Counter(), Counter(), 0
    for b in batches:
        for kind, token, key, n in zip(*(c.to_pylist() for c in b.columns)):
            (pairs if kind else tokens)[key if kind else token] += n
            rows += 1
    return tokens, pairs, rows


def test_counts_do_not_depend_on_what_a_task_holds(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 12, rng.integers(1, 9))) for _ in range(rng.integers(0, 300))) for _ in range(80)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*texts, None, "", texts[0]])})
    tokens, pairs, rows = gathered(lmscore.counted(iter([batch])))
    monkeypatch.setattr(lmscore, "_FLUSH_KEYS", 512)
    monkeypatch.setattr(lmscore, "_FLUSH_TOKENS", 64)
    monkeypatch.setattr(lmscore, "_PIECE", 300)
    small = gathered(lmscore.counted(iter([batch])))
    assert small[:2] == (tokens, pairs) and small[2] > rows
    assert tokens == Counter(w for t in [*texts, "", "", texts[0]] for w in [*t.encode().split(), b"\n"])
    assert sum(n for k, n in pairs.items() if k < lmscore._WORD_TAG) == sum(n for k, n in pairs.items() if k >= lmscore._WORD_TAG) == sum(len(text_of(t)) for t in [*texts, "", "", texts[0]])


def test_a_counting_task_holds_little(monkeypatch):
    """Counting noise, in which nearly every pair is new, takes a bounded number of bytes a key that is held."""
    monkeypatch.setattr(lmscore, "_FLUSH_KEYS", 1 << 17)
    monkeypatch.setattr(lmscore, "_PIECE", 1 << 15)
    noise = np.random.default_rng(2).integers(33, 127, (400, 4000), np.uint8)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t.tobytes().decode() for t in noise])})
    tracemalloc.start()
    try:
        for _ in lmscore.counted(iter([batch])):
            pass
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 100 * lmscore._FLUSH_KEYS


def test_known_tokens_and_others_of_texts():
    """As counted word by word, with tokens that are heavy, that are not, and texts without words; the end may be either."""
    texts = [b"the cat the mat the\n", b"\n", b"zebra \xc3\xa9 zebra\n", b"cat\n", b"\n"]
    for heavy in ({b"the": -1.0, b"cat": -2.5, b"\n": -0.5}, {b"the": -1.0, b"unseen": -9.0}, {}):
        known_tokens = pa.array(list(heavy), pa.large_binary())
        n, known, base, others, times = lmscore.known_and_others(texts, known_tokens, np.array(list(heavy.values())))
        for k, text in enumerate(texts):
            tokens = [*text.split(), b"\n"]
            assert (n[k], known[k]) == (len(tokens), sum(t in heavy for t in tokens))
            assert base[k] == pytest.approx(sum(heavy.get(t, 0.0) for t in tokens))
            assert dict(zip(others[k].as_py(), times[k].as_py(), strict=True)) == Counter(t for t in tokens if t not in heavy)


def test_no_python_step_per_word():
    """Words are looked up in arrays: ten thousand take as many lines of Python as ten."""

    def lines(n):
        steps = 0

        def trace(frame, event, arg):
            nonlocal steps
            steps += event == "line" and frame.f_code.co_filename == lmscore.__file__
            return trace

        text = b" ".join(b"w%d" % (k % 997) for k in range(n)) + b"\n"
        before = sys.gettrace()
        sys.settrace(trace)
        try:
            lmscore.known_and_others([text, text], pa.array([b"w1", b"w2"], pa.large_binary()), np.array([-1.0, -2.0]))
        finally:
            sys.settrace(before)
        return steps

    assert 0 < lines(10) == lines(10_000)


def test_one_look_finds_the_odds_of_a_code():
    """A line and code hold what the table has on the code's path, bit by bit."""
    tables, codes, more = plain_tables([b"abra cadabra abra\n", b"cad abra\n"])
    paths = lmscore.Mixer(tables, codes, more).paths.view(np.int8).reshape(len(tables), -1, lmscore.CODES, 8)
    for table, found in zip(tables, paths, strict=True):
        lines = table.reshape(-1, lmscore.CODES)
        for code in range(lmscore.CODES):
            for bit in range(6):
                assert (found[:, code, bit] == lines[:, (1 << bit) | (code >> (6 - bit))]).all()
