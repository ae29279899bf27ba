"""BM25 with block-max WAND against full scoring, and whole searches against plain containment."""

import random

from doubtscope.llm import decontam

ITEM = "item_id long, text string, score double"


def full_scores(index, terms):
    out = {}
    for t in terms:
        for item, w in zip(*index.postings[t]):
            out[item] = out.get(item, 0.0) + w
    return out


def make_index(items):
    rows = [(k, decontam.words_of(t), None) for k, t in items]
    df = {}
    for _, ws, _ in rows:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    return decontam.build_segment(rows, df, len(rows), sum(len(w) for _, w, _ in rows) / len(rows)).indexes[0]


def test_wand_finds_what_full_scoring_finds(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 4)
    rng = random.Random(2)
    vocab = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    index = make_index([(k, " ".join(rng.choices(vocab, k=rng.randint(3, 50)))) for k in range(300)])
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 60)))
        for threshold in (0.05, 0.2, 0.6):
            want = {i: round(s, 9) for i, s in full_scores(index, terms).items() if s >= threshold}
            assert {i: round(s, 9) for i, s in decontam.block_max_wand(index, terms, threshold)} == want


def corpus():
    rng = random.Random(4)
    words = [f"word{k}" for k in range(2000)]
    items = [(k, " ".join(rng.choices(words, k=20 + k % 40))) for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([5, 80, 900, 5000])))) for k in range(80)]
    planted = []
    for k in range(30):
        body, item = docs[k][1].split(), items[k * 2][1].split()
        at = rng.randint(0, len(body))
        docs[k] = (k, " ".join(body[:at] + [w.upper() + "," * (j % 3 == 0) for j, w in enumerate(item)] + body[at:]))
        planted.append((k, k * 2))
    half = items[1][1].split()
    docs.append((500, " ".join(half[: len(half) // 2])))  # only the question
    return items, docs, planted


def test_planted_items_and_nothing_else(docs, make):
    items, rows, planted = corpus()
    item_rows = [(i, t, 0.0) for i, t in items] + [(900, None, 0.0), (901, "", 0.0), (None, "lonely question with no id at all here", 0.0)]
    table = docs([*rows, (600, None), (601, ""), (0, rows[0][1])])
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated_pairs(table, make(item_rows, ITEM)).collect())
    assert got == sorted([*planted, planted[0]])
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated_pairs(table, make(item_rows, ITEM), segment_words=300).collect()) == got
    kept = decontam.keep_clean(table, make(item_rows, ITEM))
    assert sorted(r.doc_id for r in kept.collect()) == sorted([k for k, _ in rows if k >= 30] + [600, 601])
    assert kept.columns == table.columns


def test_copies_with_changed_words(docs, make):
    items, rows, _ = corpus()
    changed = []
    for k, (i, text) in enumerate(items[:20]):
        words = text.split()
        for at in range(5, len(words), 11):
            words[at] = "other"
        changed.append((1000 + k, f"{rows[40 + k][1]} {' '.join(words)} {rows[60][1]}"))
    table, item_table = docs([*changed, *rows[40:80]]), make([(i, t, 0.0) for i, t in items], ITEM)
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated_pairs(table, item_table).collect())
    assert got == [(1000 + k, items[k][0]) for k in range(20)]


def test_question_and_answer_columns(docs, make):
    items = make([(1, "what is the name of the tall thing here", "the answer is a very tall tower")], "item_id long, text string, answer string")
    both = "what is the name of the tall thing here? well: the answer is a very tall tower."
    got = decontam.contaminated_pairs(docs([(1, both), (2, both[:40])]), items, item_answer="answer", threshold=0.3).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_empty_tables(docs, make):
    assert decontam.contaminated_pairs(docs([(1, "a")]), make([], ITEM)).count() == 0
    assert decontam.contaminated_pairs(docs([]), make([(1, "some words of an item", 0.0)], ITEM)).count() == 0
    assert decontam.keep_clean(docs([(1, "a")]), make([(1, None, 0.0)], ITEM)).count() == 1


def plainly_found(items, text, min_overlap=0.8):
    """Ids of the items of which question and answer are there: enough shingles anywhere, or words in order in one stretch."""
    words = decontam.words_of(text)
    have = decontam.shingles(words)
    out = []
    for i, t in items:
        units = decontam.units_of(decontam.words_of(t), None)

        def there(unit):
            marks = decontam.shingles(unit)
            if len(marks & have) >= min_overlap * len(marks):
                return True
            size = decontam.passage_words(unit)
            return any(decontam.lcs_length(unit, words[k : k + 2 * size]) >= min_overlap * len(unit) for k in range(0, max(1, len(words)), size // 2))

        if units and all(map(there, units)):
            out.append(i)
    return out


def test_search_against_a_plain_version(docs, make):
    """Halves apart, changed words, other items and other segments: always what a plain reading of every item finds."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=16 + 9 * k % 70))) for k in range(30)]
    rows = []
    for k, gap in enumerate((0, 100, 200, 600, 2500, 40, 300)):
        own = items[k][1].split()
        cut = (len(own) + 1) // 2
        fill = rng.choices(words, k=400)
        rows.append((k, " ".join(fill[:200] + own[:cut] + rng.choices(words, k=gap) + own[cut:] + fill[200:])))
        changed = list(own)
        changed[cut // 2] = "other"
        rows.append((100 + k, " ".join(fill[:90] + changed + fill[90:])))
        rows.append((200 + k, " ".join(fill[:150] + own[:cut] + fill[150:])))
    rows += [(300 + k, " ".join(rng.choices(words, k=700))) for k in range(6)]
    want = sorted((i, item) for i, t in rows for item in plainly_found(items, t))
    assert {(k, k) for k in range(7)} <= set(want) and not any(i >= 200 for i, _ in want)
    long_one = (999, " ".join(rng.choices([f"z{k}" for k in range(900)], k=700)))
    for more, segment in (([], 10**6), ([long_one], 10**6), ([], 300), ([long_one], 200)):
        table = make([(i, t, 0.0) for i, t in items + more], ITEM)
        assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated_pairs(docs(rows), table, segment_words=segment).collect()) == want
