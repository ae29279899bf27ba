"""Compression classifier: held-out accuracy, rejection and its edges."""

import zlib

from doubtscope.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    judged = [r for r in got if r.held_out and r.lang is not None]
    assert sum(r.lang_pred == r.lang for r in judged) >= 0.97 * len(judged)
    assert all(0.0 <= r.score <= 1.0 for r in got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def lorem(k):
    en = ["the", "reading", "of", "thing", "other", "whether", "nation", "and"]
    de = ["der", "zeichen", "und", "schön", "keit", "über", "nicht", "auch"]
    words = en if k % 2 else de
    return " ".join(words[(k * 5 + j * j) % 8] + "" for j in range(60))


def test_edges(docs):
    rows = [(k, lorem(k), "en" if k % 2 else "de") for k in range(40)]
    odd = [(106, "½ ² Ⅷ ٣ _ — ③", "en"), (100, None, "en"), (101, "", "en"), (102, "123 -- 4", None), (103, lorem(1) * 400, None), (None, lorem(2), None), (5, lorem(5), "en"), (105, "Ωμέγα", None)]
    got = {}
    for r in language.identify(docs(rows + odd)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k in (100, 101, 102, 106):
        assert (got[k][0].lang_pred, got[k][0].score, got[k][0].rejected) == ("und", 0.0, True)
    assert got[103][0].lang_pred == "en" and got[None][0].lang_pred == "de" and len(got[5]) == 2
    assert got[105][0].lang_pred in ("en", "de")
    kept = language.keep_identified(docs(rows + odd))
    assert {r.doc_id for r in kept.collect()}.isdisjoint({100, 101, 102})
    assert kept.columns == docs([]).columns


def test_nothing_to_learn(docs):
    assert [r.lang_pred for r in language.identify(docs([(1, "words here", None)])).collect()] == ["und"]
    assert language.identify(docs([])).count() == 0


def test_held_out_labels_are_not_learned(docs):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 3 == 1)
    rows = [(k, lorem(k), "en" if k % 2 else "de") for k in range(30)] + [(held, "qqq zzz", "xx")]
    assert "xx" not in {r.lang_pred for r in language.identify(docs(rows)).collect()}


def test_case_does_not_matter():
    d = language.compressors({"de": lorem(0).encode(), "en": lorem(1).encode()})
    assert language.classify(lorem(3).upper().encode(), d, 0.0)[0] == "en"


def test_a_language_of_copies_learns_all_its_texts(spark):
    texts = "concat('copied words of text ', cast(id % 40 as string), ' here')"
    rows = spark.range(40_000).selectExpr(f"{texts} as text", "'xx' as lang").unionAll(spark.range(900).selectExpr("concat('single text ', cast(id as string)) as text", "'yy' as lang"))
    learned = {lang: content.split(b"\n") for lang, content in language.fit_dictionaries(rows).items()}
    assert len(set(learned["xx"])) == 40 and len(set(learned["yy"])) == 256
