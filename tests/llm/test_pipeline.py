"""The pipeline's stages against plain versions over what each got, and the entry points."""

import __spark_entry__ as entry
import compare
import corpus_pipeline
import pytest
import test_decontam
import test_simhash
from pyspark.sql import functions as F

from doubtscope.llm import language, mixing, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    why, _, _ = compare.differences(spark, compare.connect("/root/testdata/sf0.01"), name, "/root/testdata/sf0.01")
    assert not why


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.SQL) <= set(entry.oracle_sql())


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns if k < 4 else docs.columns == [*columns, "slot", "shard"]
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], docs.schema)
    start, told, single, clean, mixed, placed = ({r.doc_id: r for r in rows} for rows in seen)

    parts = language.fit_dictionaries(spark.createDataFrame(seen[0], columns_of(spark)).where(~language.held_out(F.col("doc_id"))))
    fixed = language.compressors(parts)
    assert set(told) == {i for i, r in start.items() if not language.classify(r.text.encode(), fixed, 0.002)[2]}

    prints = [(i, test_simhash.plain_fingerprint(r.text)) for i, r in told.items()]
    assert set(single) == set(test_simhash.plain_groups(prints, 4))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = test_decontam.decontam.words_of
    inside = lambda text: any(b" " + b" ".join(words(t)) + b" " in b" " + b" ".join(words(text)) + b" " for _, t in items)
    assert set(clean) == {i for i, r in single.items() if not inside(r.text)}

    drawn = mixing.sample_mixture(spark.createDataFrame(seen[3], columns_of(spark)), share=mixing.SHARE).where("__kept").collect()
    assert set(mixed) == {r.doc_id for r in drawn} and 0 < len(mixed) < len(clean)
    table = sharding.fill_table(corpus_pipeline.SHARDS, corpus_pipeline.SLOTS)
    assert set(placed) == set(mixed) and all(r.shard == corpus_pipeline.SHARDS[table[r.slot]] for r in placed.values())


def columns_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, root string"
    base = "the reading of thing other whether nation and again " * 4
    rows = [(None, base, None, None, None, 1, "r"), (None, None, "en", None, 0, 1, "r"), (3, base, "en", "s", 1, 1, "r"), (3, base, "en", "s", 1, 1, "r"), (4, "", "de", "s", 0, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns
            out.collect()
    twice = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in twice if r.text == base) == [("3", base)]


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-2:] == ["slot", "shard"] and out.count() > 0
