"""The size of a sample does not follow from its rarest cell."""

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from doubtscope.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def with_rare(spark, tmp_path_factory):
    """A folder whose documents have one more, of one word, in a source of its own."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, "word", "en", "rare", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("rare"))
    table.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    return path


def test_one_rare_document_does_not_empty_the_sample(spark, with_rare):
    docs = spark.read.parquet(f"{with_rare}/documents.parquet")
    tokens = docs.select(mixing.n_tokens(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    mixed = queries.op7_mixing(spark, with_rare).toPandas()
    assert mixed.tokens.sum() > 0.05 * tokens and -1 in set(mixed.doc_id)


def test_pipeline_asks_for_a_share(spark, with_rare, monkeypatch):
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "keep_mixture", lambda docs, **kw: asked.update(kw) or docs)
    corpus_pipeline.mix(spark, spark.read.parquet(f"{with_rare}/documents.parquet"), SF)
    assert asked == {"share": mixing.SHARE}


def test_query_equals_its_sql_with_a_rare_source(spark, with_rare):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{with_rare}/documents.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["op7_mixing"]).fetchall(), key=str)
    got = queries.op7_mixing(spark, with_rare).select("doc_id", "source", "lang", "topic", "tokens", "p").collect()
    assert sorted(map(tuple, got), key=str) == want and len(want) > 20


def test_given_targets_are_reached(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = mixing.keyed(docs, F.col("text"), F.col("source"), F.col("lang"), mixing.format_topic(F.col("text")))
    sources = sorted(r.source for r in docs.select("source").distinct().collect() if r.source is not None)
    wanted = {"source": {s: 1.0 + k % 2 for k, s in enumerate(sources)} | {"not there": 5.0}, "lang": {"en": 2.0, "de": 1.0, "fr": 1.0, "es": 1.0}}
    told = mixing.marginals(marked, rounds=12, share=0.05, targets=wanted).toPandas()
    assert set(told.dimension) == set(mixing.DIMENSIONS) and told.groupby("dimension").target.sum().sub(1).abs().max() < 1e-9
    assert (told.target - told.reached).abs().max() < 0.02
    by = told[told.dimension == "source"].set_index("value").target
    assert by[sources[1]] == pytest.approx(2 * by[sources[0]]) and (set(by.index) - set(sources) == set() or by[mixing.MISSING] == 0)
    kept = mixing.sample_mixture(docs, share=0.05, targets={"source": {sources[0]: 1.0}}).where("__kept")
    assert {r.source for r in kept.select("source").distinct().collect()} == {sources[0]}


def test_columns_of_any_name_stay(spark):
    rows = [(k, "some words here", "en", "s", k, 0.5, "x") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __mix int, __p double, __kept string")
    kept = mixing.keep_mixture(docs, share=0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < 30 and kept.where("__mix != doc_id or __kept != 'x'").count() == 0
    assert mixing.keep_mixture(docs.limit(0), share=0.5).count() == 0


def test_expected_size(spark, with_rare):
    docs = spark.read.parquet(f"{with_rare}/documents.parquet")
    got = mixing.sample_mixture(docs, share=0.4).select("__mix.*", "__p").toPandas()
    assert got['__p'].max() <= 1.0 and (got.tokens * got['__p']).sum() == pytest.approx(0.4 * got.tokens.sum(), rel=1e-6)
