"""Plans and files whose size must not run away on larger tables."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from doubtscope.functions import tokens as tok
from doubtscope.operators import resample, scoring
from doubtscope.plans import fixtures as fx
from doubtscope.sources import shards as sw


def test_logits_are_written_in_short_row_groups(spark, root):
    rows = spark.range(0, 500, 1, 1).select(F.col("id").alias("row_id"), F.expr("cast(id div 500 as int) as shard_idx"))
    made = rows.withColumn("answer_0", F.lit("a")).withColumn("gen_topk_logits_0", F.lit([[1.0]]))
    sw.resumable_sharded_write(rows.drop("shard_idx"), root, lambda d: made, ["answer_0"], ["gen_topk_logits_0"], 500)
    files = glob.glob(f"{root}/logits/**/*.parquet", recursive=True)
    sizes = [meta.row_group(i).num_rows for meta in (pq.ParquetFile(f).metadata for f in files) for i in range(meta.num_row_groups)]
    assert sum(sizes) == 500 and max(sizes) <= 64


def test_top_entries_order_each_token_once(spark):
    sql = tok.topk_entries(F.col("candidates"), 2)._jc.toString()
    assert sql.count("sort_array") == 1
    ddl = "candidates array<map<bigint,struct<logprob:double,decoded_token:string,rank:int>>>"
    cand = [{1: (1.0, "a", 2), 2: (9.0, "b", 1), 3: (5.0, "c", 0)}, {4: (None, "d", None), 5: (2.0, "e", 0), 6: (3.0, "f", None), 7: (9.0, "g", 7)}, {}, None]
    out = spark.createDataFrame([(cand,)], ddl).select(tok.topk_entries(F.col("candidates"), 2).alias("t")).first()["t"]
    assert [None if t is None else [e["token"] for e in t] for t in out] == [["c", "b"], ["g", "f", "e"], [], None]


@pytest.mark.parametrize("key", [0, 5, 96, 89, -7, -97, None])
def test_logits_of_a_constant_cycle_equal_the_formula(spark, key):
    words = ["a", "bb", "", "dddd", "eé"] * 40
    d = spark.createDataFrame([(key, words)], "k bigint, w array<string>")
    made = d.select(fx.words_to_logits(F.col("k"), F.col("w"), 20).alias("t")).first()["t"]

    def rem(x):  # as Java: towards zero
        return abs(x) % 161 * (-1 if x < 0 else 1)

    for p, (w, token) in enumerate(zip(words, made, strict=True)):
        if key is not None and (key * 31 + p) % 97 == 0:
            assert token is None
        elif key is not None and (key * 31 + p) % 89 == 0:
            assert token == []
        else:
            logits = [None if key is None else rem(key * 131 + p * 7919 + k * 104729 + len(w) * 15485863) / 4 - 15 for k in range(20)]
            assert [tuple(e) for e in token] == [(p * 100 + k, w, logits[k], k) for k in range(20)]


def test_logits_take_no_arithmetic_per_entry(spark):
    one = spark.createDataFrame([(3, ["a"])], "k bigint, w array<string>").select(fx.words_to_logits(F.col("k"), F.col("w")).alias("t"))
    assert "arrays_zip" in one._jdf.queryExecution().analyzed().toString()


def test_answer_fields_joins_texts_not_candidates(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    seen = []
    real = scoring.answer_fields
    monkeypatch.setattr(scoring, "answer_fields", lambda c, *a: seen.append(c) or real(c, *a))
    entry.queries()["answer_fields"](spark, sf_dir)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("map_from_arrays") < plan.index("Join")  # made above the join


def test_draws_are_counted_in_their_task(spark, monkeypatch):
    """The counts are those of a join with the draws, for several blocks, odd scores, missing and repeated rows."""
    values = [(0, i, None if i % 7 == 0 else float("nan") if i % 7 == 1 else float(i % 5), None if i == 11 else i % 3 > 0) for i in range(23)]
    values += [(1, i, -1.0 * i, True) for i in (0, 3, 3, 22, 9)]
    rows = spark.createDataFrame(values, "run_id int, row_index long, unc double, ok boolean")
    monkeypatch.setattr(resample, "BLOCK_ROWS", 8)
    cells = resample.drawn_cells(rows, 23, 40, {0: 5, 1: 6})
    assert "Range (0, 920" not in cells._jdf.queryExecution().optimizedPlan().toString()  # a row per draw
    got = sorted(map(str, cells.groupBy("run_id", "resample", "unc", "ok").agg(F.sum("times")).collect()))
    parts = [
        resample.resample_draws(spark, 23, 40, seed).join(rows.filter(f"run_id = {run}"), "row_index").groupBy("run_id", "resample", "unc", "ok").agg(F.count(F.lit(1)).alias("sum(times)"))
        for run, seed in ((0, 5), (1, 6))
    ]
    assert got == sorted(map(str, parts[0].unionByName(parts[1]).collect()))


@pytest.mark.parametrize("few,gaps", [(1 << 16, False), (0, False), (1 << 16, True)])
def test_many_rows_of_few_scores_are_one_block(spark, monkeypatch, few, gaps):
    """Draws are made once where codes are short, however many pieces the rows are packed in; else once a block."""
    values = [(0, i, None if i % 7 == 0 else float("nan") if i % 7 == 1 else -0.0 if i % 7 == 2 else float(i % 5), None if i == 11 else i % 3 > 0) for i in range(41)]
    values = [v for v in values if not gaps or v[1] not in (3, 4, 5, 6, 7, 19)] + [(0, 30, 5.0, True)] * gaps
    rows = spark.createDataFrame(values, "run_id int, row_index long, unc double, ok boolean")
    for name, x in (("BLOCK_ROWS", 8), ("PACK_ROWS", 4), ("FEW_CELLS", few), ("PIECE", 16)):
        monkeypatch.setattr(resample, name, x)
    dealt, parts = resample._dealt_blocks(rows, 41, 30, 1)
    assert dealt.select("block").distinct().count() == (1 if few and not gaps else 6) and dealt.select("piece").distinct().count() == (11 if few and not gaps else 2)
    spread = dealt.filter("block = 0 and piece = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == parts and {r["count"] for r in spread} == {1}
    drawn = resample.resample_draws(spark, 41, 30, 9).join(rows, "row_index").groupBy("resample", "unc", "ok").count().collect()
    got = resample.drawn_cells(rows, 41, 30, {0: 9}).groupBy("resample", "unc", "ok").agg(F.sum("times")).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in drawn)


def test_logits_of_a_token_are_looked_up(spark):
    one = spark.createDataFrame([(5,)], "total bigint").select(fx.cycled(F.col("total"), 101, 40, 4.0, 5.0, 24).alias("v"))
    assert "slice" not in one._jdf.queryExecution().analyzed().toString()  # copies its part of the array
    assert one.first()["v"] == [(5 + 101 * i) % 40 / 4 - 5 for i in range(24)]


def test_norm_takes_the_entries_once(spark):
    assert tok.token_l2(F.col("t"))._jc.toString().count("logit") == 1
    cases = [None, [], [None], [-1.0, None], [-0.0], [3.0, None, 4.0, -9.0], [float("nan"), 1.0], [float("inf"), float("-inf")]]
    rows = [(i, None if c is None else [(x,) for x in c]) for i, c in enumerate(cases)]
    out = spark.createDataFrame(rows, "i int, t array<struct<logit:double>>").select("i", tok.token_l2(F.col("t")).alias("s"))
    assert [str(r["s"]) for r in out.orderBy("i").collect()] == ["None", "None", "None", "0.0", "0.0", "5.0", "nan", "inf"]


def _made_in_filter(df):
    """Filters that make the logits, so that they are made twice."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "split(" in x]


@pytest.mark.parametrize("name", ["tokens_saved", "patience_trace"])
def test_scores_are_not_made_twice_for_a_filter(spark, sf_dir, name):
    import __spark_entry__ as entry

    assert not _made_in_filter(entry.queries()[name](spark, sf_dir))


def test_exploded_scores_are_not_made_twice(spark, sf_dir, monkeypatch):
    from doubtscope.plans import catalog_streams, catalog_tokens

    seen = []
    monkeypatch.setattr(catalog_tokens, "patience_long", lambda rows, *a, **k: seen.append(rows) or rows.selectExpr("seq", "score as mean", "1 as tau", "true as triggered"))
    catalog_tokens.patience_rows(spark, sf_dir)

    kept = type(seen[0]).repartition

    def dealt(self, *by):
        if len(by) == 1:
            return kept(self, *by)
        seen.append(self)  # the tokens, about to be written
        raise InterruptedError

    monkeypatch.setattr(type(seen[0]), "repartition", dealt)
    with pytest.raises(InterruptedError):
        catalog_streams.patience_stream(spark, sf_dir)
    assert len(seen) == 2 and not any(map(_made_in_filter, seen))


def test_labels_are_made_once_and_below_the_generator(spark, sf_dir):
    from doubtscope.operators import labels as lab

    logits = fx.doc_logits(spark, sf_dir)
    plan = lab.compute_labels(logits.select("row_id"), logits, "topm_norm")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1 and "sort_array" not in next(x for x in plan.splitlines() if "Generate" in x)


def test_a_null_value_drops_its_row(spark):
    from doubtscope.operators.pairing import with_value

    rows = spark.createDataFrame([(1, [2.0], "a"), (2, None, "b"), (3, [], "c")], "k int, s array<double>, t string")
    assert sorted(map(tuple, with_value(rows, "s").collect())) == [(1, [2.0], "a"), (3, [], "c")]


def test_labels_to_learn_from_are_stored(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry
    from doubtscope.operators import labels as lab

    def stop(labels, embeddings):
        assert "sort_array" not in labels._jdf.queryExecution().optimizedPlan().toString()
        raise InterruptedError

    monkeypatch.setattr(lab, "build_train_set", stop)
    with pytest.raises(InterruptedError):
        entry.queries()["learn_and_evaluate_steps"](spark, sf_dir)


def test_tokens_of_a_long_sequence_are_stored(spark, monkeypatch):
    from doubtscope.operators import longform

    seen = []
    kept = longform.stored
    monkeypatch.setattr(longform, "stored", lambda df, name: seen.append(name) or kept(df, name))
    rows = spark.createDataFrame([(1, i, float(i % 3)) for i in range(9)], "seq long, pos int, score double")
    assert longform.patience_long(rows, 2, 3, block=4).first()["tau"] == 9 and seen[0] == "long-tokens"


def test_tokens_of_a_stream_travel_in_three_columns(spark, root):
    from doubtscope.streaming.patience import run_to_table, stream_patience

    ddl = "seq long, pos long, score double, is_last boolean"
    tokens = [(1, 1, None, None), (1, None, 9.0, False), (1, 2, 5.0, True), (1, 0, 1.0, False), (2, 0, None, True)]
    spark.createDataFrame(tokens, ddl).write.parquet(f"{root}/in")
    stream = stream_patience(spark.readStream.schema(ddl).parquet(f"{root}/in"), 2, 3)
    assert "score" in stream._jdf.queryExecution().analyzed().toString()
    taken = [x for x in stream._jdf.queryExecution().analyzed().toString().splitlines() if "Project [seq" in x][0]
    assert taken.count(" AS ") == 2 and "timestamp" not in taken  # mark and score
    run_to_table(stream, f"{root}/out", f"{root}/checkpoint")
    assert sorted(map(tuple, spark.read.parquet(f"{root}/out").collect())) == [(1, 3.0, 2, False), (2, None, 0, False)]


def test_one_long_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    """Of many splits of a file with one row group one holds every row; the logits are made in more tasks than that."""
    rows = {"conv_id": list(range(800)), "turn": [1] * 800, "role": ["user"] * 800, "text": [f"some words {i} and more" * 20 for i in range(800)]}
    rows |= {"doc_id": rows["conv_id"]}
    for name in ("conversations", "documents"):
        pq.write_table(pa.table(rows), tmp_path / f"{name}.parquet", row_group_size=1 << 20, compression="none")
    small = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        for made in (fx.turn_logits, fx.doc_logits):
            in_task = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
            assert in_task[0] < 200 and in_task[1] == 800
    finally:
        for k in small:
            spark.conf.unset(k)


@pytest.mark.parametrize("cuts", [None, {0: 2.0, 1: float("inf")}])
def test_measured_where_drawn_equals_ranked_cells(spark, monkeypatch, cuts):
    """One block is measured in its task, with no row per score and resample; so are odd scores, missing and repeated rows."""
    odd = {0: None, 1: float("nan"), 2: float("inf"), 3: float("-inf"), 4: -0.0}
    values = [(0, i, odd.get(i % 9, float(i % 5)), None if i == 11 else i % 3 > 0) for i in range(23)]
    values += [(1, i, -1.0 * (i % 4), i % 2 > 0) for i in (0, 3, 3, 22, 9)]
    rows = spark.createDataFrame(values, "run_id int, row_index long, unc double, ok boolean")
    found = []
    for whole in (resample.WHOLE_ROWS, 22):
        monkeypatch.setattr(resample, "WHOLE_ROWS", whole)
        made = resample._drawn_metrics(rows, 23, 40, {0: 5, 1: 6}, cuts)
        assert ("Window" in made._jdf.queryExecution().optimizedPlan().toString()) == (whole == 22)
        found.append({(r.run_id, r.resample): r[2:] for r in made.collect()})
    assert found[0].keys() == found[1].keys() and len({k[0] for k in found[0]}) == 2
    for k, x in found[0].items():
        assert x == pytest.approx(found[1][k], abs=1e-12)
