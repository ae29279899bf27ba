import pytest
from pyspark.sql import functions as F

from doubtscope import session
from doubtscope.operators.labels import compute_labels
from doubtscope.operators.scoring import infer_wide
from doubtscope.plans import evaluate as ev
from doubtscope.sources import artifacts as ar
from doubtscope.sources import sharded as sh
from doubtscope.sources import shards as sw
from doubtscope.sources.corpus import CORPUS_SCHEMA, numbered_samples


def test_stem_file_directory_and_missing(spark, root):
    spark.range(5).coalesce(1).write.parquet(f"{root}/one.parquet")
    for path in (f"{root}/one.parquet", f"{root}/one"):
        assert sh.read_sharded(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        sh.read_sharded(spark, f"{root}/none")
    assert sh.first_readable(spark, [f"{root}/none", f"{root}/one"]).count() == 5
    assert sh.first_readable(spark, [f"{root}/none"]) is None


def test_shards_are_united_and_partials_left_out(spark, root):
    spark.range(0, 3).coalesce(1).write.parquet(f"{root}/t-0000-of-0002.parquet")
    spark.range(3, 7).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("more")).coalesce(1).write.parquet(
        f"{root}/t-0001-of-0002.parquet")
    spark.range(90, 95).write.parquet(f"{root}/t-0001-of-0002.partial.parquet")
    df = sh.read_sharded(spark, f"{root}/t")
    assert dict(df.dtypes)["id"] == "bigint"
    rows = df.orderBy("row_id").collect()
    assert [r["id"] for r in rows] == list(range(7)) == [r["row_id"] for r in rows]
    assert [r["more"] for r in rows] == [None] * 3 + ["x"] * 4
    assert [(r["shard_idx"], r["row_index"]) for r in rows][3] == (1, 0)


def test_only_asked_columns_are_scanned(spark, root):
    spark.range(4).select("id", F.lit(1).alias("a"), F.lit(2).alias("b")).write.parquet(f"{root}/t.parquet")
    df = sh.read_sharded(spark, f"{root}/t", ["a", "gone"])
    assert df.columns[:2] == ["a", "gone"] and df.filter("gone is null").count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "a:int" in scan and "b:int" not in scan and "id:" not in scan
    assert "BroadcastHashJoin" in plan  # the table itself is not shuffled to get its row numbers


def _job(spark, root, n=25, per=10, fail=None, seen=None):
    rows = spark.range(n).withColumnRenamed("id", "row_id")

    def produce(df):
        if seen is not None:
            seen.append(sorted(r[0] for r in df.select("shard_idx").distinct().collect()))
        out = df.withColumn("answer_0", F.col("row_id").cast("string")).withColumn("gen_topk_logits_0", F.array(F.lit(1.0)))
        return out if fail is None else out.filter(F.col("row_id") != fail)

    return sw.resumable_sharded_write(rows, root, produce, ["answer_0"], ["gen_topk_logits_0"], per)


def test_resume_processes_only_what_is_missing(spark, root):
    seen = []
    with pytest.raises(RuntimeError, match=r"\[1\]"):
        _job(spark, root, fail=13, seen=seen)
    assert seen == [[0, 1, 2], [1]]  # the whole shards of the wave were kept, the bad one tried again
    seen.clear()
    manifest = _job(spark, root, seen=seen)
    assert seen == [[1]]
    assert sorted((r["shard_idx"], r["expected_rows"]) for r in manifest.collect()) == [(0, 10), (1, 10), (2, 5)]
    seen.clear()
    assert _job(spark, root, seen=seen).count() == 3 and seen == []
    results = spark.read.parquet(f"{root}/results")
    assert results.count() == 25 and results.select("row_id").distinct().count() == 25
    # a shard whose logits lost rows is done again, and only that one
    one = spark.createDataFrame([(20, 2, [1.0])], "row_id bigint, shard_idx int, gen_topk_logits_0 array<double>")
    sw.write_partitions(one, f"{root}/logits")
    _job(spark, root, seen=seen)
    assert seen == [[2]]
    assert spark.read.parquet(f"{root}/logits").count() == 25


def test_run_record_and_counts_while_writing(spark, root, monkeypatch):
    read = []
    kept = sw.read_if_there
    monkeypatch.setattr(sw, "read_if_there", lambda spark, path, schema=None: read.append(path) or kept(spark, path, schema))
    with pytest.raises(RuntimeError):
        _job(spark, root, fail=3)
    assert sw.run_record(spark, root) is None
    manifest = _job(spark, root)
    record = sw.run_record(spark, root)
    assert (record["num_samples"], record["n_shards"]) == (25, 3) and record["inference_time"] > 0
    told = {r["shard_idx"]: (r["written_rows_results"], r["written_rows_logits"]) for r in manifest.collect()}
    there = {r["shard_idx"]: r["n"] for r in spark.read.parquet(f"{root}/results").groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert told == {k: (n, n) for k, n in there.items()} == {0: (10, 10), 1: (10, 10), 2: (5, 5)}
    read.clear()
    rows = spark.range(25).withColumnRenamed("id", "row_id")
    again = sw.resumable_sharded_write(rows, root, None, [], [], 10, skip_if_recorded=True)
    assert again.count() == 3 and read == []


def _model_job(spark, root, bad=None, per=10, wave=3, asked=None):
    """100 prompts in 10 shards through a model that refuses one of them; counts what it is asked."""

    def model(texts):
        if bad is not None and f"p{bad}" in texts:
            raise ValueError("cannot answer")
        if asked is not None:
            asked.add(len(texts))
        return [[(t + "!", [{1: {"logprob": 1.0, "decoded_token": t, "rank": 0}}])] for t in texts]

    samples = spark.range(100).select(
        F.col("id").alias("row_id"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("p"), "id").alias("content"))).alias("prompt")
    )
    return sw.resumable_sharded_write(
        samples, root, lambda rows: infer_wide(rows, model, 1), ["answer_0"], ["gen_topk_logits_0"], per, shards_per_wave=wave, chunk_rows=4
    )


@pytest.mark.parametrize("wave", [1, 4])
def test_a_failing_row_costs_its_shard_only(spark, root, wave):
    with pytest.raises(Exception, match="cannot answer"):
        _model_job(spark, root, bad=85, wave=wave)
    kept = spark.read.parquet(f"{root}/manifest")
    assert sorted(r["shard_idx"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    asked = spark.sparkContext.accumulator(0)
    _model_job(spark, root, asked=asked, wave=wave)
    assert asked.value == 10
    results, logits = sh.read_sharded(spark, f"{root}/results"), sh.scan_topk_column(spark, f"{root}/logits")
    both = results.join(logits, "row_id").select("row_id", "answer_0", F.col("logits")[0][0]["token"].alias("token")).collect()
    assert len(both) == 100 and all(r["answer_0"] == f"p{r['row_id']}!" and r["token"] == f"p{r['row_id']}" for r in both)


def test_stored_row_ids_win(spark, root):
    rows = spark.range(240).select(F.col("id").alias("row_id"), F.expr("cast(id div 20 as int)").alias("shard_idx"), (F.col("id") * 3).alias("v"))
    rows.repartition(5, F.expr("hash(v)")).write.partitionBy("shard_idx").parquet(f"{root}/t")
    got = sh.read_sharded(spark, f"{root}/t").collect()
    assert sorted((r["row_id"], r["shard_idx"], r["v"]) for r in got) == [(i, i // 20, 3 * i) for i in range(240)]


@pytest.mark.parametrize("name", ["with space", "per%20cent", "é", "a+b"])
def test_odd_folder_names(spark, root, name):
    spark.range(0, 3).coalesce(1).write.parquet(f"{root}/{name}/t-0009-of-0011.parquet")
    spark.range(3, 6).coalesce(1).write.parquet(f"{root}/{name}/t-0010-of-0011.parquet")
    got = sh.read_sharded(spark, f"{root}/{name}/t").orderBy("row_id").collect()
    assert [(r["id"], r["row_id"], r["shard_idx"]) for r in got] == [(i, i, 9 + i // 3) for i in range(6)]


def test_files_without_order_are_refused(spark, root):
    import os
    import shutil

    spark.range(4).coalesce(1).write.parquet(f"{root}/x")
    part = next(f for f in os.listdir(f"{root}/x") if f.endswith(".parquet"))
    os.makedirs(f"{root}/t-0000-of-0001.parquet")
    for name in ("a.parquet", "b.parquet"):
        shutil.copy(f"{root}/x/{part}", f"{root}/t-0000-of-0001.parquet/{name}")
    with pytest.raises(ValueError, match="no known order"):
        sh.read_sharded(spark, f"{root}/t")


def test_missing_response_gives_null_scores(spark, root):
    out = spark.createDataFrame([(0, "a", "a", [[(1, "a", 2.0, 0)]]), (1, "b", "c", [[(1, "a", 1.0, 0)]])],
                                "row_id bigint, label string, answer_1 string, gen_topk_logits_0 " + sh.LOGITS_TYPE)
    ar.write_result_tables(out, root, ["label", "answer_1"], ["gen_topk_logits_0"])
    for logits in (f"{root}/logits", f"{root}/none", None):
        m = ev.evaluate_files(spark, f"{root}/results", logits, "mmlu", 1).first()
        assert m["mean"] != m["mean"] and m["auroc"] == 0.5


def test_candidates_are_found_and_bad_ones_skipped(spark, root):
    head = f"{root}/qa/qa_32k_"
    for name in ("m2_raw_nres-1_set-test-0000-of-0002", "m2_raw_nres-1_set-test-0001-of-0002", "m3_raw_nres-1_set-test", "m3_raw_nres-1_logits_set-test", "m1_raw_nres-1_set-train"):
        spark.range(2).coalesce(1).write.parquet(f"{head}{name}.parquet")
    with open(f"{head}m0_raw_nres-1_set-test.parquet", "w") as f:
        f.write("no parquet")
    stems = sh.find_artifacts(spark, root, "qa", "test", "32k", "raw", "1")
    assert [s.rsplit("/", 1)[1] for s in stems] == [f"qa_32k_m{k}_raw_nres-1_set-test" for k in (0, 3, 2)]
    assert sh.first_readable(spark, stems).count() == 2


def test_crashed_embeddings_are_written_again(spark, root):
    import os

    df = spark.createDataFrame([(0, "p", "l", [1.0, 2.0])], "row_id bigint, prompt string, label string, embedding array<float>")
    os.makedirs(f"{root}/e/_temporary/0")
    ar.write_embeddings(df, f"{root}/e")
    assert ar.read_embeddings(spark, f"{root}/e").count() == 1
    ar.write_embeddings(df.limit(0), f"{root}/e")
    assert ar.read_embeddings(spark, f"{root}/e").count() == 1


def test_no_logits_are_shuffled(spark):
    rows = spark.range(8).select(F.col("id").alias("row_id"), F.array(F.struct(F.lit("u").alias("role"), F.lit("x").alias("content"))).alias("prompt"))
    plan = infer_wide(rows, lambda texts: [[] for _ in texts], 2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_prompts_are_not_shuffled_for_numbers(spark):
    corpus = spark.createDataFrame([(0, "s", ["q", "r"], (["a", "b", "c"],)), (1, None, None, None), (2, "t", ["v"], (["w"],))], "row_id bigint, " + CORPUS_SCHEMA.replace("source string, ", ""))
    samples = numbered_samples(corpus, "test", validation=corpus)
    assert [(r["corpus_row"], r["qa_idx"], r["row_id"]) for r in samples.orderBy("row_id").collect()] == [(0, 0, 0), (0, 1, 1), (2, 0, 2)]
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # numbers are joined to stories, below the prompts


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_changed_plan_is_refused(spark, root):
    _job(spark, root)
    with pytest.raises(ValueError, match="rows per shard"):
        _job(spark, root, per=5)
    with pytest.raises(ValueError, match="number of rows"):
        _job(spark, root, n=26)


def test_label_store_keeps_keys_apart(spark, root):
    def make(v):
        return lambda: spark.range(3).select(F.col("id").alias("row_id"), F.lit(v).cast("float").alias("label"))

    key = {"label_fn": "topm_norm", "topk": 5, "response_idx": 0, "split": "val"}
    ar.stored_labels(spark, f"{root}/l", key, make(1.0))
    ar.stored_labels(spark, f"{root}/l", {**key, "response_idx": 1}, make(2.0))
    again = ar.stored_labels(spark, f"{root}/l", key, make(9.0))
    assert {r["label"] for r in again.collect()} == {1.0}


def test_labels_drop_rows_without_tokens(spark):
    logits = spark.createDataFrame([(0, [[(3.0,), (4.0,)]]), (1, []), (2, None)], "row_id bigint, logits array<array<struct<logit:double>>>")
    got = compute_labels(logits.select("row_id"), logits, "topm_norm").collect()
    assert [(r["row_id"], r["label"]) for r in got] == [(0, 5.0)]
    with pytest.raises(ValueError, match="needs a logits"):
        compute_labels(logits.select("row_id"), None, "topm_norm")


def test_embedding_table(spark, root):
    df = spark.createDataFrame([(0, "p", "l", [1.0, 2.0]), (1, "p", "l", [1.0])], "row_id bigint, prompt string, label string, embedding array<float>")
    ar.write_embeddings(df.limit(1), f"{root}/a")
    assert ar.read_embeddings(spark, f"{root}/a").count() == 1
    ar.write_embeddings(df, f"{root}/b")
    with pytest.raises(ValueError, match="widths"):
        ar.read_embeddings(spark, f"{root}/b")
    with pytest.raises(FileNotFoundError):
        ar.read_embeddings(spark, f"{root}/c")


def test_logits_lie_on_disk_a_shard_at_a_time(spark, tmp_path, monkeypatch):
    """Every shard is written, scanned and removed before the next; ids that repeat or are null, null and empty texts."""
    from doubtscope.functions import tokens as tok
    from doubtscope.plans import catalog_sources as cs
    from doubtscope.plans import fixtures as fx

    rows = [(i if i % 5 else None, " ".join(["w" * (1 + (i + k) % 7) for k in range(i)]) if i % 11 else None) for i in range(40)] + [(7, "a b c"), (7, "a b c"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    on_disk, written, real = [], [], sh.scan_topk_column

    def scan(spark, path, at):
        on_disk.append(len({f.rsplit("/", 2)[-2] for f in sh.list_table_files(spark, path)}))
        found = real(spark, path, at)
        written.append(found.count())
        return found

    monkeypatch.setattr(cs.sh, "scan_topk_column", scan)
    monkeypatch.setattr(cs, "SHARD_CHARS", 100)
    monkeypatch.setattr(cs, "MOST_SHARDS", 3)
    kept = []
    monkeypatch.setattr(cs, "fresh_path", lambda spark, name: kept.append(str(tmp_path / name)) or kept[-1])
    got = cs.scan_topk_column(spark, str(tmp_path)).collect()
    assert on_disk == [1, 1, 1] and sum(written) == len(rows) and not list(tmp_path.glob("logits*"))
    want = fx.doc_logits(spark, str(tmp_path)).select("row_id", F.posexplode(F.transform("logits", tok.token_l2))).filter("col is not null").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r[0], r[1], round(r[2], 9))) for r in want)
