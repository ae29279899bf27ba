"""Registered queries: sharded tables, resumable writes, stored artifacts, pairing by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtscope.functions import tokens as tok
from doubtscope.operators import pairing as pr
from doubtscope.operators.labels import compute_labels
from doubtscope.operators.prefix import dense_index
from doubtscope.plans import fixtures as fx
from doubtscope.plans.registry import query, shown, table
from doubtscope.session import fresh_path, remove, stored
from doubtscope.sources import artifacts as ar
from doubtscope.sources import sharded as sh
from doubtscope.sources import shards as sw

SHARDS = 4


def _write_event_shards(spark, sf) -> str:
    """Events in shards of unequal layout: shard 1 has a column more, shard 2 a narrower type;
    a partial file lies beside them."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    total = e.agg(F.max("event_id").alias("m")).first()["m"] + 1
    size = -(-total // SHARDS)
    root = fresh_path(spark, "events")
    for i in range(SHARDS):
        part = e.filter((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size))
        if i == 1:
            part = part.withColumn("extra", F.concat(F.lit("x"), F.col("event_id")))
        if i == 2:
            part = part.withColumn("user_id", F.col("user_id").cast("int"))
        part.repartitionByRange(2, "event_id").sortWithinPartitions("event_id").write.parquet(
            f"{root}/events-{i:04d}-of-{SHARDS:04d}.parquet"
        )
    e.filter("event_id < 10").write.parquet(f"{root}/events-{SHARDS - 1:04d}-of-{SHARDS:04d}.partial.parquet")
    return f"{root}/events"


_SHARD_SQL = f"""s AS (SELECT *, (SELECT (max(event_id) + {SHARDS}) // {SHARDS} FROM events) AS size FROM events),
k AS (SELECT *, CAST(event_id // size AS INTEGER) AS shard_idx, event_id % size AS row_index FROM s)"""


@query(
    "read_sharded",
    f"""WITH {_SHARD_SQL} SELECT event_id, user_id, event_type, value, CASE WHEN shard_idx = 1 THEN 'x' || event_id END AS extra,
        shard_idx, row_index, event_id AS row_id FROM k""",
)
def read_sharded(spark, sf):
    return sh.read_sharded(spark, _write_event_shards(spark, sf))


@query("union_relaxed", f"""WITH {_SHARD_SQL} SELECT event_id, CAST(event_type AS VARCHAR) AS event_type, user_id,
       CASE WHEN shard_idx = 1 THEN value END AS value FROM k""")
def union_relaxed(spark, sf):
    e = table(spark, sf, "events")
    size = -(-(e.agg(F.max("event_id").alias("m")).first()["m"] + 1) // SHARDS)
    shard = F.floor(F.col("event_id") / size)
    tables = [
        e.filter(shard == i).select(
            "event_id", "event_type", F.col("user_id").cast("bigint" if i != 2 else "int").alias("user_id"),
            *(["value"] if i == 1 else []),
        )
        for i in range(SHARDS)
    ]
    return sh.union_relaxed(tables)


#: Characters of text whose logits lie on disk at a time, unless that takes more than MOST_SHARDS shards of at most SHARD_ROWS documents.
SHARD_CHARS, SHARD_ROWS, MOST_SHARDS = 1 << 25, 1 << 20, 16
#: Entries repeat much: zstd takes a third of snappy's room. Numbers of tokens do not: a dictionary of them takes more time and room than they do.
_COMPACT = sw.NESTED | {"compression": "zstd"} | {f"parquet.enable.dictionary#gen_topk_logits_{i}.list.element.list.element.token_id": "false" for i in (0, 1)}


def _scanned_shard(spark, stem, n, i, docs):
    """(doc_id, scores) of one shard of the logits table: written, scanned and removed."""
    path = f"{stem}-{i:04d}-of-{n:04d}.parquet"
    wide = fx.logits_of(docs).select(F.col("row_id").alias("doc_id"), F.col("logits").alias("gen_topk_logits_0"), F.col("logits").alias("gen_topk_logits_1"))
    try:
        wide.withColumnRenamed("doc_id", "answer_0").write.options(**_COMPACT).parquet(path)
        keys = sh.read_sharded(spark, stem, ["answer_0"]).select("row_id", F.col("answer_0").alias("doc_id"))
        logits = sh.scan_topk_column(spark, stem, 0).select("row_id", "logits")
        scores = logits.select("row_id", F.transform("logits", tok.token_l2).alias("scores"))
        # a short row per document of a shard is sent to the tasks, so no score moves
        return stored(scores.join(F.broadcast(keys), "row_id").select("doc_id", "scores"), "logits-scores", sw.NESTED)
    finally:
        remove(spark, path)


@query(
    "scan_topk_column",
    f"""WITH {fx.DOC_NORMS_SQL} SELECT doc_id, p AS pos, round(s, 9) AS score FROM norms""",
)
def scan_topk_column(spark, sf):
    """The logits take some ten times the room of their documents, so their shards are written, scanned and removed in turn."""
    stem = fresh_path(spark, "logits")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, min(MOST_SHARDS, -(-size["chars"] // SHARD_CHARS)), -(-size["n"] // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    scored = sh.union_relaxed([_scanned_shard(spark, stem, n, i, docs.filter(shard == i) if n > 1 else docs) for i in range(n)])
    rows = scored.select("doc_id", F.posexplode(fx.some("scores")).alias("pos", "score"))
    return rows.filter("score is not null").select("doc_id", F.col("pos").cast("bigint").alias("pos"), shown("score").alias("score"))


def _upper_text(rows):
    return rows.select(
        "row_id", "shard_idx", F.upper("event_type").alias("answer_0"), F.array("value").alias("gen_topk_logits_0")
    )


_PLAN_SQL = """n AS (SELECT count(*) AS n, count(*) // 7 + 1 AS per FROM events),
plan AS (SELECT i AS shard_idx, i * per AS start_, least((i + 1) * per, n) AS end_ FROM n, range(7) r(i) WHERE i * per < n)"""


@query(
    "resumable_sharded_write",
    f"""WITH {_PLAN_SQL} SELECT CAST(shard_idx AS INTEGER) AS shard_idx, start_ AS start, end_ AS "end", end_ - start_ AS expected_rows,
        (SELECT count(*) FROM events WHERE event_id >= start_ AND event_id < end_) AS written_rows_results,
        (SELECT count(*) FROM events WHERE event_id >= start_ AND event_id < end_) AS written_rows_logits, true AS completed FROM plan""",
)
def resumable_sharded_write(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type", "value")
    root = fresh_path(spark, "job")
    per = e.count() // 7 + 1
    for _ in range(2):  # the second call finds every shard complete and adds nothing
        manifest = sw.resumable_sharded_write(e, root, _upper_text, ["answer_0"], ["gen_topk_logits_0"], per)
    return manifest.drop("n_shards")


@query(
    "shard_row_counts",
    f"""WITH {_PLAN_SQL} SELECT CAST(shard_idx AS INTEGER) AS shard_idx, end_ - start_ AS expected_rows,
        (SELECT count(*) FROM events WHERE event_id >= start_ AND event_id < end_ AND event_type <> 'view') AS n_rows FROM plan""",
)
def shard_row_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type")
    n = e.count()
    per = n // 7 + 1
    return sw.shard_row_counts(sw.with_shard(e, per).filter("event_type <> 'view'"), sw.shard_plan(spark, n, per))


_PENDING_SQL = """n AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
counts AS (SELECT o_orderkey // 100 AS shard_idx, count(*) FILTER (o_orderkey % 701 <> 5) AS c FROM orders GROUP BY 1),
plan AS (SELECT i AS shard_idx, least((i + 1) * 100, n) - i * 100 AS expected FROM n, range((SELECT (max(o_orderkey) + 100) // 100 FROM orders)) r(i))"""


def _order_shards(spark, sf):
    """Plan of 100 orders per shard, and the shards that hold all their rows; some lost one."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    plan = sw.shard_plan(spark, o.agg(F.max("row_id").alias("m")).first()["m"] + 1, 100)
    counts = sw.shard_row_counts(sw.with_shard(o, 100).filter("row_id % 701 <> 5"), plan)
    return plan, counts.filter("n_rows = expected_rows")


@query(
    "pending_shards",
    f"""WITH {_PENDING_SQL} SELECT CAST(p.shard_idx AS INTEGER) AS shard_idx, p.expected AS expected_rows FROM plan p
        LEFT JOIN counts c ON c.shard_idx = p.shard_idx WHERE coalesce(c.c, 0) <> p.expected""",
)
def pending_shards(spark, sf):
    plan, done = _order_shards(spark, sf)
    return sw.pending_shards(plan, done).select("shard_idx", "expected_rows")


@query(
    "shard_except",
    f"""WITH {_PENDING_SQL} SELECT CAST(shard_idx AS INTEGER) AS shard_idx FROM plan EXCEPT
        SELECT CAST(p.shard_idx AS INTEGER) FROM plan p JOIN counts c ON c.shard_idx = p.shard_idx AND c.c = p.expected""",
)
def shard_except(spark, sf):
    plan, done = _order_shards(spark, sf)
    return plan.select("shard_idx").exceptAll(done.select("shard_idx"))


@query("write_result_tables", """SELECT doc_id AS row_id, upper(lang) AS answer_0, n_chars, len(string_split(text, ' ')) AS n_tokens FROM documents""")
def write_result_tables(spark, sf):
    d = table(spark, sf, "documents")
    out = d.select(
        F.col("doc_id").alias("row_id"), F.upper("lang").alias("answer_0"), "n_chars",
        F.split("text", " ").alias("gen_topk_logits_0"),
    )
    root = fresh_path(spark, "tables")
    ar.write_result_tables(out, root, ["answer_0", "n_chars"], ["gen_topk_logits_0"])
    results, logits = spark.read.parquet(f"{root}/results"), spark.read.parquet(f"{root}/logits")
    return results.join(logits, "row_id").select(
        "row_id", "answer_0", "n_chars", F.size("gen_topk_logits_0").cast("bigint").alias("n_tokens")
    )


@query(
    "write_embeddings",
    """SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, len(embedding) AS width,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""",
)
def write_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    path = fresh_path(spark, "embeddings")
    rows = e.select(F.col("vec_id").alias("row_id"), F.lit("").alias("prompt"), F.col("label").cast("string").alias("label"), "embedding")
    ar.write_embeddings(rows, path)
    ar.write_embeddings(rows.filter("false"), path)  # the table is there: nothing happens
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return ar.read_embeddings(spark, path).select(
        "row_id", "label", F.size("embedding").cast("bigint").alias("width"), F.round(total, 6).alias("total")
    )


@query(
    "label_store",
    f"""WITH {fx.DOC_NORMS_SQL}, r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM norms)
        SELECT doc_id AS row_id, round(CAST(CAST(avg(s) AS FLOAT) AS DOUBLE), 4) AS label FROM r WHERE r <= 5 GROUP BY doc_id""",
)
def label_store(spark, sf):
    path = fresh_path(spark, "labels")
    logits = fx.doc_logits(spark, sf)
    results = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    key = {"label_fn": "topm_norm", "topk": 5, "response_idx": 0, "split": "train"}

    def refuse():
        raise AssertionError("the stored labels were not found")

    ar.stored_labels(spark, path, key, lambda: compute_labels(results, logits, "topm_norm", topk_worst=5))
    hit = ar.stored_labels(spark, path, key, refuse)
    return hit.select("row_id", F.round(F.col("label").cast("double"), 4).alias("label"))


@query(
    "metrics_sink",
    f"""WITH {fx.SCORES_SQL}, {fx.metrics_sql('scores', ['grp'])}
        SELECT grp, auroc, aurac, 'events' AS dataset, CAST(5 AS BIGINT) AS m, CAST(20 AS BIGINT) AS w FROM metrics""",
)
def metrics_sink(spark, sf):
    from doubtscope.operators.metrics import detection_table

    path = fresh_path(spark, "metrics")
    found = detection_table(fx.scores(spark, sf), ["grp"], metrics=["auroc", "aurac"])
    ar.write_metrics(found.withColumn("per_sample", F.array(F.lit(0.0))), path, dataset="events", m=5, w=20)
    back = spark.read.schema("grp bigint, auroc double, aurac double, dataset string, m bigint, w bigint").json(path)
    return back.select("grp", shown("auroc").alias("auroc"), shown("aurac").alias("aurac"), "dataset", "m", "w")


@query(
    "model_registry",
    """WITH r AS (SELECT CAST(vec_id AS INTEGER) AS seed, embedding, row_number() OVER (ORDER BY label DESC, vec_id) AS place FROM embeddings)
       SELECT seed, len(embedding) AS n_weights, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM r WHERE place = 1""",
)
def model_registry(spark, sf):
    e = table(spark, sf, "embeddings")
    weights = e.select(F.col("vec_id").cast("int").alias("seed"), F.col("embedding").cast("array<double>").alias("weights"))
    reports = e.select(F.col("vec_id").cast("int").alias("seed"), (F.col("label") / 9.0).alias("auroc"), F.col("vec_id").alias("ord"))
    path = fresh_path(spark, "registry")
    ar.register_best(weights, reports, "study", path)
    best = ar.read_best(spark, "study", path)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return best.select("seed", F.size("weights").cast("bigint").alias("n_weights"), F.round(total, 6).alias("total"))


@query(
    "study_report",
    """WITH s AS (SELECT o_orderstatus, CAST(month(o_orderdate) AS INTEGER) AS seed, avg(o_totalprice) AS auroc FROM orders GROUP BY ALL)
       SELECT 'orders' AS study, o_orderstatus, seed, round(auroc, 4) AS value FROM s
       UNION ALL SELECT 'orders', o_orderstatus, CAST(NULL AS INTEGER), round(avg(auroc), 4) FROM s GROUP BY o_orderstatus""",
)
def study_report(spark, sf):
    o = table(spark, sf, "orders").withColumn("seed", F.month("o_orderdate"))
    seeds = o.groupBy("o_orderstatus", "seed").agg(F.avg("o_totalprice").alias("auroc"))
    averaged = seeds.groupBy("o_orderstatus").agg(F.avg("auroc").alias("mean"))
    r = ar.study_report(seeds, averaged, "orders")
    each = r.select("study", F.explode("per_seed").alias("p")).select("study", "p.o_orderstatus", "p.seed", F.round("p.auroc", 4).alias("value"))
    mean = r.select("study", F.explode("averaged").alias("a"))
    return each.unionByName(mean.select("study", "a.o_orderstatus", F.lit(None).cast("int").alias("seed"), F.round("a.mean", 4).alias("value")))


@query(
    "dense_row_ids",
    f"""WITH {fx.TURNS_SQL} SELECT tid, role, row_number() OVER (ORDER BY tid) - 1 AS row_id FROM turns""",
)
def dense_row_ids(spark, sf):
    return dense_index(fx.turns(spark, sf).select("tid", "role"), "tid")


@query(
    "zip_result_logits",
    f"""WITH {fx.DOC_NORMS_SQL} SELECT d.doc_id AS row_id, d.lang, round(avg(n.s), 9) AS unc
        FROM documents d LEFT JOIN norms n ON n.doc_id = d.doc_id AND d.doc_id % 10 <> 3 GROUP BY ALL""",
)
def zip_result_logits(spark, sf):
    results = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    logits = fx.doc_logits(spark, sf).filter("row_id % 10 <> 3")
    out = pr.zip_result_logits(results, logits, tok.topm_mean(tok.seq_token_scores(F.col("logits")), 0))
    return out.select("row_id", "lang", shown("unc").alias("unc"))


@query(
    "labels_by_row",
    "SELECT d.doc_id AS row_id, d.source, l.quality AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def labels_by_row(spark, sf):
    results = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source", F.col("lang").alias("label"))
    given = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    return pr.with_labels_by_row(results, given)


@query(
    "attach_embeddings",
    """SELECT v.vec_id AS row_id, l.quality, round(CAST(v.embedding[1] AS DOUBLE), 6) AS first FROM embeddings v JOIN labels l ON l.doc_id = v.vec_id""",
)
def attach_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return pr.attach_embeddings(lab, e).select("row_id", "quality", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(
    "attach_correct_flags",
    "SELECT l.doc_id AS row_id, l.quality, d.lang = 'en' AS ok FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
)
def attach_correct_flags(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    flags = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), (F.col("lang") == "en").alias("ok"))
    return pr.attach_correct_flags(lab, flags)


