"""Registered queries: the streaming forms. Each must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtscope.functions import tokens as tok
from doubtscope.operators.scoring import infer_wide
from doubtscope.plans import fixtures as fx
from doubtscope.plans.catalog_learning import _STUB_SQL, _TURN_SRC, _turn_prompts, stub_model, weighed_logits
from doubtscope.plans.registry import query, shown
from doubtscope.session import fresh_path
from doubtscope.streaming.patience import run_to_table, stream_patience
from doubtscope.streaming.scoring import stream_resumable_score


@query(
    "stream_patience",
    f"""WITH {fx.TURN_NORMS_SQL}, {fx.PATIENCE_SQL} SELECT t.tid AS seq, round(mean, 9) AS mean, CAST(coalesce(tau, 0) AS INTEGER) AS tau, coalesce(triggered, false) AS triggered
        FROM turns t LEFT JOIN halt h ON h.tid = t.tid LEFT JOIN heap p ON p.tid = t.tid""",
)
def patience_stream(spark, sf):
    logits = fx.turn_logits(spark, sf)
    scores = logits.select("tid", F.transform("logits", tok.token_l2).alias("s"))
    rows = scores.select(
        F.col("tid").alias("seq"), F.posexplode(fx.some("s")).alias("pos", "score"), (F.size("s") - 1).alias("last")
    ).select("seq", F.col("pos").cast("bigint").alias("pos"), "score", (F.col("pos") == F.col("last")).alias("is_last"))
    root = fresh_path(spark, "stream")
    # files hold the tokens out of order; each file is a micro-batch
    rows.repartition(3, F.expr("pos % 3")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    run_to_table(stream_patience(stream, 5, 20), f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out")
    return out.select("seq", shown("mean").alias("mean"), "tau", "triggered")


@query(
    "stream_resumable_score",
    f"""WITH {_TURN_SRC}, {_STUB_SQL}, places AS (SELECT row_id, r, count(*) AS n, sum(logit * (j + 10 * t)) AS total FROM ord GROUP BY ALL)
        SELECT a.row_id, substr(d.h, 1, 8) AS answer_0, substr(d.h, 9, 8) AS answer_1, round(a.total, 6) AS logits_0, round(b.total, 6) AS logits_1
        FROM places a JOIN places b ON b.row_id = a.row_id AND a.r = 0 AND b.r = 1 JOIN dig d ON d.row_id = a.row_id""",
)
def scoring_stream(spark, sf):
    prompts = _turn_prompts(spark, sf)
    root = fresh_path(spark, "stream")
    prompts.repartition(4, "row_id").write.parquet(f"{root}/in")

    def start():
        stream = spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        query_ = stream_resumable_score(
            stream, f"{root}/out", lambda b: infer_wide(b, stub_model, 2), ["answer_0", "answer_1"], ["gen_topk_logits_0", "gen_topk_logits_1"]
        )
        query_.awaitTermination()

    start()
    start()  # nothing is new: nothing is added
    results, logits = spark.read.parquet(f"{root}/out/results"), spark.read.parquet(f"{root}/out/logits")
    return results.join(logits, "row_id").select("row_id", "answer_0", "answer_1", *[weighed_logits(i) for i in range(2)])
