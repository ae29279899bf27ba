"""Registered queries: token scores and their aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from doubtscope.functions import tokens as tok
from doubtscope.operators.longform import patience_long
from doubtscope.operators.pairing import with_value
from doubtscope.operators.prompts import responses_long, responses_wide
from doubtscope.plans import fixtures as fx
from doubtscope.plans.registry import query, shown
from doubtscope.session import dealt

_TURN = f"WITH {fx.TURN_NORMS_SQL}"
_DOC = f"WITH {fx.DOC_NORMS_SQL}"
_PATIENCE = f"{_TURN}, {fx.PATIENCE_SQL}"


@query(
    "token_l2",
    f"""{_TURN} SELECT w.tid, CAST(w.p AS BIGINT) AS pos, round(n.s, 9) AS score
        FROM words w LEFT JOIN norms n ON n.tid = w.tid AND n.p = w.p""",
)
def token_l2(spark, sf):
    rows = fx.turn_logits(spark, sf).select("tid", F.posexplode("logits").alias("pos", "t"))
    return rows.select("tid", F.col("pos").cast("bigint").alias("pos"), shown(tok.token_l2(F.col("t"))).alias("score"))


@query(
    "seq_token_scores",
    f"""{_DOC} SELECT d.doc_id AS row_id, count(n.s) AS n_scores, round(coalesce(sum(n.s), 0), 6) AS total,
        count(n.s) = 0 AS is_null FROM documents d LEFT JOIN norms n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def seq_token_scores(spark, sf):
    s = fx.doc_logits(spark, sf).select("row_id", tok.seq_token_scores(F.col("logits")).alias("s"))
    return s.select(
        "row_id",
        F.coalesce(F.size("s"), F.lit(0)).cast("bigint").alias("n_scores"),
        F.round(F.coalesce(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), 6).alias("total"),
        F.col("s").isNull().alias("is_null"),
    )


def _topm_sql(m: int) -> str:
    return f"""{_DOC}, r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM norms)
        SELECT d.doc_id AS row_id, round(avg(CASE WHEN r.r <= {m} OR {m} <= 0 THEN r.s END), 9) AS unc
        FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("topm_mean", _topm_sql(5))
def topm_mean(spark, sf):
    s = fx.doc_logits(spark, sf).select("row_id", tok.seq_token_scores(F.col("logits")).alias("s"))
    return s.select("row_id", shown(tok.topm_mean(F.col("s"), 5)).alias("unc"))


@query("topm_mean_all", _topm_sql(0))
def topm_mean_all(spark, sf):
    s = fx.doc_logits(spark, sf).select("row_id", tok.seq_token_scores(F.col("logits")).alias("s"))
    return s.select("row_id", shown(tok.topm_mean(F.col("s"), 0)).alias("unc"))


@query(
    "topm_per_seq",
    f"""{_DOC}, r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM norms)
        SELECT doc_id AS row_id, r AS place, round(s, 9) AS score FROM r WHERE r <= 5""",
)
def topm_per_seq(spark, sf):
    s = fx.doc_logits(spark, sf).select("row_id", tok.seq_token_scores(F.col("logits")).alias("s"))
    top = s.select("row_id", F.posexplode(F.slice(F.sort_array("s", asc=False), 1, 5)).alias("i", "x"))
    return top.select("row_id", (F.col("i") + 1).cast("bigint").alias("place"), shown("x").alias("score"))


@query(
    "patience_agg",
    f"""{_PATIENCE} SELECT t.tid, round(mean, 9) AS unc, CAST(tau AS BIGINT) AS tau, triggered
        FROM turns t LEFT JOIN halt h ON h.tid = t.tid LEFT JOIN heap p ON p.tid = t.tid""",
)
def patience_agg(spark, sf):
    s = fx.turn_logits(spark, sf).select("tid", tok.seq_token_scores(F.col("logits")).alias("s"))
    run = s.select("tid", tok.patience_agg(F.col("s"), 5, 20).alias("r"))
    return run.select("tid", shown(F.col("r.mean")).alias("unc"), F.col("r.tau").cast("bigint").alias("tau"), "r.triggered")


@query(
    "patience_from_topk",
    f"""{_PATIENCE} SELECT t.tid, round(mean, 9) AS unc, CAST(tau AS BIGINT) AS tau, triggered
        FROM turns t LEFT JOIN halt h ON h.tid = t.tid LEFT JOIN heap p ON p.tid = t.tid""",
)
def patience_from_topk(spark, sf):
    run = fx.turn_logits(spark, sf).select("tid", tok.patience_from_topk(F.col("logits"), 5, 20).alias("r"))
    return run.select("tid", shown(F.col("r.mean")).alias("unc"), F.col("r.tau").cast("bigint").alias("tau"), "r.triggered")


@query(
    "patience_long",
    f"""{_PATIENCE} SELECT t.tid AS seq, round(mean, 9) AS unc, CAST(coalesce(tau, 0) AS BIGINT) AS tau, coalesce(triggered, false) AS triggered
        FROM turns t LEFT JOIN halt h ON h.tid = t.tid LEFT JOIN heap p ON p.tid = t.tid""",
)
def patience_rows(spark, sf):
    norms = fx.turn_logits(spark, sf).select(F.col("tid").alias("seq"), F.transform("logits", tok.token_l2).alias("s"))
    scored = norms.select("seq", F.posexplode(fx.some("s")).alias("pos", "score"))
    out = patience_long(scored, 5, 20, block=64)
    return out.select("seq", shown("mean").alias("unc"), F.col("tau").cast("bigint").alias("tau"), "triggered")


@query(
    "running_heap_floor",
    f"""{_TURN}, tok AS (SELECT tid, s, row_number() OVER (PARTITION BY tid ORDER BY p) AS t FROM norms),
    pre AS (SELECT a.tid, a.t, any_value(a.s) AS s,
                   list_sort(list(b.s) FILTER (b.s IS NOT NULL), 'DESC') AS before
            FROM tok a LEFT JOIN tok b ON b.tid = a.tid AND b.t < a.t GROUP BY a.tid, a.t)
    SELECT tid, t AS pos, round(s, 9) AS score, round(before[5], 9) AS floor,
           coalesce(s > before[5], true) AS updates FROM pre""",
)
def running_heap_floor(spark, sf):
    s = fx.turn_logits(spark, sf).select("tid", tok.seq_token_scores(F.col("logits")).alias("s"))
    rows = s.select("tid", F.posexplode(tok.running_floor(F.col("s"), 5)).alias("i", "f"))
    return rows.select(
        "tid", (F.col("i") + 1).cast("bigint").alias("pos"), shown(F.col("f.score")).alias("score"),
        shown(F.col("f.floor")).alias("floor"), "f.updates",
    )


@query(
    "patience_trace",
    f"""{_PATIENCE} SELECT h.tid, CAST(tau AS BIGINT) AS tau, n_tokens, round(CAST(tau AS DOUBLE) / n_tokens, 9) AS share_read,
        triggered FROM halt h""",
)
def patience_trace(spark, sf):
    s = with_value(fx.turn_logits(spark, sf).select("tid", tok.seq_token_scores(F.col("logits")).alias("s")), "s")
    run = s.select("tid", tok.patience_trace(F.col("s"), 5, 20).alias("r"))
    return run.select(
        "tid", F.col("r.tau").cast("bigint").alias("tau"), F.col("r.n_tokens").cast("bigint").alias("n_tokens"),
        shown(F.col("r.share_read")).alias("share_read"), "r.triggered",
    )


@query(
    "tokens_saved",
    f"""{_PATIENCE} SELECT t.role, round(avg(CAST(tau AS DOUBLE) / n_tokens), 9) AS share_read,
        round(avg(CASE WHEN triggered THEN 1 ELSE 0 END), 9) AS share_triggered
        FROM halt h JOIN turns t ON t.tid = h.tid GROUP BY t.role""",
)
def tokens_saved(spark, sf):
    s = with_value(fx.turn_logits(spark, sf).select("tid", tok.seq_token_scores(F.col("logits")).alias("s")), "s")
    run = s.select("tid", tok.patience_trace(F.col("s"), 5, 20).alias("r"))
    return run.join(fx.turns(spark, sf).select("tid", "role"), "tid").groupBy("role").agg(
        shown(F.avg("r.share_read")).alias("share_read"),
        shown(F.avg(F.col("r.triggered").cast("double"))).alias("share_triggered"),
    )


CANDIDATES = 24  # more than are kept


def _with_candidates(t, text="text"):
    """Add ``candidates``: CANDIDATES candidates per word; ranks known in even turns; the chosen one (rank 0) last."""
    n = CANDIDATES
    counted, chosen = F.lit(np.arange(n - 1, -1, -1, dtype=np.int32)), F.concat(F.array_repeat(F.lit(None).cast("int"), n - 1), F.array(F.lit(0)))
    ranks = F.when(F.col("tid") % 2 == 0, counted).otherwise(chosen)
    endings = F.lit([f"#{j}" for j in range(n)])

    def token(w, p):
        p = p.cast("bigint")
        total = F.col("tid") * 13 + p * 37 + F.length(w) * 7
        odd = F.transform(F.lit(np.arange(n)), lambda j: ((total + j * 101) % 40).cast("double") / 4.0 - 5.0)
        values = F.arrays_zip(
            F.when(total >= 0, fx.cycled(total, 101, 40, 4.0, 5.0, n)).otherwise(odd).alias("logprob"),
            F.transform(endings, lambda e: F.concat(w, e)).alias("decoded_token"),
            ranks.alias("rank"),
        )
        cand = F.map_from_arrays(F.sequence(p * 100, p * 100 + (n - 1)), values)
        return F.when((F.col("tid") + p) % 61 != 0, cand)

    return t.withColumn("candidates", F.transform(F.split(text, " "), token))


def _candidates(spark, sf):
    """(tid, candidates)."""
    return _with_candidates(dealt(fx.turns(spark, sf), 4)).select("tid", "candidates")


_CAND_SQL = f"""WITH {fx.TURNS_SQL},
words AS (SELECT tid, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM turns),
cand AS (SELECT tid, p, j, p * 100 + j AS token_id, w || '#' || j AS token,
                CAST((tid * 13 + p * 37 + j * 101 + length(w) * 7) % 40 AS DOUBLE) / 4 - 5 AS logit,
                CASE WHEN tid % 2 = 0 THEN {CANDIDATES - 1} - j WHEN j = {CANDIDATES - 1} THEN 0 END AS rank
         FROM words, range({CANDIDATES}) r(j) WHERE (tid + p) % 61 <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY tid, p ORDER BY
                CASE WHEN tid % 2 = 0 THEN CAST(rank AS DOUBLE) ELSE -logit END, j) AS place FROM cand),
kept AS (SELECT tid, p, token_id, token, logit, rank,
                row_number() OVER (PARTITION BY tid, p ORDER BY place) AS place FROM ordered
         WHERE place <= {tok.TOPK_DEFAULT} OR rank = 0)"""


@query(
    "topk_entries",
    f"""{_CAND_SQL} SELECT tid, CAST(p AS BIGINT) AS pos, place, CAST(token_id AS BIGINT) AS token_id, token, logit,
        CAST(coalesce(rank, -1) AS INTEGER) AS rank FROM kept""",
)
def topk_entries(spark, sf):
    e = _candidates(spark, sf).select("tid", F.posexplode(tok.topk_entries(F.col("candidates"), tok.TOPK_DEFAULT)).alias("pos", "t"))
    rows = e.select("tid", "pos", F.posexplode("t").alias("i", "e"))
    return rows.select(
        "tid", F.col("pos").cast("bigint").alias("pos"), (F.col("i") + 1).cast("bigint").alias("place"), "e.*"
    ).withColumn("rank", F.coalesce("rank", F.lit(-1)))


@query(
    "topk_per_token",
    f"""{_CAND_SQL} SELECT tid, CAST(p AS BIGINT) AS pos, count(*) AS n_kept, max(logit) AS top_logit, round(avg(logit), 9) AS mean_logit
        FROM ordered WHERE place <= {tok.TOPK_DEFAULT} GROUP BY tid, p""",
)
def topk_per_token(spark, sf):
    c = _candidates(spark, sf)
    e = c.select("tid", F.posexplode(tok.topk_entries(F.col("candidates"), tok.TOPK_DEFAULT, chosen_rank=-1)).alias("pos", "t"))
    logits = F.col("t.logit")
    return e.filter("t is not null").select(
        "tid",
        F.col("pos").cast("bigint").alias("pos"),
        F.size("t").cast("bigint").alias("n_kept"),
        F.array_max(logits).alias("top_logit"),
        shown(F.aggregate(logits, F.lit(0.0), lambda a, x: a + x) / F.size("t")).alias("mean_logit"),
    )


@query(
    "answer_fields",
    f"""{_CAND_SQL}, n AS (SELECT tid, max(p) AS last FROM words GROUP BY tid)
        SELECT t.tid, regexp_replace(chr(9) || ' ' || t.text || chr(10) || chr(160), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') AS answer,
               CAST(n.last AS INTEGER) AS answer_token_index, k.token AS last_token, k.logit AS last_logit
        FROM turns t JOIN n ON n.tid = t.tid LEFT JOIN kept k ON k.tid = n.tid AND k.p = n.last AND k.place = 1""",
)
def answer_fields(spark, sf):
    from doubtscope.operators.scoring import answer_fields as fields

    # texts are joined, not the candidates made from them
    t = fx.turns(spark, sf).select("tid", "text")
    c = _with_candidates(dealt(t.withColumnRenamed("text", "words"), 4).join(t, "tid"), "words").drop("words")
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n "))
    f = fields(c.withColumn("generated_text", padded))
    first = F.get(F.get(F.col("answer_token_topk_logits"), F.lit(0)), F.lit(0))
    return f.select("tid", "answer", "answer_token_index", first["token"].alias("last_token"), first["logit"].alias("last_logit"))


def _long_responses(spark, sf):
    t = fx.turns(spark, sf)
    r = t.select("tid", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("response_idx"))
    return r.filter((F.col("tid") + F.col("response_idx")) % 5 != 0).select(
        "tid", "response_idx", F.concat(F.col("text"), F.lit(" /"), F.col("response_idx")).alias("answer"),
        (F.length("text") + F.col("response_idx")).alias("answer_token_index"),
    )


_LONG_SQL = f"""WITH {fx.TURNS_SQL},
resp AS (SELECT tid, i, text || ' /' || i AS answer, CAST(length(text) + i AS INTEGER) AS n_last FROM turns, range(3) r(i)
         WHERE (tid + i) % 5 <> 0)"""


@query(
    "responses_wide",
    f"""{_LONG_SQL} SELECT tid, {", ".join(
        f"max(answer) FILTER (i = {i}) AS answer_{i}, coalesce(max(n_last) FILTER (i = {i}), -1) AS answer_token_index_{i}" for i in range(3))}
        FROM resp GROUP BY tid""",
)
def wide(spark, sf):
    w = responses_wide(_long_responses(spark, sf), 3, ["answer", "answer_token_index"], ["tid"])
    return w.fillna(-1, [f"answer_token_index_{i}" for i in range(3)])


@query(
    "responses_long",
    f"{_LONG_SQL} SELECT tid, CAST(i AS INTEGER) AS response_idx, answer, n_last AS answer_token_index FROM resp",
)
def long_again(spark, sf):
    fields = ["answer", "answer_token_index"]
    return responses_long(responses_wide(_long_responses(spark, sf), 3, fields, ["tid"]), 3, fields, ["tid"])
