"""Inputs of the registered queries, derived from the given tables, in Spark and as SQL text.

Logits are multiples of 1/4, so sums of their squares are exact and both engines see equal norms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtscope.operators.network import hidden_size
from doubtscope.plans.registry import table
from doubtscope.session import dealt

TOP_ENTRIES = 20


def _logit(key: Column, pos: Column, k: Column, width: Column) -> Column:
    mixed = key * 131 + pos * 7919 + k * 104729 + width * 15485863
    return (mixed % 161).cast("double") / 4.0 - 15.0


def cycled(total: Column, step: int, modulus: int, scale: float, shift: float, n: int) -> Column:
    """``(total + i * step) % modulus / scale - shift`` for i = 0 … n-1, for a total of at least 0.

    The values depend on ``total % modulus`` only: a constant table has a row for each remainder, so a token
    looks its row up, with no arithmetic and no copy per entry.
    """
    values = (np.arange(modulus)[:, None] + np.arange(n)[None, :] * step) % modulus / scale - shift
    return F.get(F.array(*[F.lit(row) for row in values]), (total % modulus).cast("int"))


def words_to_logits(key: Column, words: Column, entries: int = TOP_ENTRIES) -> Column:
    """One token per word with ``entries`` logits each; every 97th is null and every 89th empty."""
    key = key.cast("bigint")
    ranks = F.lit(np.arange(entries, dtype=np.int32))

    def token(w: Column, p: Column) -> Column:
        p = p.cast("bigint")
        at, width = key * 31 + p, F.length(w).cast("bigint")
        total = key * 131 + p * 7919 + width * 15485863
        row = F.arrays_zip(
            F.sequence(p * 100, p * 100 + (entries - 1)).alias("token_id"),
            F.array_repeat(w, entries).alias("token"),
            cycled(total, 104729, 161, 4.0, 15.0, entries).alias("logit"),
            ranks.alias("rank"),
        )
        # a null or negative key, as a formula
        odd = F.transform(
            ranks,
            lambda k: F.struct(
                (p * 100 + k).cast("bigint").alias("token_id"),
                w.alias("token"),
                _logit(key, p, k.cast("bigint"), width).alias("logit"),
                k.cast("int").alias("rank"),
            ),
        )
        return F.when(at % 97 == 0, None).when(at % 89 == 0, F.slice(odd, 1, 0)).when(total >= 0, row).otherwise(odd)

    return F.transform(words, token)


def some(scores: str) -> Column:
    """Scores to explode; null as an empty array. Of a bare column Spark would infer a filter (not null, not
    empty), push it below the shuffle and compute the scores a second time there."""
    return F.coalesce(F.col(scores), F.array().cast("array<double>"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a unique number."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("tid"), "conv_id", "turn", "role", "text")


def turn_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, logits) per conversation turn."""
    return dealt(turns(spark, sf_dir), 4).select("tid", words_to_logits(F.col("tid"), F.split("text", " ")).alias("logits"))


def doc_logits(spark: SparkSession, sf_dir: str, entries: int = TOP_ENTRIES) -> DataFrame:
    """(row_id, logits) per document."""
    return logits_of(table(spark, sf_dir, "documents").select("doc_id", "text"), entries)


def logits_of(docs: DataFrame, entries: int = TOP_ENTRIES) -> DataFrame:
    """(row_id, logits) per row of (doc_id, text)."""
    return dealt(docs, 4).select(
        F.col("doc_id").alias("row_id"), words_to_logits(F.col("doc_id"), F.split("text", " "), entries).alias("logits")
    )


def words_sql(source: str, key: str) -> str:
    return f"""
words AS (SELECT {key}, unnest(string_split(text, ' ')) AS w,
                 generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM {source}),
ent AS (SELECT {key}, p, k,
               CAST(({key} * 131 + p * 7919 + k * 104729 + length(w) * 15485863) % 161 AS DOUBLE) / CAST(4 AS DOUBLE)
                 - CAST(15 AS DOUBLE) AS logit
        FROM words, range({TOP_ENTRIES}) r(k)
        WHERE ({key} * 31 + p) % 97 <> 0 AND ({key} * 31 + p) % 89 <> 0),
norms AS (SELECT {key}, p, sqrt(sum(CASE WHEN logit > 0 THEN logit * logit ELSE CAST(0 AS DOUBLE) END)) AS s
          FROM ent GROUP BY ALL)"""


TURNS_SQL = "turns AS (SELECT conv_id * 1000 + turn AS tid, conv_id, turn, role, text FROM conversations)"
TURN_NORMS_SQL = f"{TURNS_SQL}, {words_sql('turns', 'tid')}"
DOC_NORMS_SQL = words_sql("documents", "doc_id")

# per token t (numbered over scorable tokens): it updates iff fewer than M earlier scores reach it
PATIENCE_SQL = """
tok AS (SELECT tid, s, row_number() OVER (PARTITION BY tid ORDER BY p) AS t FROM norms),
upd AS (SELECT a.tid, a.t, any_value(a.s) AS s, count(b.t) < 5 AS updates
        FROM tok a LEFT JOIN tok b ON b.tid = a.tid AND b.t < a.t AND b.s >= a.s GROUP BY a.tid, a.t),
idle AS (SELECT *, t - max(CASE WHEN updates THEN t END) OVER (PARTITION BY tid ORDER BY t) AS waited FROM upd),
halt AS (SELECT tid, coalesce(min(CASE WHEN waited >= 20 THEN t END), max(t)) AS tau,
                count(*) FILTER (waited >= 20) > 0 AS triggered, max(t) AS n_tokens FROM idle GROUP BY tid),
best AS (SELECT i.tid, i.s, row_number() OVER (PARTITION BY i.tid ORDER BY i.s DESC, i.t) AS r
         FROM idle i JOIN halt h ON h.tid = i.tid AND i.t <= h.tau),
heap AS (SELECT tid, avg(s) AS mean FROM best WHERE r <= 5 GROUP BY tid)"""


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn and the assistant turn that follows: (tid, label, pred)."""
    t = turns(spark, sf_dir)
    asked = t.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("label"))
    said = t.filter("role = 'assistant'").select("conv_id", "turn", "tid", F.col("text").alias("pred"))
    return said.join(asked, ["conv_id", "turn"]).select("tid", "label", "pred")


PAIRS_SQL = f"""{TURNS_SQL},
pairs AS (SELECT a.tid, u.text AS label, a.text AS pred FROM turns a
          JOIN turns u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
          WHERE a.role = 'assistant' AND u.role = 'user')"""


def rouge_sql(source: str, keep: str) -> str:
    """SQL giving ``rouge_l`` for (label, pred): longest increasing run of match positions."""
    return f"""
wl AS (SELECT {keep}, label, pred, regexp_extract_all(lower(label), '[a-z0-9]+') AS a,
              regexp_extract_all(lower(pred), '[a-z0-9]+') AS b FROM {source}),
hits AS (SELECT *, flatten(list_transform(a, lambda x:
           list_reverse(list_filter(range(1, len(b) + 1), lambda j: b[j] = x)))) AS h FROM wl),
lcs AS (SELECT *, len(list_reduce(list_transform(h, lambda p: [p]), lambda acc, q:
           list_concat(acc[1:len(list_filter(acc, lambda z: z < q[1]))], q,
                       acc[len(list_filter(acc, lambda z: z < q[1])) + 2:]), CAST([] AS BIGINT[]))) AS l FROM hits),
pr AS (SELECT *, CAST(l AS DOUBLE) / greatest(len(b), 1) AS pre, CAST(l AS DOUBLE) / greatest(len(a), 1) AS rec FROM lcs),
rouge AS (SELECT *, CASE WHEN l > 0 THEN 2 * pre * rec / (pre + rec) ELSE CAST(0 AS DOUBLE) END AS rouge_l FROM pr)"""


DATASETS = ("coqa", "NewsQA", "mmlu", "nq", "arc", "TriviaQA")


def dataset_of(key: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DATASETS]), (key % 6).cast("int"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, unc, ok, grp) from events: many ties; nulls, NaN and infinities; one one-class group."""
    e = table(spark, sf_dir, "events")
    grp = F.col("user_id") % 6
    i = F.col("event_id")
    unc = (
        F.when(i % 101 == 0, None)
        .when((i % 103 == 0) & (grp == 0), float("nan"))
        .when((i % 107 == 0) & (grp == 1), float("inf"))
        .otherwise(F.floor("value").cast("double"))
    )
    return e.select(
        i.alias("row_id"), unc.alias("unc"), ((grp == 5) | (F.col("event_type") != "error")).alias("ok"), grp.alias("grp")
    )


SCORES_SQL = """
scores AS (SELECT event_id AS row_id,
                  CASE WHEN event_id % 101 = 0 THEN NULL
                       WHEN event_id % 103 = 0 AND user_id % 6 = 0 THEN CAST('NaN' AS DOUBLE)
                       WHEN event_id % 107 = 0 AND user_id % 6 = 1 THEN CAST('Infinity' AS DOUBLE)
                       ELSE CAST(floor(value) AS DOUBLE) END AS unc,
                  (user_id % 6 = 5 OR event_type <> 'error') AS ok, user_id % 6 AS grp FROM events)"""


def metrics_sql(source: str, keys: list[str]) -> str:
    """CTEs giving per group the metric columns; ``source`` has keys, unc, ok."""
    k = ", ".join(keys)
    lead = f"{k}, " if keys else ""
    part = f"PARTITION BY {k}" if keys else ""
    by = f"GROUP BY {k}" if keys else ""
    on = " AND ".join(f"g.{x} IS NOT DISTINCT FROM f.{x}" for x in keys) or "true"
    lead_f = "".join(f"f.{x}, " for x in keys)
    return f"""
fin AS (SELECT * FROM {source} WHERE unc IS NOT NULL AND isfinite(unc)),
cells AS (SELECT {lead}unc, count(*) FILTER (NOT ok) AS pos, count(*) FILTER (ok) AS neg FROM fin GROUP BY {lead}unc),
rk AS (SELECT *, CAST(sum(pos) OVER ({part} ORDER BY unc) AS BIGINT) AS cp, CAST(sum(neg) OVER ({part} ORDER BY unc) AS BIGINT) AS cn,
              CAST(sum(pos) OVER ({part}) AS BIGINT) AS p, CAST(sum(neg) OVER ({part}) AS BIGINT) AS n FROM cells),
cut AS (SELECT rk.*, (SELECT count(*) FROM range(20) r(i) WHERE ((p + n - 1) * (19 + 9 * i)) // 190 < cp + cn
                       AND ((p + n - 1) * (19 + 9 * i)) // 190 >= cp + cn - pos - neg) AS cuts FROM rk),
agg AS (SELECT {lead}any_value(p) AS p, any_value(n) AS n,
               CAST(sum(neg * (2 * (p - cp) + pos)) AS DOUBLE) AS wins,
               max((p - cp + pos) * n - (n - cn + neg) * p) AS j,
               sum(CAST(cn AS DOUBLE) / (cp + cn) * cuts) AS covered FROM cut {by}),
thr AS (SELECT {"".join(f"c.{x}, " for x in keys)}max(c.unc) AS at FROM cut c JOIN agg a
        ON {" AND ".join(f"a.{x} IS NOT DISTINCT FROM c.{x}" for x in keys) or "true"}
        WHERE (c.p - c.cp + c.pos) * c.n - (c.n - c.cn + c.neg) * c.p = a.j {("GROUP BY " + ", ".join("c." + x for x in keys)) if keys else ""}),
basic AS (SELECT {lead}count(unc) AS n_any, avg(unc) AS mean_,
                 CASE WHEN count(*) FILTER (unc IS NOT NULL AND NOT isfinite(unc)) > 0 THEN CAST('NaN' AS DOUBLE)
                      ELSE stddev_samp(CASE WHEN isfinite(unc) THEN unc END) END AS std_ FROM {source} {by}),
metrics AS (SELECT {lead_f}
     CASE WHEN n_any = 0 OR isnan(mean_) THEN -1 WHEN isinf(mean_) THEN 1e9 ELSE round(mean_, 9) END AS mean,
     CASE WHEN n_any < 2 OR isnan(std_) THEN -1 ELSE round(std_, 9) END AS std,
     CASE WHEN g.p > 0 AND g.n > 0 THEN round(wins / (2 * CAST(g.p AS DOUBLE) * g.n), 9) ELSE CAST(0.5 AS DOUBLE) END AS auroc,
     CASE WHEN g.p + g.n > 0 THEN round(covered * (CAST(0.9 AS DOUBLE) / 19), 9) ELSE -1 END AS aurac,
     CASE WHEN g.p > 0 AND g.n > 0 THEN round((1 + greatest(j, 0) / (CAST(g.p AS DOUBLE) * g.n)) / 2, 9) ELSE -1 END AS balanced_acc,
     CASE WHEN coalesce(g.p, 0) = 0 OR coalesce(g.n, 0) = 0 THEN CAST(0.5 AS DOUBLE) WHEN j > 0 THEN t.at ELSE 1e9 END AS threshold
     FROM basic f LEFT JOIN agg g ON {on} LEFT JOIN thr t ON {on.replace("g.", "t.")})"""


def split_of(row_id: Column, n: Column) -> Column:
    """train / val / test by the positional rule; the last tenth serves as test."""
    return (
        F.when(row_id < n - 2 * F.floor(n / 10), "train").when(row_id < n - F.floor(n / 10), "val").otherwise("test")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, embedding, y FLOAT, ok, split) from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n")).scalar()
    return e.withColumn("n", n).select(
        F.col("vec_id").alias("row_id"),
        "embedding",
        (F.col("label") / 9.0).cast("float").alias("y"),
        (F.col("label") <= 4).alias("ok"),
        split_of(F.col("vec_id"), F.col("n")).alias("split"),
    )


VECTORS_SQL = """
sized AS (SELECT *, (SELECT count(*) FROM embeddings) AS nn FROM embeddings),
vectors AS (SELECT vec_id AS row_id, embedding, CAST(label / CAST(9 AS DOUBLE) AS FLOAT) AS y, label <= 4 AS ok,
                   CASE WHEN vec_id < nn - 2 * (nn // 10) THEN 'train' WHEN vec_id < nn - nn // 10 THEN 'val'
                        ELSE 'test' END AS split FROM sized)"""


def vector_width(df: DataFrame) -> int:
    return df.select(F.size("embedding").alias("d")).first()["d"]


def fixed_weights(dim: int) -> np.ndarray:
    """Weights given by a formula that SQL can repeat."""
    h, d = np.arange(hidden_size(dim)), np.arange(dim)
    w1 = ((h[:, None] * 31 + d[None, :] * 17) % 23 - 11) / 64.0
    return np.concatenate([w1.ravel(), (h % 5 - 2) / 8.0, ((h * 7) % 11 - 5) / 8.0, [0.125]])


FORWARD_SQL = """
x AS (SELECT row_id, unnest(embedding) AS v0, generate_subscripts(embedding, 1) - 1 AS d FROM vectors),
xs AS (SELECT row_id, d, CAST(v0 AS DOUBLE) AS v FROM x),
hid AS (SELECT row_id, h, sum(v * (CAST((h * 31 + d * 17) % 23 - 11 AS DOUBLE) / 64)) + CAST(h % 5 - 2 AS DOUBLE) / 8 AS z
        FROM xs, range((SELECT max(len(embedding)) // 4 FROM embeddings)) r(h) GROUP BY row_id, h),
net AS (SELECT row_id, sum(z / (1 + exp(-z)) * (CAST((h * 7) % 11 - 5 AS DOUBLE) / 8)) + CAST(0.125 AS DOUBLE) AS unc
        FROM hid GROUP BY row_id)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answering corpus, one row per conversation turn: story, lines as questions, comma
    parts as answers; some stories and questions are null."""
    t = turns(spark, sf_dir)
    questions = F.transform(F.split("text", "\n"), lambda q: F.when(F.length(q) % 7 != 0, q))
    return t.select(
        F.col("tid").alias("row_id"),
        F.when(F.col("tid") % 53 != 0, F.col("text")).alias("story"),
        questions.alias("questions"),
        F.struct(F.split("text", ", ").alias("input_text")).alias("answers"),
    )


CORPUS_SQL = f"""{TURNS_SQL},
corpus AS (SELECT tid AS row_id, CASE WHEN tid % 53 <> 0 THEN text END AS story,
                  string_split(text, chr(10)) AS qs, string_split(text, ', ') AS ans FROM turns),
qa0 AS (SELECT row_id, coalesce(story, '') AS story, qs, ans,
              unnest(range(0, least(len(qs), len(ans)))) AS qa_idx FROM corpus),
qa AS (SELECT row_id, story, qa_idx,
              CASE WHEN length(qs[qa_idx + 1]) % 7 <> 0 THEN qs[qa_idx + 1] ELSE '' END AS question,
              ans[qa_idx + 1] AS label FROM qa0)"""
