"""Registered queries: model runs, embeddings, training, scoring, end-to-end jobs."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from doubtscope.operators import labels as lab
from doubtscope.operators import network as net
from doubtscope.operators import training as tr
from doubtscope.operators.metrics import detection_summary
from doubtscope.operators.pooling import pool_tokens
from doubtscope.operators.scoring import answer_fields, batch_score, embed_prompts, hash_embed, score_prompts
from doubtscope.plans import evaluate as ev
from doubtscope.plans import fixtures as fx
from doubtscope.plans.catalog_text import _MIXED_SQL, mixed_pairs
from doubtscope.plans.registry import query, shown, table
from doubtscope.session import fresh_path, stored

_NET = f"WITH {fx.VECTORS_SQL}, {fx.FORWARD_SQL}"
FIVE = ["mean", "std", "auroc", "aurac", "balanced_acc"]


@query(
    "minmax_normalise",
    f"""WITH {fx.VECTORS_SQL}, raw AS (SELECT row_id, split, CAST(row_id % 37 AS FLOAT) + y AS label FROM vectors),
        s AS (SELECT CAST(min(label) AS DOUBLE) AS lo, CAST(max(label) AS DOUBLE) AS hi FROM raw WHERE split = 'train')
        SELECT row_id, round(CAST(greatest(least((CAST(label AS DOUBLE) - lo) / greatest(hi - lo, 1e-8), 1), 0) AS DOUBLE), 5) AS y FROM raw, s""",
)
def minmax_normalise(spark, sf):
    raw = fx.vectors(spark, sf).select(
        "row_id", "split", ((F.col("row_id") % 37).cast("float") + F.col("y")).cast("float").alias("label")
    )
    span = lab.label_range(raw.filter("split = 'train'"))
    out = lab.minmax_normalise(raw, span)
    return out.select("row_id", F.round(F.col("y").cast("double"), 5).alias("y"))


@query(
    "label_range",
    f"""WITH {fx.VECTORS_SQL} SELECT round(CAST(min(y) AS DOUBLE), 6) AS lo, round(CAST(max(y) AS DOUBLE), 6) AS hi FROM vectors WHERE split = 'train'""",
)
def label_range(spark, sf):
    r = lab.label_range(fx.vectors(spark, sf).filter("split = 'train'"), "y")
    return r.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("lo", "hi")])


@query("drop_unlabelled", "SELECT d.doc_id AS row_id, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def drop_unlabelled(spark, sf):
    d, q = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    joined = d.join(q, "doc_id", "left").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    return lab.drop_unlabelled(joined)


@query(
    "label_functions",
    f"""WITH {fx.DOC_NORMS_SQL}, r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM norms)
        SELECT doc_id AS row_id, round(CAST(CAST(avg(s) AS FLOAT) AS DOUBLE), 4) AS label FROM r WHERE r <= 3 GROUP BY doc_id""",
)
def label_functions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    out = lab.compute_labels(d, fx.doc_logits(spark, sf), "topm_norm", topk_worst=3)
    return out.select("row_id", F.round(F.col("label").cast("double"), 4).alias("label"))


@query(
    "build_train_set",
    f"""WITH {fx.VECTORS_SQL}, {fx.DOC_NORMS_SQL},
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM norms),
        raw AS (SELECT v.row_id, v.split, v.embedding, CAST(avg(r.s) AS FLOAT) AS label FROM vectors v JOIN r ON r.doc_id = v.row_id WHERE r.r <= 5 GROUP BY ALL),
        s AS (SELECT CAST(min(label) AS DOUBLE) AS lo, CAST(max(label) AS DOUBLE) AS hi FROM raw WHERE split = 'train')
        SELECT row_id, split, round(greatest(least((CAST(label AS DOUBLE) - lo) / greatest(hi - lo, 1e-8), 1), 0), 4) AS y,
               round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM raw, s""",
)
def build_train_set(spark, sf):
    v = fx.vectors(spark, sf)
    labels = lab.compute_labels(v, fx.doc_logits(spark, sf), "topm_norm").join(v.select("row_id", "split"), "row_id")
    out = lab.build_train_set(stored(labels, "labels"), v)
    return out.select(
        "row_id", "split", F.round(F.col("y").cast("double"), 4).alias("y"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first")
    )


def _token_vectors(spark, sf):
    """Documents as the tokens of 40 sequences, one hot: a third of all rows has the same key."""
    d = table(spark, sf, "documents")
    vec = F.array((F.col("n_chars") % 1000).cast("float"), (F.col("doc_id") % 11).cast("float"), F.lit(1.0).cast("float"))
    key = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 40)
    return d.select(key.alias("seq"), F.col("doc_id").alias("pos"), vec.alias("vec"), (F.col("doc_id") % 7 != 0).alias("valid"))


_TOKENS_SQL = """v AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 40 END AS seq, doc_id AS pos, doc_id % 7 <> 0 AS valid,
    CAST(n_chars % 1000 AS DOUBLE) AS a, CAST(doc_id % 11 AS DOUBLE) AS b FROM documents)"""


@query(
    "mean_pool",
    f"WITH {_TOKENS_SQL} SELECT seq, round(avg(a) FILTER (valid), 6) AS a, round(avg(b) FILTER (valid), 6) AS b, CAST(1 AS DOUBLE) AS c FROM v GROUP BY seq",
)
def mean_pool(spark, sf):
    p = pool_tokens(_token_vectors(spark, sf), "mean")
    return p.select("seq", *[F.round(F.col("embedding")[i], 6).alias(n) for i, n in enumerate("abc")])


@query(
    "last_pool",
    f"WITH {_TOKENS_SQL} SELECT seq, max_by(a, pos) FILTER (valid) AS a, max_by(b, pos) FILTER (valid) AS b FROM v GROUP BY seq",
)
def last_pool(spark, sf):
    p = pool_tokens(_token_vectors(spark, sf), "last")
    return p.select("seq", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("ab")])


@query(
    "both_pools",
    f"WITH {_TOKENS_SQL} SELECT seq, round(avg(a) FILTER (valid), 6) AS mean_a, round(avg(b) FILTER (valid), 6) AS mean_b, max_by(a, pos) FILTER (valid) AS last_a, max_by(b, pos) FILTER (valid) AS last_b FROM v GROUP BY seq",
)
def both_pools(spark, sf):
    p = pool_tokens(_token_vectors(spark, sf), "both")
    return p.select("seq", *[F.round(F.col("mean")[i], 6).alias(f"mean_{n}") for i, n in enumerate("ab")], *[F.col("last")[i].cast("double").alias(f"last_{n}") for i, n in enumerate("ab")])


def _fixed(spark, sf):
    v = fx.vectors(spark, sf)
    return v, fx.fixed_weights(fx.vector_width(v))


@query("mlp_score", f"{_NET} SELECT row_id, round(unc, 6) AS unc FROM net")
def mlp_score(spark, sf):
    v, w = _fixed(spark, sf)
    return net.mlp_score(v, {0: w}).select("row_id", F.round("unc", 6).alias("unc"))


@query(
    "grad_partial",
    f"""{_NET}, o AS (SELECT n.row_id, 2 * (n.unc - CAST(v.y AS DOUBLE)) AS g FROM net n JOIN vectors v ON v.row_id = n.row_id),
        act AS (SELECT h.row_id, h, z, o.g, 1 / (1 + exp(-z)) AS s, CAST((h * 7) % 11 - 5 AS DOUBLE) / 8 AS w2 FROM hid h JOIN o ON o.row_id = h.row_id),
        back AS (SELECT *, g * w2 * (s * (1 + z * (1 - s))) AS b FROM act), hh AS (SELECT max(len(embedding)) AS dd, max(len(embedding)) // 4 AS nh FROM embeddings),
        out AS (SELECT h * dd + d AS i, sum(b * v) AS value FROM back JOIN xs ON xs.row_id = back.row_id, hh GROUP BY h, d, dd
          UNION ALL SELECT dd * nh + h, sum(b) FROM back, hh GROUP BY h, dd, nh
          UNION ALL SELECT dd * nh + nh + h, sum(g * z * s) FROM back, hh GROUP BY h, dd, nh
          UNION ALL SELECT dd * nh + 2 * nh, sum(g) FROM o, hh GROUP BY dd, nh)
        SELECT CAST(i AS BIGINT) AS i, round(value, 5) AS value FROM out""",
)
def grad_partial(spark, sf):
    v, w = _fixed(spark, sf)
    g = net.grad_partial(v, w).select(F.posexplode("grad").alias("i", "value"))
    return g.select(F.col("i").cast("bigint").alias("i"), F.round("value", 5).alias("value"))


@query(
    "ranknet_pairs",
    f"""{_NET}, b AS (SELECT n.row_id // 64 AS batch_id, n.unc AS p, CAST(v.y AS DOUBLE) AS t FROM net n JOIN vectors v ON v.row_id = n.row_id),
        pairs AS (SELECT x.batch_id, -sign(x.t - y.t) * (x.p - y.p) AS m FROM b x JOIN b y ON y.batch_id = x.batch_id AND abs(x.t - y.t) > 1e-6)
        SELECT batch_id, round(avg(greatest(m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss, count(*) AS n_pairs FROM pairs GROUP BY batch_id""",
)
def ranknet_pairs(spark, sf):
    v, w = _fixed(spark, sf)
    scored = net.mlp_score(v.withColumn("t", F.col("y").cast("double")), {0: w}, keep=["row_id", "t"], out="pred")
    loss = net.ranknet_loss(scored, 64, target="t")
    return loss.select("batch_id", F.round("loss", 6).alias("loss"), "n_pairs")


# --- stub model: answers and logits read off the MD5 of the prompt ------------------------------


def stub_model(texts: list[str]) -> list[list[tuple]]:
    """Two answers per prompt; tokens, candidates and logits follow from the digest's hex digits."""
    out = []
    for text in texts:
        digest = hashlib.md5(text.encode()).hexdigest()
        answers = []
        for r in range(2):
            digits = [int(c, 16) for c in digest[8 * r : 8 * r + 8]]
            tokens = [
                [(t * 10 + j, {"logprob": (digits[(t + j) % 8] - 6) / 2.0, "decoded_token": f"t{t}c{j}", "rank": None if r else j})
                 for j in range(3)]
                for t in range(1 + digits[0] % 4)
            ]
            answers.append((f"  {digest[8 * r : 8 * r + 8]} \n", [dict(c) for c in tokens]))
        out.append(answers)
    return out


_STUB_SQL = """
dig AS (SELECT row_id, md5(text) AS h FROM src),
resp AS (SELECT row_id, r, substr(h, 8 * r + 1, 8) AS d FROM dig, range(2) q(r)),
toks AS (SELECT row_id, r, d, unnest(range(0, 1 + CAST('0x' || substr(d, 1, 1) AS INTEGER) % 4)) AS t FROM resp),
cand AS (SELECT row_id, r, t, j, CAST(CAST('0x' || substr(d, CAST((t + j) % 8 + 1 AS INTEGER), 1) AS INTEGER) - 6 AS DOUBLE) / 2 AS logit FROM toks, range(3) q(j)),
ord AS (SELECT *, row_number() OVER (PARTITION BY row_id, r, t ORDER BY CASE WHEN r = 0 THEN CAST(j AS DOUBLE) ELSE -logit END, j) AS place FROM cand)"""
_TURN_SRC = f"{fx.TURNS_SQL}, src AS (SELECT tid AS row_id, text FROM turns)"


def _turn_prompts(spark, sf):
    t = fx.turns(spark, sf)
    message = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    return t.select(F.col("tid").alias("row_id"), F.array(message).alias("prompt"), F.col("role").alias("label"))


@query(
    "batch_score",
    f"""WITH {_TURN_SRC}, {_STUB_SQL}, n AS (SELECT row_id, r, max(t) AS last FROM toks GROUP BY ALL)
        SELECT o.row_id, CAST(o.r AS INTEGER) AS response_idx, substr(d.h, CAST(8 * o.r + 1 AS INTEGER), 8) AS answer, CAST(n.last AS INTEGER) AS answer_token_index,
               CAST(o.t AS BIGINT) AS pos, o.place, o.t * 10 + o.j AS token_id, o.logit
        FROM ord o JOIN dig d ON d.row_id = o.row_id JOIN n ON n.row_id = o.row_id AND n.r = o.r WHERE o.place <= 2 OR (o.r = 0 AND o.j = 0)""",
)
def model_answers(spark, sf):
    f = answer_fields(batch_score(_turn_prompts(spark, sf), stub_model), 2)
    tokens = f.select("row_id", "response_idx", "answer", "answer_token_index", F.posexplode("gen_topk_logits").alias("pos", "t"))
    e = tokens.select("row_id", "response_idx", "answer", "answer_token_index", "pos", F.posexplode("t").alias("i", "e"))
    return e.select(
        "row_id", "response_idx", "answer", "answer_token_index", F.col("pos").cast("bigint").alias("pos"),
        (F.col("i") + 1).cast("bigint").alias("place"), "e.token_id", "e.logit",
    )


def weighed_logits(i: int):
    """All logits of a response as one number: each times its token id, which tells token and place."""
    entries = F.flatten(F.col(f"gen_topk_logits_{i}"))
    total = F.aggregate(entries, F.lit(0.0), lambda t, e: t + e["logit"] * e["token_id"])
    return F.round(total, 6).alias(f"logits_{i}")


# prompts of the train split of the corpus, numbered over all pairs, with what the stub model answers
_CORPUS_PROMPTS_SQL = f"""{fx.CORPUS_SQL},
place AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM corpus),
asked AS (SELECT row_number() OVER (ORDER BY qa.row_id, qa_idx) - 1 AS row_id, label,
  'You are a reading comprehension assistant. Answer the question about a given story with brief, direct answers. Please only use the information from the story to give your answer.' || chr(10)
  || ' Story:' || chr(10) || story || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || chr(10) AS text
  FROM qa JOIN place ON place.row_id = qa.row_id WHERE i < n - 2 * (n // 10)),
src AS (SELECT row_id, text FROM asked), {_STUB_SQL}"""


def _inferred(spark, sf):
    """Root of the stored inference output over the train split, in 12 or 13 shards of several files each."""
    from doubtscope.operators.prefix import dense_index
    from doubtscope.sources.corpus import corpus_split

    c = fx.corpus(spark, sf).withColumnRenamed("row_id", "key")
    rows = stored(dense_index(c, "key", "row_id").drop("key"), "corpus")
    n = corpus_split(rows, "train").count()
    root = fresh_path(spark, "infer")
    ev.infer_corpus(rows, root, stub_model, "train", "raw", 2, n // 12 + 1)
    return root


@query(
    "infer_dataset",
    f"""WITH {_CORPUS_PROMPTS_SQL}, per AS (SELECT count(*) // 12 + 1 AS per FROM asked),
        places AS (SELECT row_id, r, sum(logit * (j + 10 * t)) AS total FROM ord GROUP BY ALL)
        SELECT a.row_id, CAST(a.row_id // per AS INTEGER) AS shard_idx, asked.label, substr(d.h, 1, 8) AS answer_0, substr(d.h, 9, 8) AS answer_1,
          round(a.total, 6) AS logits_0, round(b.total, 6) AS logits_1
        FROM places a JOIN places b ON b.row_id = a.row_id AND a.r = 0 AND b.r = 1 JOIN dig d ON d.row_id = a.row_id JOIN asked ON asked.row_id = a.row_id, per""",
)
def infer_dataset(spark, sf):
    from doubtscope.sources.sharded import read_sharded

    root = _inferred(spark, sf)
    results = read_sharded(spark, f"{root}/results")
    logits = read_sharded(spark, f"{root}/logits").drop("shard_idx")
    return results.join(logits, "row_id").select("row_id", "shard_idx", "label", "answer_0", "answer_1", *[weighed_logits(i) for i in range(2)])


# the stub's answers are at most four tokens long, so the early halt (20 tokens) never comes
@query(
    "infer_then_evaluate",
    f"""WITH {_CORPUS_PROMPTS_SQL}, norms AS (SELECT row_id, t, sqrt(sum(CASE WHEN logit > 0 THEN logit * logit ELSE CAST(0 AS DOUBLE) END)) AS s FROM ord WHERE r = 1 GROUP BY ALL),
        unc AS (SELECT row_id, avg(s) AS unc FROM norms GROUP BY row_id),
        sc AS (SELECT u.unc, substr(d.h, 9, 1) < '8' AS ok FROM unc u JOIN dig d ON d.row_id = u.row_id), {fx.metrics_sql('sc', [])} SELECT {', '.join(FIVE)} FROM metrics""",
)
def infer_then_evaluate(spark, sf):
    root = _inferred(spark, sf)
    m = ev.evaluate_files(
        spark, f"{root}/results", f"{root}/logits", "own rule", 1, correct_fn=lambda label, pred: F.substring(pred, 1, 1) < "8"
    )
    return m.select(*[shown(c).alias(c) for c in FIVE])


# --- embeddings ---------------------------------------------------------------------------------


def digest_vectors(df, text):
    """Embedder that SQL can repeat: eight numbers from the MD5 of the text. Stays in the JVM."""
    nibble = F.transform(
        F.sequence(F.lit(1), F.lit(8)), lambda i: (F.conv(F.substring(F.md5(F.col(text)), i, F.lit(1)), 16, 10).cast("double") / 16.0)
    )
    return df.withColumn("embedding", nibble.cast("array<float>"))


@query(
    "embed_prompts",
    f"""WITH {_TURN_SRC} SELECT row_id, CAST(i AS INTEGER) AS i, CAST(CAST('0x' || substr(md5(text), CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS DOUBLE) / 16 AS v FROM src, range(8) r(i)""",
)
def embed(spark, sf):
    e = embed_prompts(_turn_prompts(spark, sf), digest_vectors)
    return e.select("row_id", F.posexplode("embedding").alias("i", "v")).select("row_id", "i", F.col("v").cast("double").alias("v"))


@query(
    "hash_embed",
    """WITH w AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents),
    c AS (SELECT row_id, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % 64 AS i, count(*) AS n FROM w GROUP BY ALL)
    SELECT row_id, CAST(i AS INTEGER) AS i, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY row_id)) AS FLOAT) AS DOUBLE), 5) AS v FROM c""",
)
def hashed(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    e = hash_embed(d, "text", 64).select("row_id", F.posexplode("embedding").alias("i", "v")).filter("v > 0")
    return e.select("row_id", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


_SCORED_SQL = f"""{_TURN_SRC},
x AS (SELECT row_id, i, CAST(CAST('0x' || substr(md5(text), CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS DOUBLE) / 16 AS v FROM src, range(8) r(i)),
hid AS (SELECT row_id, h, sum(v * (CAST((h * 31 + i * 17) % 23 - 11 AS DOUBLE) / 64)) + CAST(h % 5 - 2 AS DOUBLE) / 8 AS z FROM x, range(2) r(h) GROUP BY row_id, h),
net AS (SELECT row_id, sum(z / (1 + exp(-z)) * (CAST((h * 7) % 11 - 5 AS DOUBLE) / 8)) + CAST(0.125 AS DOUBLE) AS unc FROM hid GROUP BY row_id)"""


@query("score_prompts", f"WITH {_SCORED_SQL} SELECT row_id, round(unc, 6) AS unc FROM net")
def prompt_scores(spark, sf):
    s = score_prompts(_turn_prompts(spark, sf), fx.fixed_weights(8), digest_vectors)
    return s.select("row_id", F.round("unc", 6).alias("unc"))


@query(
    "encode_dataset",
    f"""WITH {_TURN_SRC} SELECT row_id, role AS label, text AS prompt, i AS d, CAST(CAST('0x' || substr(md5(text), CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS DOUBLE) / 16 AS v
        FROM (SELECT row_number() OVER (ORDER BY tid) - 1 AS row_id, role, text FROM turns), range(8) r(i)""",
)
def encode_dataset(spark, sf):
    """Result tables as files: of two candidates for the train split the whole one does not load, the sharded one does; val has none."""
    from doubtscope.operators.prefix import dense_index
    from doubtscope.sources.artifacts import read_embeddings

    p = dense_index(_turn_prompts(spark, sf).withColumnRenamed("row_id", "tid"), "tid", "row_id")
    root = fresh_path(spark, "encode")
    p.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").drop("row_id").write.parquet(f"{root}/in/qa/qa_32k_b_raw_nres-1_set-train-0000-of-0001.parquet")
    p.limit(1).write.json(f"{root}/in/qa/qa_32k_a_raw_nres-1_set-train.parquet")  # another kind of file under a result's name
    p.limit(1).write.parquet(f"{root}/in/qa/qa_32k_a_raw_nres-1_logits_set-val.parquet")
    done = ev.encode_task(spark, f"{root}/in", "qa", f"{root}/emb", ["train", "val"], "32k", "raw", "1", embedder=digest_vectors)
    e = read_embeddings(spark, f"{root}/emb/{done[0]}")
    return e.select("row_id", "label", "prompt", F.posexplode("embedding").alias("d", "v")).select("row_id", "label", "prompt", F.col("d").cast("bigint").alias("d"), F.col("v").cast("double").alias("v"))


# --- evaluation ---------------------------------------------------------------------------------

_E1_SQL = f"""{_MIXED_SQL},
flag AS (SELECT tid, CASE WHEN lower(dataset) IN ('coqa', 'newsqa', 'emrqa', 'nq', 'triviaqa') THEN rouge_l >= 0.3 ELSE label = pred END AS ok FROM rouge),
{fx.words_sql('turns', 'tid')}, {fx.PATIENCE_SQL},
scored AS (SELECT f.tid, f.ok, round(h.mean, 9) AS unc FROM flag f LEFT JOIN heap h ON h.tid = f.tid)"""


def _results(spark, sf):
    return mixed_pairs(spark, sf).withColumnRenamed("tid", "row_id").withColumnRenamed("pred", "answer_0")


def _result_logits(spark, sf):
    return fx.turn_logits(spark, sf).withColumnRenamed("tid", "row_id")


@query("evaluate_sequence_score", f"{_E1_SQL}, {fx.metrics_sql('scored', [])} SELECT {', '.join(FIVE)} FROM metrics")
def evaluate_sequence_score(spark, sf):
    s = ev.sequence_scores(_results(spark, sf), _result_logits(spark, sf), F.col("dataset"))
    m = detection_summary(s.withColumn("unc", F.round("unc", 9)))
    return m.select(*[shown(c).alias(c) for c in FIVE])


@query("sequence_scores", f"{_E1_SQL} SELECT tid AS row_id, ok, unc FROM scored")
def sequence_scores(spark, sf):
    s = ev.sequence_scores(_results(spark, sf), _result_logits(spark, sf), F.col("dataset"))
    return s.select("row_id", "ok", shown("unc").alias("unc"))


def _both_metrics_sql(keys: list[str]) -> str:
    """CTEs ``mt`` and ``ps`` (metrics by true and pseudo flags) and ``ct`` (counts) over sc: keys, unc, ok, label."""
    k = ", ".join(keys)
    lead, by = (f"{k}, ", f"GROUP BY {k}") if keys else ("", "")
    return f"""pc AS (SELECT {lead}unc, trunc(label) = 0 AS ok FROM sc),
mt AS (WITH {fx.metrics_sql('sc', keys)} SELECT {lead}{', '.join(FIVE)} FROM metrics),
ps AS (WITH {fx.metrics_sql('pc', keys)} SELECT {lead}{', '.join(f"{c} AS pseudo_{c}" for c in FIVE)} FROM metrics),
ct AS (SELECT {lead}count(*) AS n_samples, count(*) FILTER (ok) AS n_correct, count(*) FILTER (NOT ok) AS n_incorrect FROM sc {by})"""


def _evaluated(m, keys: list[str], digits: int = 9):
    names = [*FIVE, *[f"pseudo_{c}" for c in FIVE]]
    return m.select(*keys, *[shown(c, digits).alias(c) for c in names], "n_samples", "n_correct", "n_incorrect")


@query(
    "evaluate_scorer",
    f"""{_NET}, sc AS (SELECT v.split, v.ok, CAST(v.y AS DOUBLE) AS label, round(n.unc, 6) AS unc FROM net n JOIN vectors v ON v.row_id = n.row_id),
        {_both_metrics_sql(['split'])} SELECT mt.*, ps.* EXCLUDE (split), ct.* EXCLUDE (split) FROM mt JOIN ps USING (split) JOIN ct USING (split)""",
)
def evaluate_scorer(spark, sf):
    v, w = _fixed(spark, sf)
    scored = net.mlp_score(v.withColumnRenamed("y", "label"), {0: w}, keep=["row_id", "split", "ok", "label"])
    return _evaluated(ev.evaluate_scored(scored.withColumn("unc", F.round("unc", 6)), ["split"]), ["split"])


@query(
    "evaluate_learned_score",
    f"""{_MIXED_SQL}, flag AS (SELECT tid, CASE WHEN lower(dataset) IN ('coqa', 'newsqa', 'emrqa', 'nq', 'triviaqa') THEN rouge_l >= 0.3 ELSE label = pred END AS ok FROM rouge),
    {fx.words_sql('turns', 'tid')}, has AS (SELECT DISTINCT tid FROM norms), src AS (SELECT tid AS row_id, text FROM turns),
    x AS (SELECT row_id, i, CAST(CAST('0x' || substr(md5(text), CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS DOUBLE) / 16 AS v FROM src, range(8) r(i)),
    hid AS (SELECT row_id, h, sum(v * (CAST((h * 31 + i * 17) % 23 - 11 AS DOUBLE) / 64)) + CAST(h % 5 - 2 AS DOUBLE) / 8 AS z FROM x, range(2) r(h) GROUP BY row_id, h),
    net AS (SELECT row_id, round(sum(z / (1 + exp(-z)) * (CAST((h * 7) % 11 - 5 AS DOUBLE) / 8)) + CAST(0.125 AS DOUBLE), 6) AS unc FROM hid GROUP BY row_id),
    top AS (SELECT tid, s, row_number() OVER (PARTITION BY tid ORDER BY s DESC) AS r FROM norms),
    lb AS (SELECT tid, CAST(CAST(avg(s) AS FLOAT) AS DOUBLE) AS label FROM top WHERE r <= 5 GROUP BY tid),
    sc AS (SELECT f.ok, n.unc, lb.label FROM flag f JOIN has ON has.tid = f.tid JOIN net n ON n.row_id = f.tid JOIN lb ON lb.tid = f.tid), {_both_metrics_sql([])}
    SELECT {", ".join(f"round({c}, 4) AS {c}" for c in [*FIVE, *[f"pseudo_{c}" for c in FIVE]])}, n_samples, n_correct, n_incorrect FROM mt, ps, ct""",
)
def evaluate_learned_score(spark, sf):
    emb = embed_prompts(_turn_prompts(spark, sf), digest_vectors).drop("label")
    m = ev.evaluate_learned_score(_results(spark, sf), _result_logits(spark, sf), emb, fx.fixed_weights(8), F.col("dataset"))
    return _evaluated(m, [], 4)


# --- training: a few full-batch steps in exact mode, which SQL can repeat: the arithmetic of a step, not
# what a user trains with (see the published settings below) ---------------------------------------

FULL_BATCH = 1 << 30
STEPS = 3
#: nine runs: the published learning rates, and weight decay for the settings that draw random numbers
PLAIN_GRID = {"lr": tr.GRID["lr"], "weight_decay": [1e-4, 1e-2, 0.5]}
_DIMS_SQL = "hh AS (SELECT max(len(embedding)) AS dd, max(len(embedding)) // 4 AS nh FROM embeddings)"
_XS_SQL = """x AS (SELECT row_id, unnest(embedding) AS v0, generate_subscripts(embedding, 1) - 1 AS d FROM vectors),
xs AS (SELECT row_id, d, CAST(v0 AS DOUBLE) AS v FROM x)"""


def _start(dim: int, seed: int) -> np.ndarray:
    """Weights by a formula, another size for each seed."""
    return fx.fixed_weights(dim) * (1 + seed / 8)


def _training_sql(p: str, runs: str) -> str:
    """CTEs that train ``runs`` (run, seed, lr, decay) by STEPS full-batch Adam steps over xs, vectors and
    hh, ending in ``{p}sc``: (run, row_id, split, ok, unc) of all rows."""

    def forward(w: str, rows: str, name: str) -> str:
        return f"""
{name}w1 AS MATERIALIZED (SELECT run, i // dd AS h, i % dd AS d, value FROM {w}, hh WHERE i < dd * nh),
{name}wb AS MATERIALIZED (SELECT b.run, b.i - dd * nh AS h, b.value AS b1, u.value AS w2 FROM hh, {w} b JOIN {w} u ON u.run = b.run
  WHERE b.i >= dd * nh AND b.i < dd * nh + nh AND u.i = b.i + nh),
{name}b2 AS MATERIALIZED (SELECT run, value AS b2 FROM {w}, hh WHERE i = dd * nh + 2 * nh),
{name}z AS MATERIALIZED (SELECT w.run, x.row_id, w.h, sum(x.v * w.value) AS z0 FROM {rows} x JOIN {name}w1 w ON w.d = x.d GROUP BY w.run, x.row_id, w.h),
{name}a AS MATERIALIZED (SELECT z.run, z.row_id, z.h, z0 + b1 AS z, w2 FROM {name}z z JOIN {name}wb b ON b.run = z.run AND b.h = z.h),
{name}y AS MATERIALIZED (SELECT a.run, a.row_id, sum(z / (1 + exp(-z)) * w2) + max(b2) AS unc FROM {name}a a JOIN {name}b2 c ON c.run = a.run
  GROUP BY a.run, a.row_id)"""

    parts = [
        f"""{p}tx AS MATERIALIZED (SELECT xs.* FROM xs JOIN vectors USING (row_id) WHERE split = 'train'),
{p}w0 AS MATERIALIZED (SELECT run, CAST(i AS BIGINT) AS i, (1 + seed / CAST(8 AS DOUBLE)) * CASE
  WHEN i < dd * nh THEN CAST(((i // dd) * 31 + (i % dd) * 17) % 23 - 11 AS DOUBLE) / 64
  WHEN i < dd * nh + nh THEN CAST((i - dd * nh) % 5 - 2 AS DOUBLE) / 8
  WHEN i < dd * nh + 2 * nh THEN CAST(((i - dd * nh - nh) * 7) % 11 - 5 AS DOUBLE) / 8
  ELSE CAST(0.125 AS DOUBLE) END AS value FROM {runs}, hh, range((SELECT dd * nh + 2 * nh + 1 FROM hh)) r(i)),
{p}m0 AS (SELECT run, i, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM {p}w0)"""
    ]
    for k in range(STEPS):
        n = f"{p}{k}"
        rate = tr._rate(k, STEPS)
        parts.append(forward(f"{p}w{k}", f"{p}tx", n))
        parts.append(f"""
{n}o AS MATERIALIZED (SELECT y.run, y.row_id, 2 * (y.unc - CAST(v.y AS DOUBLE)) / (SELECT count(*) FROM vectors WHERE split = 'train') AS g
  FROM {n}y y JOIN vectors v ON v.row_id = y.row_id),
{n}b AS MATERIALIZED (SELECT a.run, a.row_id, a.h, g * w2 * (s * (1 + z * (1 - s))) AS b, g * z * s AS e
  FROM (SELECT *, 1 / (1 + exp(-z)) AS s FROM {n}a) a JOIN {n}o o ON o.run = a.run AND o.row_id = a.row_id),
{n}g AS (SELECT b.run, b.h * dd + t.d AS i, sum(b.b * t.v) AS g FROM {n}b b JOIN {p}tx t ON t.row_id = b.row_id, hh GROUP BY b.run, b.h, t.d, dd
  UNION ALL SELECT run, dd * nh + h, sum(b) FROM {n}b, hh GROUP BY run, h, dd, nh
  UNION ALL SELECT run, dd * nh + nh + h, sum(e) FROM {n}b, hh GROUP BY run, h, dd, nh
  UNION ALL SELECT run, dd * nh + 2 * nh, sum(g) FROM {n}o, hh GROUP BY run, dd, nh),
{n}c AS (SELECT run, i, CASE WHEN norm > {net.CLIP_NORM} THEN g * {net.CLIP_NORM} / (norm + 1e-6) ELSE g END AS g
  FROM (SELECT *, sqrt(sum(g * g) OVER (PARTITION BY run)) AS norm FROM {n}g)),
{p}m{k + 1} AS MATERIALIZED (SELECT c.run, c.i, {net.BETA1} * m + {1 - net.BETA1} * g AS m, {net.BETA2} * v + {1 - net.BETA2} * g * g AS v
  FROM {n}c c JOIN {p}m{k} m ON m.run = c.run AND m.i = c.i),
{p}w{k + 1} AS MATERIALIZED (SELECT w.run, w.i, w.value * (1 - lr * {rate} * decay)
    - lr * {rate} * (m / {1 - net.BETA1 ** (k + 1)}) / (sqrt(v / {1 - net.BETA2 ** (k + 1)}) + {net.ADAM_EPS}) AS value
  FROM {p}w{k} w JOIN {p}m{k + 1} m ON m.run = w.run AND m.i = w.i JOIN {runs} r ON r.run = w.run)""")
    parts.append(forward(f"{p}w{STEPS}", "xs", f"{p}f"))
    parts.append(f"""
{p}sc AS MATERIALIZED (SELECT y.run, y.row_id, split, ok, unc FROM {p}fy y JOIN vectors v ON v.row_id = y.row_id),
{p}mt AS MATERIALIZED (WITH {fx.metrics_sql(f"{p}sc", ["run", "split"])} SELECT run, split, auroc, aurac, balanced_acc, threshold FROM metrics)""")
    return ",".join(parts)


def _runs_sql(runs: list[tr.Run], seeded: bool = True) -> str:
    rows = ", ".join(f"({r.run_id}, {r.seed if seeded else 0}, CAST({r.lr} AS DOUBLE), CAST({r.weight_decay} AS DOUBLE))" for r in runs)
    return f"(SELECT * FROM (VALUES {rows}) t(run, seed, lr, decay))"


def _plain_runs(kind: str) -> list[tr.Run]:
    if kind == "grid":
        return tr.grid_runs(PLAIN_GRID, dropout=0.0, batch_size=FULL_BATCH)
    return tr.seed_runs(tr.Run(0, lr=3e-3, dropout=0.0, batch_size=FULL_BATCH))


def _how(dim: int, runs: int | None = None, seeds=None) -> dict:
    starts = {i: _start(dim, 0) for i in range(runs)} if runs else {i: _start(dim, s) for i, s in enumerate(seeds)}
    return {"epochs": STEPS, "mode": "exact", "initial": starts}


def _three(spark, sf):
    v = stored(fx.vectors(spark, sf), "vectors")
    return [v.filter(F.col("split") == s) for s in ("train", "val", "test")]


_GRID_RUNS, _SEED_RUNS = _plain_runs("grid"), _plain_runs("seeds")
_VEC_SQL = f"{fx.VECTORS_SQL}, {_XS_SQL}, {_DIMS_SQL}"
_GRID_SQL = f"gruns AS {_runs_sql(_GRID_RUNS, seeded=False)}, {_training_sql('g', 'gruns')}"
_WIDE_SQL = """v.auroc AS val_auroc, v.aurac AS val_aurac, v.balanced_acc AS val_balanced_acc, t.auroc AS test_auroc, t.aurac AS test_aurac, t.balanced_acc AS test_balanced_acc"""


@query("mlp_train_steps", f"""WITH {_VEC_SQL}, sruns AS {_runs_sql(_SEED_RUNS)}, {_training_sql('s', 'sruns')}
    SELECT CAST(run AS INTEGER) AS run_id, i, round(value, 6) AS value FROM sw{STEPS}""")
def mlp_train_steps(spark, sf):
    train, val, _ = _three(spark, sf)
    done = tr.train_runs(train, val, _SEED_RUNS, **_how(fx.vector_width(train), seeds=tr.SEEDS_DEFAULT))
    rows = tr.weights_table(spark, done.weights)
    return rows.select("run_id", F.posexplode("weights").alias("i", "value")).select("run_id", F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


@query("grid_sweep_steps", f"""WITH {_VEC_SQL}, {_GRID_SQL} SELECT CAST(r.run AS INTEGER) AS run_id, r.lr, r.decay AS weight_decay, {_WIDE_SQL}
    FROM gruns r JOIN gmt v ON v.run = r.run AND v.split = 'val' JOIN gmt t ON t.run = r.run AND t.split = 'test'""")
def grid_sweep_steps(spark, sf):
    train, val, test = _three(spark, sf)
    _, found = ev.train_and_measure(train, val, test, _GRID_RUNS, **_how(fx.vector_width(train), runs=len(_GRID_RUNS)))
    points = [f"{p}_{m}" for p in ("val", "test") for m in ev.METRICS]
    return found.select("run_id", "lr", "weight_decay", *[shown(c).alias(c) for c in points])


def _intervals_sql(p: str, runs: str) -> str:
    """``{p}iv``: (seed, metric, mean, std, ci_low, ci_high) over 1,000 resamples of the test rows."""
    return f"""
{p}num AS (SELECT s.run, r.seed, unc, ok, row_number() OVER (PARTITION BY s.run ORDER BY row_id) - 1 AS row_index FROM {p}sc s JOIN {runs} r ON r.run = s.run WHERE split = 'test'),
{p}dr AS (SELECT r.run, b AS resample, CAST('0x' || substr(md5(r.seed || ':' || b || ':' || i), 1, 15) AS BIGINT) % n AS row_index
  FROM {runs} r, range(1000) q(b), (SELECT DISTINCT row_index AS i FROM {p}num), (SELECT count(DISTINCT row_index) AS n FROM {p}num)),
{p}drawn AS MATERIALIZED (SELECT d.run, n.seed, d.resample, n.unc, n.ok FROM {p}dr d JOIN {p}num n ON n.run = d.run AND n.row_index = d.row_index),
{p}bm AS (WITH {fx.metrics_sql(f"{p}drawn", ["run", "resample"])} SELECT * FROM metrics WHERE balanced_acc >= 0),
{p}bal AS (SELECT d.run, any_value(d.seed) AS seed, d.resample, (count(*) FILTER (NOT ok AND unc >= threshold) / CAST(count(*) FILTER (NOT ok) AS DOUBLE)
    + count(*) FILTER (ok AND NOT unc >= threshold) / CAST(count(*) FILTER (ok) AS DOUBLE)) / 2 AS bal
  FROM {p}drawn d JOIN {p}mt t ON t.run = d.run AND t.split = 'val' GROUP BY d.run, d.resample),
{p}long AS (SELECT seed, unnest(['auroc', 'aurac', 'balanced_acc']) AS metric, unnest([m.auroc, m.aurac, b.bal]) AS v FROM {p}bm m JOIN {p}bal b ON b.run = m.run AND b.resample = m.resample),
{p}iv AS (SELECT CAST(seed AS INTEGER) AS seed, metric, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std,
  round(quantile_cont(v, 0.025), 3) AS ci_low, round(quantile_cont(v, 0.975), 3) AS ci_high FROM {p}long GROUP BY seed, metric)"""


@query("multi_seed_train_steps", f"""WITH {_VEC_SQL}, sruns AS {_runs_sql(_SEED_RUNS)}, {_training_sql('s', 'sruns')}, {_intervals_sql('s', 'sruns')}
    SELECT i.*, round(v.threshold, 6) AS threshold, {_WIDE_SQL} FROM siv i JOIN sruns r ON r.seed = i.seed
    JOIN smt v ON v.run = r.run AND v.split = 'val' JOIN smt t ON t.run = r.run AND t.split = 'test'""")
def multi_seed_train_steps(spark, sf):
    train, val, test = _three(spark, sf)
    found = ev.multi_seed_train(train, val, test, _SEED_RUNS[0], resample="draws", **_how(fx.vector_width(train), seeds=tr.SEEDS_DEFAULT))
    points = [f"{p}_{m}" for p in ("val", "test") for m in ev.METRICS]
    records = found.records.select("seed", F.round(shown("threshold"), 6).alias("threshold"), *[shown(c).alias(c) for c in points])
    return found.intervals.join(records, "seed")


_WINNER_SQL = """won AS (SELECT r.lr, r.decay FROM gruns r JOIN gmt v ON v.run = r.run AND v.split = 'val' ORDER BY v.auroc DESC, r.run LIMIT 1),
sruns AS (SELECT s AS run, s AS seed, lr, decay FROM won, range(5) q(s))"""


@query("sweep_and_select_steps", f"""WITH {_VEC_SQL}, {_GRID_SQL}, {_WINNER_SQL}, {_training_sql('s', 'sruns')}, {_intervals_sql('s', 'sruns')}
    SELECT metric, round(avg(mean), 6) AS mean_of_bootstrapped_means, round(stddev_pop(mean), 6) AS std_across_seeds,
      (SELECT lr FROM won) AS lr, (SELECT decay FROM won) AS weight_decay FROM siv GROUP BY metric""")
def sweep_and_select_steps(spark, sf):
    train, val, test = _three(spark, sf)
    dim = fx.vector_width(train)
    chosen = ev.sweep_and_select(
        train, val, test, PLAIN_GRID, run={"dropout": 0.0, "batch_size": FULL_BATCH}, epochs=STEPS, mode="exact",
        grid_how={"initial": _how(dim, runs=9)["initial"]}, seed_how={"initial": _how(dim, seeds=tr.SEEDS_DEFAULT)["initial"], "resample": "draws"},
    )
    return chosen.report.select("metric", *[F.round(c, 6).alias(c) for c in ("mean_of_bootstrapped_means", "std_across_seeds")], "lr", "weight_decay")


_LEARN_ROWS_SQL = f"""{_MIXED_SQL}, flag AS (SELECT tid, CASE WHEN lower(dataset) IN ('coqa', 'newsqa', 'emrqa', 'nq', 'triviaqa') THEN rouge_l >= 0.3 ELSE label = pred END AS ok FROM rouge),
{fx.words_sql('turns', 'tid')}, placed AS (SELECT tid, s, row_number() OVER (PARTITION BY tid ORDER BY s DESC) AS r FROM norms),
raw AS (SELECT f.tid AS row_id, f.ok, CAST(l.label AS FLOAT) AS label, CASE f.tid // 1000 % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split
  FROM flag f JOIN (SELECT tid, avg(s) AS label FROM placed WHERE r <= 5 GROUP BY tid) l ON l.tid = f.tid),
span AS (SELECT CAST(min(label) AS DOUBLE) AS lo, CAST(max(label) AS DOUBLE) AS hi FROM raw WHERE split = 'train'),
vectors AS MATERIALIZED (SELECT row_id, ok, split, CAST(greatest(least((CAST(label AS DOUBLE) - lo) / greatest(hi - lo, 1e-8), 1), 0) AS FLOAT) AS y FROM raw, span),
xs AS MATERIALIZED (SELECT tid AS row_id, i AS d, CAST(CAST('0x' || substr(md5(text), CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS DOUBLE) / 16 AS v
  FROM turns, range(8) r(i) WHERE tid IN (SELECT row_id FROM vectors)), hh AS (SELECT 8 AS dd, 2 AS nh)"""


@query("learn_and_evaluate_steps", f"""{_LEARN_ROWS_SQL}, {_GRID_SQL}, {_WINNER_SQL}, {_training_sql('s', 'sruns')},
    best AS (SELECT run FROM smt WHERE split = 'test' ORDER BY auroc DESC, run LIMIT 1)
    SELECT auroc, aurac, balanced_acc, (SELECT count(*) FROM vectors WHERE split = 'test') AS n_samples,
      (SELECT count(*) FROM vectors WHERE split = 'test' AND ok) AS n_correct FROM smt WHERE split = 'test' AND run = (SELECT run FROM best)""")
def learn_and_evaluate_steps(spark, sf):
    conv = F.expr("row_id div 1000 % 10")
    split = F.when(conv == 8, "val").when(conv == 9, "test").otherwise("train")
    emb = embed_prompts(_turn_prompts(spark, sf), digest_vectors).drop("label")
    m = ev.learn_and_evaluate(
        _results(spark, sf).withColumn("split", split), _result_logits(spark, sf), emb, F.col("dataset"), "turns", fresh_path(spark, "registry"),
        grid=PLAIN_GRID, run={"dropout": 0.0, "batch_size": FULL_BATCH}, epochs=STEPS, mode="exact",
        grid_how={"initial": _how(8, runs=9)["initial"]}, seed_how={"initial": _how(8, seeds=tr.SEEDS_DEFAULT)["initial"], "resample": "draws"},
    )
    return m.select(*[shown(c).alias(c) for c in ev.METRICS], "n_samples", "n_correct")


# --- training at the published settings: the grid of rates and batch sizes, 100 epochs of mini-batches, dropout,
# validation every 2,000 steps and after the last one, early stop ------------------------------------------------

#: In how many parts the rows are dealt, and after how many epochs their weights are averaged: part of the settings.
PARTS, SYNC_EPOCHS = 4, 5
PUBLISHED = {"epochs": tr.EPOCHS_DEFAULT, "val_steps": tr.VAL_STEPS_DEFAULT, "mode": "averaged", "parts": PARTS, "sync_epochs": SYNC_EPOCHS}


def _points():
    return [shown(f"{p}_{m}").alias(f"{p}_{m}") for p in ("val", "test") for m in ev.METRICS]


@query("mlp_train")
def mlp_train(spark, sf):
    train, val, _ = _three(spark, sf)
    done = tr.train_runs(train, val, tr.seed_runs(tr.Run(0)), **PUBLISHED)
    rows = tr.weights_table(spark, done.weights)
    return rows.select("run_id", F.posexplode("weights").alias("i", "value")).select("run_id", F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


@query("grid_sweep")
def grid_sweep(spark, sf):
    _, found = ev.train_and_measure(*_three(spark, sf), tr.grid_runs(), **PUBLISHED)
    return found.select("run_id", "lr", "dropout", "batch_size", *_points())


@query("multi_seed_train")
def multi_seed_train(spark, sf):
    found = ev.multi_seed_train(*_three(spark, sf), tr.grid_runs()[0], **PUBLISHED)
    return found.intervals.join(found.records.select("seed", F.round(shown("threshold"), 6).alias("threshold"), *_points()), "seed")


@query("sweep_and_select")
def sweep_and_select(spark, sf):
    report = ev.sweep_and_select(*_three(spark, sf), **PUBLISHED).report
    return report.select("metric", *[F.round(c, 6).alias(c) for c in ("mean_of_bootstrapped_means", "std_across_seeds")], "lr", "dropout", "batch_size")


@query("learn_and_evaluate")
def learn_and_evaluate(spark, sf):
    conv = F.expr("row_id div 1000 % 10")
    split = F.when(conv == 8, "val").when(conv == 9, "test").otherwise("train")
    emb = embed_prompts(_turn_prompts(spark, sf), digest_vectors).drop("label")
    m = ev.learn_and_evaluate(
        _results(spark, sf).withColumn("split", split), _result_logits(spark, sf), emb, F.col("dataset"), "turns", fresh_path(spark, "registry"), **PUBLISHED
    )
    return m.select(*[shown(c).alias(c) for c in ev.METRICS], "n_samples", "n_correct")
