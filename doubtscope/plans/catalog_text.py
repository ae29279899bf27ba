"""Registered queries: prompts, correctness, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtscope.functions import naming as nm
from doubtscope.functions import text as tx
from doubtscope.operators.prompts import explode_qa, limit_samples, positional_split, row_range
from doubtscope.plans import fixtures as fx
from doubtscope.plans.registry import query, shown, table
from doubtscope.session import fresh_path
from doubtscope.sources import corpus
from doubtscope.sources.sharded import find_artifacts, read_sharded

_QA = f"WITH {fx.CORPUS_SQL}"
_PAIRS = f"WITH {fx.PAIRS_SQL}"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _template_sql(template: str, suffix: str) -> str:
    out = _lit(template)
    for field, value in (("story", "story"), ("question", "question"), ("instruction_suffix", _lit(suffix))):
        out = out.replace("{" + field + "}", f"' || {value} || '")
    return out


_STORY = _template_sql(tx.STORY_CONFIG["user_prompt_template"], tx.STEPWISE_SUFFIX)


@query(
    "render_prompt",
    f"{_QA} SELECT row_id, CAST(qa_idx AS INTEGER) AS qa_idx, {_template_sql(tx.DEFAULT_USER_TEMPLATE, '')} AS text FROM qa",
)
def render_prompt(spark, sf):
    e = explode_qa(fx.corpus(spark, sf), config=None)
    return e.select("row_id", "qa_idx", F.element_at("prompt", 1)["content"].alias("text"))


@query(
    "chat_messages",
    f"""{_QA}, m AS (SELECT row_id, qa_idx, CAST(0 AS INTEGER) AS msg, 'system' AS role, {_lit(tx.STORY_CONFIG['system_prompt'])} AS content FROM qa
        UNION ALL SELECT row_id, qa_idx, 1, 'user', {_STORY} FROM qa)
        SELECT row_id, CAST(qa_idx AS INTEGER) AS qa_idx, msg, role, content FROM m""",
)
def chat_messages(spark, sf):
    e = explode_qa(fx.corpus(spark, sf), tx.STORY_CONFIG, tx.STEPWISE_SUFFIX)
    return e.select("row_id", "qa_idx", F.posexplode("prompt").alias("msg", "m")).select("row_id", "qa_idx", "msg", "m.*")


@query(
    "explode_qa",
    f"""{_QA} SELECT row_id, CAST(qa_idx AS INTEGER) AS qa_idx, label, 'coqa_row' || row_id || '_qa' || qa_idx AS data_source,
        label AS ground_truth, 'gt' AS style, label AS value FROM qa""",
)
def qa_rows(spark, sf):
    e = explode_qa(fx.corpus(spark, sf), tx.STORY_CONFIG)
    return e.select("row_id", "qa_idx", "label", "data_source", "ground_truth", "reward_model.*")


@query(
    "positional_split",
    """WITH n AS (SELECT count(*) AS n FROM events)
    SELECT event_id AS row_id, 'train' AS split FROM events, n WHERE event_id < n - 2 * (n // 10)
    UNION ALL SELECT event_id, 'val' FROM events, n WHERE event_id >= n - 2 * (n // 10) AND event_id < n - n // 10""",
)
def split_rows(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("row_id"))
    return positional_split(e, "train").withColumn("split", F.lit("train")).unionByName(
        positional_split(e, "val").withColumn("split", F.lit("val"))
    )


@query(
    "read_corpus_split",
    f"""WITH {fx.CORPUS_SQL}, d AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM corpus)
        SELECT i AS row_id, CAST(qa_idx AS INTEGER) AS qa_idx, label, {_STORY} AS text FROM qa JOIN d ON d.row_id = qa.row_id
        WHERE i >= n - 2 * (n // 10) AND i < n - n // 10""",
)
def read_corpus_split(spark, sf):
    """The corpus as files, in shards of a table in order, read back and split."""
    path = fresh_path(spark, "corpus")
    rows = fx.corpus(spark, sf).repartitionByRange(4, "row_id").sortWithinPartitions("row_id").drop("row_id")
    rows.write.parquet(f"{path}/train-0000-of-0001.parquet")
    e = corpus.read_corpus_split(spark, path, "val", "cot")
    return e.select("row_id", "qa_idx", "label", F.element_at("prompt", -1)["content"].alias("text"))


@query("limit_samples", "SELECT event_id AS row_id, event_type FROM events WHERE event_id < (SELECT count(*) // 3 FROM events)")
def first_rows(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type")
    return limit_samples(e, e.count() // 3)


@query(
    "row_range",
    """SELECT o_orderkey AS row_id, o_orderstatus FROM orders, (SELECT count(*) AS n FROM orders) WHERE o_orderkey >= n // 4 AND o_orderkey < 3 * n // 4""",
)
def rows_between(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    n = o.count()
    return row_range(o, n // 4, 3 * n // 4)


@query(
    "flatten_chat",
    f"""WITH {fx.TURNS_SQL}, w AS (SELECT tid, string_split(text, chr(10)) AS parts FROM turns)
        SELECT tid, CASE WHEN tid % 7 = 0 THEN '' ELSE array_to_string(list_transform(parts,
            lambda x: CASE WHEN length(x) % 5 = 0 THEN '' ELSE x END), ' ') END AS text FROM w""",
)
def flatten_chat(spark, sf):
    t = fx.turns(spark, sf)
    messages = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(F.lit("user").alias("role"), F.when(F.length(x) % 5 != 0, x).alias("content")),
    )
    return t.select("tid", tx.flatten_chat(F.when(F.col("tid") % 7 != 0, messages)).alias("text"))


@query(
    "label_text",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def label_text(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select("doc_id", tx.label_text(F.col("quality")).alias("label"))


@query(
    "is_correct_exact",
    """SELECT event_id, coalesce(CASE WHEN event_id % 9 > 0 THEN event_type END
              = CASE WHEN event_id % 10 > 0 THEN CASE event_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'error' WHEN 2 THEN 'Click' ELSE event_type END END,
              false) AS ok FROM events""",
)
def is_correct_exact(spark, sf):
    i = F.col("event_id")
    pred = F.when(i % 4 == 0, "view").when(i % 4 == 1, "error").when(i % 4 == 2, "Click").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id", tx.is_correct_exact(F.when(i % 9 > 0, F.col("event_type")), F.when(i % 10 > 0, pred)).alias("ok")
    )


@query(
    "is_correct_lists",
    f"""{_PAIRS}, w AS (SELECT tid, list_sort(list_filter(string_split(pred, ' '), lambda x: length(x) % 4 <> 0)) AS a,
            list_sort(CASE WHEN tid % 3 = 0 THEN string_split(label, ' ')
                 ELSE list_filter(string_split(pred, ' '), lambda x: length(x) % 4 <> 0) END) AS b FROM pairs)
        SELECT tid, a = b AS ok FROM w""",
)
def is_correct_lists(spark, sf):
    p = fx.qa_pairs(spark, sf)
    words = F.split("pred", " ")
    some = F.transform(words, lambda x: F.when(F.length(x) % 4 != 0, x))
    other = F.when(F.col("tid") % 3 == 0, F.split("label", " ")).otherwise(F.reverse(some))
    return p.select("tid", tx.is_correct_exact(some, other, lists=True).alias("ok"))


@query("rouge_l", f"{_PAIRS}, {fx.rouge_sql('pairs', 'tid')} SELECT tid, round(rouge_l, 9) AS rouge_l FROM rouge")
def rouge_l(spark, sf):
    return tx.with_rouge_l(fx.qa_pairs(spark, sf), "label", "pred").select("tid", shown("rouge_l").alias("rouge_l"))


@query(
    "is_correct_qa",
    f"""{_PAIRS}, n AS (SELECT tid, CASE WHEN tid % 17 > 0 THEN label END AS label, pred FROM pairs),
        {fx.rouge_sql('n', 'tid')} SELECT tid, label IS NOT NULL AND rouge_l >= 0.3 AS ok FROM rouge""",
)
def is_correct_qa(spark, sf):
    p = fx.qa_pairs(spark, sf).withColumn("label", F.when(F.col("tid") % 17 > 0, F.col("label")))
    return tx.with_correct_qa(p, "label", "pred").select("tid", "ok")


_MIXED_SQL = f"""{_PAIRS}, n AS (SELECT tid, pred, CASE WHEN tid % 5 = 0 THEN pred ELSE label END AS label,
    ['coqa', 'NewsQA', 'mmlu', 'nq', 'arc', 'TriviaQA'][tid % 6 + 1] AS dataset FROM pairs), {fx.rouge_sql('n', 'tid, dataset')}"""


@query(
    "correctness_dispatch",
    f"""{_MIXED_SQL} SELECT tid, dataset, CASE WHEN lower(dataset) IN ('coqa', 'newsqa', 'emrqa', 'nq', 'triviaqa')
        THEN rouge_l >= 0.3 ELSE label = pred END AS ok FROM rouge""",
)
def correctness_dispatch(spark, sf):
    p = mixed_pairs(spark, sf)
    return tx.with_correct(p, F.col("dataset"), "label", "pred").select("tid", "dataset", "ok")


def mixed_pairs(spark, sf):
    """Pairs of several datasets; every fifth label is the answer itself."""
    p = fx.qa_pairs(spark, sf)
    return p.withColumn("dataset", fx.dataset_of(F.col("tid"))).withColumn(
        "label", F.when(F.col("tid") % 5 == 0, F.col("pred")).otherwise(F.col("label"))
    )


_PARTS = "p AS (SELECT event_id, event_type, user_id, event_id % 4 AS shard, '/models/org--' || event_type || '--v' || user_id AS path FROM events)"


@query(
    "artifact_catalog",
    f"""WITH {_PARTS}, t AS (SELECT *, 'v' || user_id AS tag, event_type || '--v' || user_id AS emb,
            CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM p)
        SELECT event_id, tag, emb, 'coqa_32k_' || tag || '_raw_nres-' || (user_id % 10) || '_set-' || split AS result,
               'coqa_32k_' || tag || '_raw_nres-' || (user_id % 10) || '_logits_set-' || split AS logits,
               'out/coqa_' || emb || '/' || split || '.parquet' AS embedding,
               event_type || '_topk' || (user_id % 7) || '_' || split || '_reg' AS label_file,
               '-' || lpad(CAST(shard AS VARCHAR), 4, '0') || '-of-0004' AS suffix FROM t""",
)
def artifact_catalog(spark, sf):
    e = table(spark, sf, "events")
    path = F.concat(F.lit("/models/org--"), F.col("event_type"), F.lit("--v"), F.col("user_id"))
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("event_id") % 3 + 1).cast("int"))
    n, dataset = F.col("user_id") % 10, F.lit("coqa")
    tag = nm.model_tag(path)
    name = (dataset, F.lit("32k"), tag, F.lit("raw"), n, split)
    return e.select(
        "event_id",
        tag.alias("tag"),
        nm.embedding_tag(path).alias("emb"),
        nm.result_name(*name).alias("result"),
        nm.result_name(*name, logits=True).alias("logits"),
        nm.embedding_path(F.lit("out"), dataset, split, path).alias("embedding"),
        nm.label_file(F.col("event_type"), F.col("user_id") % 7, split).alias("label_file"),
        nm.shard_suffix(F.col("event_id") % 4, F.lit(4)).alias("suffix"),
    )


@query(
    "size_suffix",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id * 1024 ELSE user_id END AS n_tokens FROM events""",
)
def size_suffix(spark, sf):
    size = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "k").otherwise(""))
    return table(spark, sf, "events").select("event_id", nm.size_in_tokens(size).alias("n_tokens"))


def artifact_files(spark, sf):
    """File names of results and logits, whole and in shards, per (type, user) and split."""
    e = table(spark, sf, "events")
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("event_id") % 3 + 1).cast("int"))
    mark = F.when(F.col("event_id") % 5 == 0, "_logits").otherwise("")
    shard = F.when(F.col("event_id") % 7 == 0, "").otherwise(nm.shard_suffix(F.col("event_id") % 4, F.lit(4)))
    name = F.concat(F.lit("coqa_32k_"), F.col("event_type"), F.lit("-v"), F.col("user_id"), F.lit("_raw_nres-1"), mark,
                    F.lit("_set-"), split, shard, F.lit(".parquet"))
    return e.select("event_id", split.alias("split"), name.alias("name"))


@query(
    "candidate_stems",
    """WITH f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
            'coqa_32k_' || event_type || '-v' || user_id || '_raw_nres-1' || CASE WHEN event_id % 5 = 0 THEN '_logits' ELSE '' END
            || '_set-' AS head FROM events)
       SELECT split, head || split AS stem, min(event_id) AS ord FROM f WHERE NOT contains(head, '_logits') GROUP BY ALL""",
)
def candidate_stems(spark, sf):
    f = artifact_files(spark, sf).filter(~F.col("name").contains("_logits"))
    return f.groupBy("split", nm.stem_of(F.col("name")).alias("stem")).agg(F.min("event_id").alias("ord"))


@query(
    "find_candidates",
    """WITH f AS (SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM events),
       c AS (SELECT 'qa_32k_m-' || event_type || '_raw_nres-1_set-' || s.split AS stem, s.split, k % 2 AS sharded, count(*) AS n_rows FROM f,
         (VALUES ('train'), ('val')) s(split) WHERE (event_id % 4 = 0) = (s.split = 'val') GROUP BY ALL)
       SELECT split, stem, CAST(row_number() OVER (PARTITION BY split ORDER BY sharded, stem) - 1 AS INTEGER) AS ord, n_rows FROM c""",
)
def find_candidates(spark, sf):
    """Result and logits tables of several models as files, whole or in shards; what a listing finds, and the rows each candidate reads."""
    e = table(spark, sf, "events").withColumn("split", F.when(F.col("event_id") % 4 == 0, "val").otherwise("train"))
    root = fresh_path(spark, "found")
    kinds = sorted(r.event_type for r in e.select("event_type").distinct().collect())
    for k, kind in enumerate(kinds):
        for split in ("train", "val"):
            rows = e.filter((F.col("event_type") == kind) & (F.col("split") == split)).select(F.col("event_id").alias("n"))
            stem = f"{root}/qa/qa_32k_m-{kind}_raw_nres-1"
            rows.limit(1).write.parquet(f"{stem}_logits_set-{split}.parquet")
            if k % 2:
                for i in range(2):
                    rows.filter(F.col("n") % 2 == i).write.parquet(f"{stem}_set-{split}-{i:04d}-of-0002.parquet")
            else:
                rows.write.parquet(f"{stem}_set-{split}.parquet")
    found = []
    for split in ("train", "val"):
        for at, stem in enumerate(find_artifacts(spark, root, "qa", split, "32k", "raw", "1")):
            found.append((split, stem.rsplit("/", 1)[-1], at, read_sharded(spark, stem).count()))
    return spark.createDataFrame(found, "split string, stem string, ord int, n_rows bigint")


@query(
    "distinct_stems",
    """SELECT 'coqa_32k_' || event_type || '-v' || user_id AS stem, min(event_id) AS ord FROM events GROUP BY 1""",
)
def distinct_stems(spark, sf):
    from doubtscope.sources.sharded import distinct_stems as ordered

    e = table(spark, sf, "events")
    stems = e.select(F.concat(F.lit("coqa_32k_"), F.col("event_type"), F.lit("-v"), F.col("user_id")).alias("stem"), F.col("event_id").alias("ord"))
    return ordered(stems)
