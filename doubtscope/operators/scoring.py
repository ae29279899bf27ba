"""Running a model over a table: prompts → answers with logits, prompts → vectors, prompts → scores.

The model is a Python callable the user supplies; it gets a batch and returns a batch, inside
``mapInPandas``, so its state lives once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtscope.functions import tokens as tok
from doubtscope.functions.mixing import draw_below
from doubtscope.functions.text import flatten_chat, label_text, strip
from doubtscope.operators.network import mlp_score

BATCH_DEFAULT = 500
CANDIDATES = "array<map<bigint,struct<logprob:double,decoded_token:string,rank:int>>>"
RESPONSE_FIELDS = ["generated_text", "answer", "answer_token_index", "answer_token_topk_logits", "gen_topk_logits"]


def batch_score(samples: DataFrame, predictor: Callable[[list[str]], list[list[tuple]]],
                batch_size: int = BATCH_DEFAULT, keys: list[str] | None = None) -> DataFrame:
    """Ask ``predictor`` for answers → (keys…, response_idx, text, candidates).

    ``predictor(texts)`` returns, per text, a list of (answer text, per-token candidate maps).
    """
    keys = keys or ["row_id"]
    asked = samples.select(*keys, flatten_chat(F.col("prompt")).alias("__text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                answers = predictor(part["__text"].tolist())
                take = [i for i, a in enumerate(answers) for _ in a]
                flat = [(j, *r) for a in answers for j, r in enumerate(a)]
                out = part[keys].iloc[take].reset_index(drop=True)
                out["response_idx"] = np.array([f[0] for f in flat], dtype=np.int32)
                out["generated_text"] = [f[1] for f in flat]
                out["candidates"] = [f[2] for f in flat]
                yield out

    types = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return asked.mapInPandas(run, f"{schema}, response_idx int, generated_text string, candidates {CANDIDATES}")


def answer_fields(responses: DataFrame, k: int = tok.TOPK_DEFAULT) -> DataFrame:
    """Candidates → ordered top-k entries, stripped answer, index and entries of the last token."""
    entries = responses.withColumn("gen_topk_logits", tok.topk_entries(F.col("candidates"), k)).drop("candidates")
    logits = F.col("gen_topk_logits")
    return entries.withColumns(
        {
            "answer": strip(F.col("generated_text")),
            "answer_token_index": tok.answer_token_index(logits),
            "answer_token_topk_logits": tok.answer_token_topk(logits),
        }
    )


_ENTRY = pa.struct([("logprob", pa.float64()), ("decoded_token", pa.string()), ("rank", pa.int32())])
_CANDIDATES = pa.list_(pa.map_(pa.int64(), _ENTRY))


def _arrow_candidates(tokens) -> list | None:
    """Per-token maps as Arrow takes them: key-value pairs, entries as dicts or in field order."""
    if tokens is None:
        return None
    names = [f.name for f in _ENTRY]
    return [
        None if t is None else [(k, v if v is None or isinstance(v, dict) else dict(zip(names, v, strict=True))) for k, v in t.items()]
        for t in tokens
    ]


def infer_wide(samples: DataFrame, predictor, n_responses: int, k: int = tok.TOPK_DEFAULT,
               batch_size: int = BATCH_DEFAULT) -> DataFrame:
    """Samples with the columns of every response beside them.

    The batch that asks the model also writes the wide row, so answers and logits are never shuffled:
    the samples' own columns pass through untouched. Responses beyond ``n_responses`` are left out,
    missing ones are null.
    """
    asked = samples.withColumn("__text", flatten_chat(F.col("prompt")))
    types = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    made = [f"generated_text_{i} string, candidates_{i} {CANDIDATES}" for i in range(n_responses)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                part = whole.slice(at, batch_size)
                answers = predictor(part.column("__text").to_pylist())
                columns = {c: part.column(c) for c in types}
                for i in range(n_responses):
                    own = [a[i] if i < len(a) else (None, None) for a in answers]
                    columns[f"generated_text_{i}"] = pa.array([o[0] for o in own], pa.string())
                    columns[f"candidates_{i}"] = pa.array([_arrow_candidates(o[1]) for o in own], _CANDIDATES)
                yield pa.RecordBatch.from_pydict(columns)

    wide = asked.mapInArrow(run, schema)
    for i in range(n_responses):
        wide = wide.withColumn(f"gen_topk_logits_{i}", tok.topk_entries(F.col(f"candidates_{i}"), k)).drop(f"candidates_{i}")
    fields = {}
    for i in range(n_responses):
        logits = F.col(f"gen_topk_logits_{i}")
        fields[f"answer_{i}"] = strip(F.col(f"generated_text_{i}"))
        fields[f"answer_token_index_{i}"] = tok.answer_token_index(logits)
        fields[f"answer_token_topk_logits_{i}"] = tok.answer_token_topk(logits)
    return wide.withColumns(fields)


def hash_embed(df: DataFrame, text: str, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Built-in embedder: words counted in ``dim`` buckets by their MD5, scaled to unit length.

    Runs in the JVM, in one pass over the words; the digest makes it repeatable in any engine. A text
    without words, or null, is the zero vector.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    buckets = F.transform(words, lambda w: draw_below(F.lit(dim), w).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="__buckets", outputCol="__tf")
    counts = counter.transform(df.withColumn("__buckets", buckets))
    unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(counts)
    vector = vector_to_array("__unit", dtype="float32")
    return unit.withColumn(out, vector).drop("__buckets", "__tf", "__unit")


def embed_prompts(results: DataFrame, embedder: Callable[[DataFrame, str], DataFrame] | None = None,
                  dim: int = 64) -> DataFrame:
    """(row_id, prompt text, label text, embedding). ``embedder(df, text_column)`` adds ``embedding``."""
    flat = results.select("row_id", flatten_chat(F.col("prompt")).alias("prompt"), label_text(F.col("label")).alias("label"))
    made = embedder(flat, "prompt") if embedder else hash_embed(flat, "prompt", dim)
    return made.select("row_id", "prompt", "label", F.col("embedding").cast("array<float>").alias("embedding"))


def batch_embedder(encode: Callable[[list[str]], np.ndarray], batch_size: int = BATCH_DEFAULT):
    """Turn ``encode(texts) -> matrix`` into an embedder for ``embed_prompts``."""

    def embedder(df: DataFrame, text: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                rows = [encode(s.iloc[i : i + batch_size].tolist()) for i in range(0, len(s), batch_size)]
                yield pd.Series([v for m in rows for v in np.asarray(m, dtype=np.float32)])

        return df.withColumn("embedding", vectors(text))

    return embedder


def score_prompts(prompts: DataFrame, weights: np.ndarray, embedder=None, dim: int = 64) -> DataFrame:
    """Prompt → vector → score in one plan, without a shuffle; works on streams as well."""
    vectors = embed_prompts(prompts, embedder, dim)
    return mlp_score(vectors, {0: weights}).drop("run_id")
