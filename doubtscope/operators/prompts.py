"""Corpus rows → prompt samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.functions.text import chat_messages, render_template, resolve_prompts


def positional_split(df: DataFrame, split: str, row_id: str = "row_id", n: Column | None = None) -> DataFrame:
    """train = first n - 2*(n//10) rows, val = the next n//10; the last tenth is unused.

    The count is a scalar subquery, so the plan stays one job and needs no ordering.
    """
    if split not in ("train", "val"):
        raise ValueError(f"split must be train or val, got {split!r}")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar() if n is None else n
    counted = df.withColumn("__n", total).withColumn("__val", F.expr("__n div 10"))
    start = F.col("__n") - 2 * F.col("__val")
    at = F.col(row_id)
    inside = at < start if split == "train" else (at >= start) & (at < start + F.col("__val"))
    return counted.filter(inside).drop("__n", "__val")


def n_pairs() -> Column:
    """Number of (question, answer) pairs of a corpus row."""
    return F.least(F.coalesce(F.size("questions"), F.lit(0)), F.coalesce(F.size("answers.input_text"), F.lit(0)))


def explode_qa(
    corpus: DataFrame,
    config: dict | None = None,
    instruction: str = "",
    system_prompt=None,
    row_id: str = "row_id",
    tag: str = "coqa",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One prompt sample per (question, answer) pair, cut to the shorter list; nulls become ''.

    ``keep`` names further columns of the corpus row that go along.
    """
    system, template = resolve_prompts(config, system_prompt)
    questions = F.coalesce(F.col("questions"), F.array().cast("array<string>"))
    answers = F.coalesce(F.col("answers.input_text"), F.array().cast("array<string>"))
    n = n_pairs()
    pairs = F.arrays_zip(
        F.slice(questions, 1, n).alias("q"), F.slice(answers, 1, n).alias("a")
    )
    exploded = corpus.select(
        F.col(row_id),
        *keep,
        F.coalesce("story", F.lit("")).alias("story"),
        F.posexplode(pairs).alias("qa_idx", "qa"),
    )
    flat = exploded.select(
        row_id,
        *keep,
        "qa_idx",
        "story",
        F.coalesce("qa.q", F.lit("")).alias("question"),
        F.coalesce("qa.a", F.lit("")).alias("label"),
    )
    user = render_template(
        template,
        {
            "story": F.col("story"),
            "question": F.col("question"),
            "instruction_suffix": F.lit(instruction),
        },
    )
    return flat.select(
        row_id,
        *keep,
        "qa_idx",
        chat_messages(user, system).alias("prompt"),
        "label",
        F.concat(F.lit(f"{tag}_row"), F.col(row_id), F.lit("_qa"), F.col("qa_idx")).alias("data_source"),
        F.col("label").alias("ground_truth"),
        F.struct(F.lit("gt").alias("style"), F.col("label").alias("value")).alias("reward_model"),
    )


def row_range(df: DataFrame, start: int, end: int, row_id: str = "row_id") -> DataFrame:
    return df.filter((F.col(row_id) >= start) & (F.col(row_id) < end))


def limit_samples(df: DataFrame, n: int | None, row_id: str = "row_id") -> DataFrame:
    """The first n rows by row number; all when n is None."""
    return df if n is None else df.filter(F.col(row_id) < n)


def responses_wide(long: DataFrame, n_responses: int, fields: list[str], keys: list[str]) -> DataFrame:
    """(keys, response_idx, fields) → ``<field>_<i>`` columns. The index list is given, so no extra job."""
    wide = long.groupBy(*keys).pivot("response_idx", list(range(n_responses))).agg(
        *[F.first(f).alias(f) for f in fields]
    )
    # Spark names a lone aggregate by the pivot value only
    old = (lambda i, f: f"{i}") if len(fields) == 1 else (lambda i, f: f"{i}_{f}")
    return wide.select(
        *keys,
        *[F.col(f"`{old(i, f)}`").alias(f"{f}_{i}") for i in range(n_responses) for f in fields],
    )


def responses_long(wide: DataFrame, n_responses: int, fields: list[str], keys: list[str]) -> DataFrame:
    """The reverse of ``responses_wide``; responses of all-null fields are dropped."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("response_idx"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
            for i in range(n_responses)
        ]
    )
    kept = F.filter(rows, lambda r: ~_all_null(r, fields))
    return wide.select(*keys, F.explode(kept).alias("r")).select(*keys, "r.*")


def _all_null(r: Column, fields: list[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & r[f].isNull()
    return out
