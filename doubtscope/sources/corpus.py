"""Question-answering corpora → prompt samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtscope.functions.text import STEPWISE_SUFFIX, STORY_CONFIG
from doubtscope.operators.prefix import running_totals
from doubtscope.operators.prompts import explode_qa, n_pairs, positional_split
from doubtscope.sources.sharded import read_sharded

CORPUS_SCHEMA = "source string, story string, questions array<string>, answers struct<input_text: array<string>>"


def split_rows(train: DataFrame, split: str, validation: DataFrame | None = None) -> DataFrame:
    """Corpus rows of a split: test is the validation table, train and val are row ranges of train."""
    if split == "test":
        if validation is None:
            raise ValueError("the test split needs the validation table")
        return validation
    return positional_split(train, split)


def corpus_split(train: DataFrame, split: str, method: str = "raw", validation: DataFrame | None = None,
                 config: dict | None = STORY_CONFIG) -> DataFrame:
    """Prompt samples of a split."""
    return explode_qa(split_rows(train, split, validation), config, STEPWISE_SUFFIX if method == "cot" else "")


def read_corpus_split(spark: SparkSession, path: str, split: str, method: str = "raw") -> DataFrame:
    """As ``corpus_split`` from ``{path}/train`` and ``{path}/validation`` parquet tables."""
    part = "validation" if split == "test" else "train"
    rows = read_sharded(spark, f"{path}/{part}")
    return corpus_split(rows, split, method, validation=rows)


def numbered_samples(train: DataFrame, split: str, method: str = "raw", validation: DataFrame | None = None,
                     config: dict | None = STORY_CONFIG) -> DataFrame:
    """Prompt samples of a split with a dense ``row_id`` in order of (corpus row, pair); the corpus row
    is ``corpus_row``.

    Numbered by running counts of pairs, two numbers per story: the rendered prompts, which repeat
    the story for each question, are never shuffled.
    """
    rows = split_rows(train, split, validation).withColumnRenamed("row_id", "corpus_row").withColumn("__n", n_pairs())
    counted = running_totals(rows.select("corpus_row", "__n"), [], "corpus_row", {"pairs": "__n"})
    first = counted.select("corpus_row", (F.col("cum_pairs") - F.col("__n")).alias("__first"))
    samples = explode_qa(rows.join(first, "corpus_row"), config, STEPWISE_SUFFIX if method == "cot" else "", row_id="corpus_row", keep=("__first",))
    return samples.withColumn("row_id", F.col("__first") + F.col("qa_idx")).drop("__first")
