"""Prompt text, answer text and correctness as ``Column`` functions."""

from __future__ import annotations

from collections.abc import Iterator
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Results must equal the published prompt layout and rules.
DEFAULT_USER_TEMPLATE = (
    "Story:\n{story}\n\nQ: {question}\nAnswer in a few words based on the story. "
    'If the answer is not in the story, answer "unknown".{instruction_suffix}'
)
STORY_CONFIG = {
    "system_prompt": (
        "You are a reading comprehension assistant. Answer the question about a given story with "
        "brief, direct answers. Please only use the information from the story to give your "
        "answer.\n"
    ),
    "user_prompt_template": (
        "Story:\n{story}\n\nQuestion:\n{question}\n\n{instruction_suffix}\n"
    ),
}
STEPWISE_SUFFIX = " Let's think step by step."
TEXT_ANSWER_DATASETS = ("coqa", "newsqa", "emrqa", "nq", "triviaqa")
OVERLAP_THRESHOLD = 0.3
WORD_PATTERN = "[a-z0-9]+"
# White space as Python's str.strip sees it: Unicode White_Space and the separators FS, GS, RS, US
_SPACE = "[\\s\\x1c-\\x1f]"


# --- prompts -----------------------------------------------------------------------------------


def render_template(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{field}`` placeholders from columns; unknown fields fail when the plan is built."""
    parts, missing = [], []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            if field in values:
                parts.append(values[field])
            else:
                missing.append(field)
    if missing:
        raise ValueError(f"the template needs fields that have no value: {sorted(set(missing))}")
    return F.concat(*parts) if parts else F.lit("")


def resolve_prompts(config: dict | None, system_prompt=None) -> tuple[str | None, str]:
    """(system prompt, user template): an explicit system prompt wins over the config's."""
    system = system_prompt
    if system is None and config is not None:
        system = config.get("system_prompt")
    if isinstance(system, dict) and "content" in system:
        system = system["content"]
    template = DEFAULT_USER_TEMPLATE if config is None else config["user_prompt_template"]
    return system, template


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(user: Column, system_prompt: str | None) -> Column:
    """``array<struct<role, content>>``, led by the system message if there is one."""
    messages = [_message("user", user)]
    if system_prompt is not None:
        messages.insert(0, _message("system", F.lit(str(system_prompt))))
    return F.array(*messages)


def flatten_chat(prompt: Column) -> Column:
    """Chat messages → plain text, contents joined by a space; null → ''."""
    contents = F.transform(prompt, lambda m: F.coalesce(m["content"], F.lit("")))
    return F.coalesce(F.array_join(contents, " "), F.lit(""))


def label_text(label: Column) -> Column:
    return F.coalesce(label.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, as ``str.strip`` does."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+\\z", "")


# --- correctness -------------------------------------------------------------------------------


def canonical_list(values: Column) -> Column:
    """Sorted non-null elements as strings: lists compare as bags."""
    return F.array_sort(F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: x.cast("string")))


def is_correct_exact(label: Column, pred: Column, lists: bool = False) -> Column:
    """Equal and neither null. With ``lists`` both sides are arrays and order does not count."""
    if lists:
        label, pred = canonical_list(label), canonical_list(pred)
    else:
        label, pred = label.cast("string"), pred.cast("string")
    return F.coalesce(label == pred, F.lit(False))


def overlap_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def _f_measure(common: Column, n_label: Column, n_pred: Column) -> Column:
    precision, recall = common / n_pred, common / n_label
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel: one big-integer step per element of ``a``."""
    where: dict[str, int] = {}
    for j, word in enumerate(b):
        where[word] = where.get(word, 0) | (1 << j)
    full = (1 << len(b)) - 1
    open_ = full
    for word in a:
        hit = open_ & where.get(word, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(b) - open_.bit_count()


@F.pandas_udf(IntegerType())
def _lcs_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series(
            [None if a is None or b is None else lcs_length(list(a), list(b)) for a, b in zip(left, right)],
            dtype="Int32",
        )


def with_rouge_l(df: DataFrame, label: str, pred: str, out: str = "rouge_l") -> DataFrame:
    """Add the ROUGE-L F measure of two text columns; null when either is null. Whole texts."""
    words = df.withColumn("__a", overlap_words(F.col(label))).withColumn("__b", overlap_words(F.col(pred)))
    common = words.withColumn("__lcs", _lcs_udf("__a", "__b"))
    f = _f_measure(F.col("__lcs"), F.size("__a"), F.size("__b"))
    return common.withColumn(out, F.when(F.col("__lcs").isNotNull(), f)).drop("__a", "__b", "__lcs")


def with_correct_qa(
    df: DataFrame, label: str, pred: str, out: str = "ok", threshold: float = OVERLAP_THRESHOLD
) -> DataFrame:
    """Add ROUGE-L >= threshold; null on either side is wrong.

    F = 2·LCS/(m+n), so a pair whose shorter side is too short to reach the threshold, or that shares
    no word, is settled without computing the LCS and sends no text to Python.
    """
    words = df.withColumn("__a", overlap_words(F.col(label))).withColumn("__b", overlap_words(F.col(pred)))
    m, n = F.size("__a"), F.size("__b")
    needed = (F.lit(threshold) - 1e-9) * (m + n) / 2
    reachable = (F.least(m, n) >= needed) & F.arrays_overlap("__a", "__b")
    asked = words.withColumn("__ask", F.col("__a").isNotNull() & F.col("__b").isNotNull() & reachable)
    common = asked.withColumn(
        "__lcs", _lcs_udf(F.when(F.col("__ask"), F.col("__a")), F.when(F.col("__ask"), F.col("__b")))
    )
    f = _f_measure(F.col("__lcs"), F.size("__a"), F.size("__b"))
    ok = F.coalesce(F.col("__ask") & (f >= threshold), F.lit(False)) if threshold > 0 else (
        F.col(label).isNotNull() & F.col(pred).isNotNull()
    )
    return common.withColumn(out, ok).drop("__a", "__b", "__ask", "__lcs")


def uses_text_overlap(dataset: Column) -> Column:
    """Whether a dataset's answers are judged by overlap instead of equality."""
    return F.lower(dataset).isin(*TEXT_ANSWER_DATASETS)


def _is_list(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, ArrayType)


def with_correct(df: DataFrame, dataset: Column, label: str, pred: str, out: str = "ok") -> DataFrame:
    """Correctness by the rule of each row's dataset, so tables may mix datasets.

    Lists compare as bags; a side that is no list counts as a list of one then. For the overlap rule
    a list is the text of its sorted elements.
    """
    lists = _is_list(df, label) or _is_list(df, pred)

    def bag(name: str) -> Column:
        if _is_list(df, name):
            return canonical_list(F.col(name))
        return F.when(F.col(name).isNotNull(), F.array(F.col(name).cast("string")))

    def text(name: str) -> Column:
        return F.array_join(canonical_list(F.col(name)), " ") if _is_list(df, name) else F.col(name).cast("string")

    asked = df.withColumn("__qa", F.coalesce(uses_text_overlap(dataset), F.lit(False)))
    asked = asked.withColumn("__label", F.when(F.col("__qa"), text(label))).withColumn("__pred", text(pred))
    judged = with_correct_qa(asked, "__label", "__pred", "__ok")
    exact = is_correct_exact(bag(label), bag(pred), lists=True) if lists else is_correct_exact(F.col(label), F.col(pred))
    return judged.withColumn(out, F.when(F.col("__qa"), F.col("__ok")).otherwise(exact)).drop("__qa", "__label", "__pred", "__ok")
