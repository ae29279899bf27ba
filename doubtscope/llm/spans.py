"""Regular-expression matches with their places, in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,whole:string,value:string>>"


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """df with an array column per name: the leftmost non-overlapping matches of (pattern, group).

    Each match has start and end in code points (end exclusive), the whole match and the group's
    text. The text is searched once per pattern; only where something is found is it also split, and
    the lengths of pieces and matches give the places.
    """
    whole = {n: f"__{n}_whole" for n in patterns}
    group = {n: f"__{n}_group" for n in patterns}
    kept = df.columns
    found = df.select(
        "*",
        *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(whole[n]) for n, (p, _) in patterns.items()],
        *[F.regexp_extract_all(text, F.lit(p), F.lit(g)).alias(group[n]) for n, (p, g) in patterns.items() if g],
    )
    none = F.array().cast(SPAN)
    pieces = {n: f"__{n}_pieces" for n in patterns}
    cut = found.select(
        "*", *[F.when(F.size(whole[n]) > 0, F.split(text, p)).otherwise(F.array().cast("array<string>")).alias(pieces[n]) for n, (p, _) in patterns.items()]
    )

    def places(name: str, group_col: str) -> Column:
        w, g, between = F.col(whole[name]), F.col(group_col), F.col(pieces[name])

        def step(acc: Column, i: Column) -> Column:
            end = acc["at"] + F.length(F.get(w, i))
            span = F.struct(acc["at"].alias("start"), end.alias("end"), F.get(w, i).alias("whole"), F.get(g, i).alias("value"))
            return F.struct((end + F.length(F.get(between, i + 1))).alias("at"), F.concat(acc["spans"], F.array(span)).cast(SPAN).alias("spans"))

        start = F.struct(F.length(F.get(between, F.lit(0))).alias("at"), none.alias("spans"))
        return F.when(F.size(w) > 0, F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), start, step, lambda acc: acc["spans"])).otherwise(none)

    return cut.select(*kept, *[places(n, group[n] if g else whole[n]).alias(n) for n, (_, g) in patterns.items()])


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs with these fields, comma-joined in array order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
