"""Token vectors → one vector per sequence."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOLINGS = ("mean", "last", "both")


def pool_tokens(tokens: DataFrame, mode: str = "mean", key: str = "seq", pos: str = "pos",
                vec: str = "vec", valid: str | None = "valid") -> DataFrame:
    """(key, pos, vec, valid) → (key, embedding); for ``both`` (key, mean, last), in one aggregate.

    ``mean`` averages the valid vectors with a partial aggregate (a long sequence is combined on
    the map side); ``last`` takes the vector of the highest valid position. The vector is all zero
    for a sequence without valid tokens under ``mean``, and null under ``both``'s last.
    """
    if mode not in POOLINGS:
        raise ValueError(f"unknown pooling {mode!r}, expected one of {POOLINGS}")
    ok = F.col(valid) if valid else F.lit(True)
    if mode == "last":
        return tokens.filter(ok).groupBy(key).agg(F.max_by(vec, pos).alias("embedding"))
    as_double = F.transform(F.col(vec), lambda x: x.cast("double"))
    masked = F.when(ok, as_double).otherwise(F.transform(as_double, lambda x: F.lit(0.0)))
    summed = tokens.groupBy(key).agg(
        Summarizer.sum(array_to_vector(masked)).alias("s"),
        F.count_if(ok).alias("n"),
        *([F.max_by(F.when(ok, F.col(vec)), F.when(ok, F.col(pos))).alias("last")] if mode == "both" else []),
    )
    mean = F.transform(vector_to_array("s"), lambda x: x / F.greatest(F.col("n").cast("double"), F.lit(1e-9)))
    return summed.select(key, mean.alias("mean"), "last") if mode == "both" else summed.select(key, mean.alias("embedding"))
