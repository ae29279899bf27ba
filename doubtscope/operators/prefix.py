"""Running totals over an ordered column without moving a whole group into one task.

A plain ``Window.partitionBy(key).orderBy(x)`` puts all rows of a key in one task, and with no
key the whole table. Here the ordered column is cut into ranges first (approximate quantiles, one
mergeable sketch), each (key, range) is summed on its own, and the per-range totals, at most
``ranges`` rows per key, carry the sums across ranges.

Expressions are SQL text: one call to the JVM each, where composed columns take one per operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _edge_bits(df: DataFrame) -> int:
    """Number of range edges is 2**bits - 1: at least one range per shuffle partition, so ranges shrink
    as partitions are added."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(3, (partitions - 1).bit_length())


def with_ranges(df: DataFrame, order: str, keep: str | None = None) -> DataFrame:
    """Add ``__range``, the range number of ``order`` (the number of range edges below it, found by
    binary search). Ranges hold about equally many rows whatever the spread of the values."""
    bits = _edge_bits(df)
    shares = ", ".join(str(i / (1 << bits)) for i in range(1, 1 << bits))
    sample = df.filter(keep) if keep else df
    edges = sample.select(F.expr(f"percentile_approx({order}, array({shares}), {max(10000, 16 << bits)}) as edges"))
    steps = ", ".join(str(1 << b) for b in reversed(range(bits)))
    search = f"aggregate(array({steps}), 0, (a, s) -> if(get(__edges, a + s - 1) < {order}, a + s, a))"
    return df.withColumn("__edges", edges.scalar()).withColumn("__range", F.expr(search)).drop("__edges")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, str],
    totals: dict[str, str] | None = None,
    keep: str | None = None,
    maxima: dict[str, str] | None = None,
) -> DataFrame:
    """For each row add ``cum_<name>`` (inclusive, ascending in ``order``) and ``all_<name>`` per key.

    ``order`` must be distinct within ``keys``. ``sums`` are summed both ways; ``totals`` only per
    key. ``keep`` says which rows shape the ranges (leave out NaN and infinities). ``maxima`` give
    running maxima ``top_<name>``: inclusive, null while there is none.
    """
    every, maxima = {**sums, **(totals or {})}, maxima or {}
    # a struct is never null, though its fields may be: groups with null keys need no special join,
    # and aggregate, window and join all agree on one hash partitioning
    group = F.expr(f"struct({', '.join([*keys, '__range'])}) as __group")
    ranged = with_ranges(df, order, keep).select("*", group)
    per_range = ranged.groupBy("__group").agg(
        *[F.expr(f"sum({c}) as r_{n}") for n, c in every.items()],
        *[F.expr(f"max({c}) as m_{n}") for n, c in maxima.items()],
    )
    key = f"struct({', '.join(f'__group.{k}' for k in keys)})" if keys else "0"
    over_key = f"over (partition by {key})"
    before = f"over (partition by {key} order by __group.__range rows between unbounded preceding and 1 preceding)"
    offsets = per_range.selectExpr(
        "__group",
        *[f"coalesce(sum(r_{n}) {before}, 0) as before_{n}" for n in sums],
        *[f"sum(r_{n}) {over_key} as all_{n}" for n in every],
        *[f"max(m_{n}) {before} as before_{n}" for n in maxima],
    )
    inside = f"over (partition by __group order by {order} rows between unbounded preceding and current row)"
    local = ranged.selectExpr(
        "*",
        *[f"sum({c}) {inside} as in_{n}" for n, c in sums.items()],
        *[f"max({c}) {inside} as in_{n}" for n, c in maxima.items()],
    )
    return local.join(offsets, "__group").selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"in_{n} + before_{n} as cum_{n}" for n in sums],
        *[f"all_{n}" for n in every],
        *[f"greatest(in_{n}, before_{n}) as top_{n}" for n in maxima],
    )


def dense_index(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Number the rows 0, 1, 2 … in the order of a unique numeric column."""
    keyed = running_totals(df, [], order, {"row": "1L"})
    return keyed.withColumn(name, F.expr("cum_row - 1")).drop("cum_row", "all_row")
