"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtscope.session import stored


def component_members(edges: DataFrame) -> DataFrame:
    """(node, root) once for every node of the long columns (a, b): equal roots, same component.

    Each round every node points at its least neighbour, if that comes before itself, and the edges
    move to the nodes pointed at, until none is left. Even rounds order nodes by value, which settles
    stars at once; odd rounds by a hash of node and round, which cuts chains of any numbering to
    expected logarithmic depth. Only grouped minima and key joins are used, so a node with very many
    edges is pre-aggregated or split by the skew join; every round is a written table.
    """
    left = stored(edges.where("a <> b").distinct(), "component-edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    whole = nodes.select("node", F.col("node").alias("root"))
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = (lambda c: F.xxhash64(c, F.lit(turn))) if turn % 2 else F.col
        least = F.min(F.struct(order("b").alias("key"), "b")).alias("least")
        up = both.groupBy("a").agg(least).where(F.col("least.key") < order("a"))
        up = stored(up.select(F.col("a").alias("node"), F.col("least.b").alias("up")), "component-round")
        moved = (
            left.join(up.toDF("a", "ua"), "a", "left")
            .join(up.toDF("b", "ub"), "b", "left")
            .select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b"))
        )
        left = stored(moved.where("a <> b").distinct(), "component-edges")
        whole = whole.join(up.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        turn += 1
    return whole
