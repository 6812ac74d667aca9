"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edge table, so no
component is ever gathered in one task or on the driver. A hub's edges meet one
row (its minimum) in the join, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                      F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b").where("a <> b").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node.

    edges: columns ``a`` and ``b`` of one orderable type. Self-loops, repeats
    and both directions are allowed. An empty table gives an empty result.
    """
    e = written(edges.select("a", "b").where("a <> b").distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        new = written(_small_star(_large_star(e)), "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(e)
        e = new
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
