"""Connected components by alternating stars, written after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.session import materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on its smallest neighbour.

    The large star moves the neighbours above a node, the small star those below it and
    the node itself. Only one number per node is aggregated (partial sums before the
    shuffle), and it joins back as one row per node, so a node of any degree is split by
    the adaptive skew join.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u") if large else both
    out = moved.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        out = out.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node.

    Loops and repeated edges are harmless; rows with a null end are left out. Each round
    is a table in the shared folder, so a lost executor repeats one round at most.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    now = materialise(now, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        now = materialise(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
