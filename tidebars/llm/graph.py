"""Connected components of links that fit no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.textkit import settle


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node it is linked with, itself included) for every end of edges(a, b).

    Every node hangs under its least neighbour, hooks are shortened until they are flat, and the links between different
    trees are kept for the next round.  A round at least halves the trees that still have links."""
    left = settle(_both_ways(edges.select("a", "b").filter("a != b")), "edges")
    found = None
    while left.head(1):
        up = settle(left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "hooks")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
            moved = settle(up.join(above, "root").select("node", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")), "hooks")
            up = moved.select("node", "root")
            if not moved.filter("moved").head(1):
                break
        if found is None:
            found = up
        else:
            newer = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
            found = settle(found.join(newer, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "roots")
        a, b = (up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
        left = settle(left.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a != b").distinct(), "edges")
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    return edges.select(ends).select("e.a", "e.b").distinct()
