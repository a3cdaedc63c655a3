"""Connected components of a large graph by rounds of contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that has a neighbour; nodes of a component share their root.

    In each round a node joins the neighbour (or itself) that comes first in an order drawn anew by a hash, then edges
    are rewritten between the chosen nodes. The expected number of rounds grows with the logarithm of the longest path.
    Nothing is collected; hubs cost no more than their edges, since minima are taken before the shuffle.
    """
    edges = durable(edges.where("a <> b").distinct())
    placed = None
    turn = 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("best"))
        step = durable(least.select("node", F.least("best", order("node"))["node"].alias("parent")))
        if placed is None:
            placed = step.withColumnRenamed("parent", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "parent")
            placed = durable(placed.join(moved, "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        to = lambda c: step.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))  # noqa: B023, E731
        edges = durable(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
        turn += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if placed is None else placed
