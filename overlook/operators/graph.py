"""Connected components of an undirected graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.plans.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    # cut: joined with the aggregate itself, both would keep its partitions, and a hub's edges could not be split
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Nodes that have an edge, as ``(node, component)``; component is the smallest node of each component.

    Alternating large-star and small-star rounds. A round aggregates by node before it joins, so a node with very many
    edges is combined map-side, and the joins are plain equi-joins of tables of their own, which adaptive execution may
    split or broadcast. Lineage is cut by reliable checkpoints in each round. Self-loops and null ends are ignored; an empty graph gives no rows.
    """
    now = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        # decimal sums cannot overflow; equal count and sum of hashes mean that nothing moved
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
