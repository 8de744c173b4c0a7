"""Connected components by alternating stars, for graphs whose edges and components stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that it is connected with. Nodes are longs; loops and repeats do no harm.

    Each round points every larger neighbour of a node at the node's smallest neighbour, then every smaller one; the number of rounds grows with
    the logarithm of the longest chain. A round is two aggregations and joins on the node; a hot node's side of the join can be split.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    for _ in range(rounds):
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), "m").filter("v <> m").distinct()
        down = large.groupBy("v").agg(F.min("m").alias("least"))
        joined = large.join(down, "v")
        edges = cut(joined.select("v", F.col("least").alias("m")).union(joined.filter("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))).distinct())
        # A forest of stars: every node points once, and at a node that points nowhere.
        counts = edges.agg(F.count("v").alias("n"), F.count_distinct("v").alias("nodes")).first()
        if counts["n"] == counts["nodes"] and edges.select("m").join(edges.select(F.col("v").alias("m")), "m", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).union(edges.select("m", "m").distinct())
