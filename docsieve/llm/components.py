"""Connected components over a table of links, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable from each node that has a link.

    links has two long columns u and v; repeated links, links in both directions and u = v are fine, nulls are
    left out, an empty table gives an empty one. Every round is written to the shared folder and ends in
    aggregates with partial sums, so that a node with very many links never has to be in one task.
    """
    edges = links.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        # Written, so that both sides of the joins are exchanged and a node with very many links can be split among tasks.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large star: every larger neighbour of u goes to the least one around u.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # Small star: the smaller neighbours of u, and u, go to the least of them.
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
