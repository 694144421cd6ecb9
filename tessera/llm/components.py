"""Connected components as DataFrame rounds of large-star and small-star.

Labels and links stay distributed; each round is written to the shared folder,
so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._io import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v), u > v.

    Large: every greater neighbour of a node is tied to the node's least
    neighbour (itself included).  Small: likewise its lesser neighbours.
    """
    if large:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("a"), "m", "u")
        out = out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of links ``(u, v)``; component is the least node reachable.

    Links may repeat, run either way or join a node to itself (then ignored).
    Nulls are dropped.  No links give an empty result.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, "links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(most_rounds):
        new = materialise(_star(_star(now, True), False), "links")
        discard(now)
        now = new
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    # all links are now stars: node to least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
