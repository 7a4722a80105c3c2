"""Connected components and representatives, as iterated DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.plans.runtime import free, stash

__all__ = ["connected_components"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)``: the smallest node reachable, for every node on an edge.

    Alternates large-star and small-star: each round joins nothing wider than an edge,
    groups on the node, and at the fixpoint every edge points at its component's minimum.
    A hub's neighbour list is never gathered: the minimum per node is an aggregate that
    combines on the map side, then joins back (adaptive execution splits a hub's rows).
    Nulls on either side are no edges; self loops yield their node alone.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = stash(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    work = e.where("u <> v")
    before = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u is tied to u's smallest neighbour
        both = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        last, work = work, stash(small.where("u <> v").distinct())
        free(last)  # written rounds before this one are read no more
        now = work.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(work.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )
