"""Connected components by alternating large-star and small-star.

Each round joins every node's neighbours to the smallest of them, by grouped minima and equi-joins alone; no component
is ever gathered. Rounds end when the edges are stars around their smallest nodes. Each round's edges are written to the
shared folder, so a lost executor costs no more than the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, both: DataFrame, keep_larger: bool) -> DataFrame:
    """both: (u, v) for the neighbours v of u to look at. Links these (and u) to the smallest of u and them."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if keep_larger:
        linked = linked.where(F.col("v") > F.col("u"))
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not keep_larger:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (u, v), component being its smallest node. Nodes are longs, never null."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(edges, both, True)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = materialise(_star(down, down, False), name)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
