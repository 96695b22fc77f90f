"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): links each node's neighbours to the least of them.

    The least is a sum over a key that combines before the shuffle, then joined back; the join of a hot centre
    is one that Spark can split.
    """
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = turned.unionByName(turned.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else turned
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        found = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return found.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): every node of edges (u, v), with the least node that it reaches."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        if (at := state(now)) == before:
            break
        before = at
        if at[0] == 0:
            break
        last, now = now, cut_lineage(_star(_star(now, large=True), large=False))
        forget(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
