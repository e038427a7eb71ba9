"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prefrank.llm.common import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def contracted(edges: DataFrame) -> DataFrame:
    """One round. Every node hands its larger neighbours, then its smaller ones, to the smallest it knows.

    Minima are combined before the shuffle; the join with them may split a hot node, as its rows need not
    be together.
    """
    ways = both_ways(edges)
    least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that `edges` (u, v) connect each node to. Nodes without edges are not listed.

    Every round is written to the shared folder, so a lost executor repeats one round at most, and rounds
    end when an order-free checksum of the edges stays the same. Rounds grow with the logarithm of the
    nodes; an error is raised beyond `most_rounds`, never a partial result.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == now or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, edges = now, written(contracted(edges))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
