"""Connected components of an undirected graph, by rounds of star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.scratch import Workspace, stored


def _with_neighbourhood_minimum(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each edge with the least node among ``node`` and its neighbours ``other``.

    Minima are aggregated before the shuffle, and the join back is one that
    adaptive execution can split, so one node with very many edges is no task
    of its own.
    """
    least = edges.groupBy(node).agg(F.least(F.col(node), F.min(other)).alias("least"))
    return edges.join(least, node)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the nodes of ``edges`` (u long, v long) with the smallest node they reach.

    Returns node, component for every node that has an edge to another node.
    Self loops, repeated and null edges have no effect; no edges give no rows.
    Large-star and small-star rounds alternate until the edges are stars, in
    a number of rounds logarithmic in the number of nodes; only a count and a
    checksum come to the driver.
    """
    with Workspace(edges.sparkSession) as space:
        return stored(_settled(edges, max_rounds, space), "components")


def _settled(edges: DataFrame, max_rounds: int, space: Workspace) -> DataFrame:
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    before = None
    for turn in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_neighbourhood_minimum(both, "u", "v")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        # v is the smaller end of each edge from here on
        down = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            large.join(down, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(down.select("u", F.col("least").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        pairs = space.stored(small, f"edges{turn}")
        space.free(f"edges{turn - 1}")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
