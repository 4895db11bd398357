"""Hierarchies and lineage: descendants of nodes and what lies below them.

Edges are (parent, child) rows; a graph may have several parents of a node,
repeated edges and cycles. Rounds are stored, so each is planned by itself;
only a round's count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.scratch import Workspace, stored


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("parent", "child").filter("parent is not null and child is not null").distinct()


def descendants(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Every node that a root leads to: root, node, depth (of the shortest way; the root itself has 0).

    Each round follows the edges of the nodes that the one before reached first,
    so a cycle ends where its nodes are known. As many rounds as the longest
    shortest way has edges. Null and repeated roots and edges have no effect;
    roots without edges lead to themselves.
    """
    spark = edges.sparkSession
    with Workspace(spark) as space:
        clean = space.stored(_clean(edges), "edges")
        known = space.stored(roots.select(F.col(roots.columns[0]).alias("root")).filter("root is not null").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "level0")
        levels, front = [known], known
        for depth in range(1, max_rounds + 1):
            reached = front.join(clean, front["node"] == clean["parent"]).select("root", F.col("child").alias("node")).distinct()
            seen = levels[0]
            for x in levels[1:]:
                seen = seen.unionByName(x)
            front = space.stored(reached.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"level{depth}")
            if front.isEmpty():
                return stored(seen, "descendants")
            levels.append(front)
            if len(levels) > 8:  # few files to read for what is known
                levels = [space.stored(seen.unionByName(front), f"seen{depth}")]
    raise RuntimeError(f"the hierarchy is deeper than {max_rounds}")


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """All (ancestor, node, depth): depth of the shortest way, of one edge at least; a node in a cycle is its own descendant.

    Ways double in each round, so a chain of a million nodes takes twenty; the
    result holds every pair, so it is for graphs whose pairs are bearable.
    """
    with Workspace(edges.sparkSession) as space:
        ways = space.stored(_clean(edges).select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("depth")), "ways")
        before = None
        for turn in range(max_rounds):
            a, b = ways.alias("a"), ways.alias("b")
            longer = a.join(b, F.col("a.node") == F.col("b.ancestor")).select("a.ancestor", "b.node", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
            ways = space.stored(ways.unionByName(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")), f"ways{turn}")
            space.free("ways" if turn == 0 else f"ways{turn - 1}")
            now = tuple(ways.agg(F.count("*"), F.sum("depth")).first())
            if now == before or not now[0]:
                return stored(ways, "closure")
            before = now
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")


def in_cycles(ways: DataFrame) -> DataFrame:
    """Nodes of a closure that lead to themselves: node, length of the shortest cycle."""
    return ways.filter(F.col("ancestor") == F.col("node")).select("node", F.col("depth").alias("length"))


def rolled_up(edges: DataFrame, roots: DataFrame, measures: DataFrame, columns: list[str]) -> DataFrame:
    """Of each root: n, how many different nodes with a measure lie below it (itself included), and the sums of ``columns``.

    measures: node and the columns, a row a node; a node that two ways lead to counts once.
    """
    below = descendants(edges, roots).join(measures, "node")
    return below.groupBy("root").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in columns))


def scores_spread(edges: DataFrame, scores: DataFrame, least: float = 0.01, keep: float = 0.5, max_depth: int = 20) -> DataFrame:
    """How far a node's own score (node, score) moves those below it: node, score, spread.

    Each edge passes on ``keep`` of a score; what reaches a node by its shortest
    ways is averaged over its sources, with its own score. Ways whose share falls
    below ``least`` end, so cycles do too.
    """
    depth = 0
    while depth < max_depth and keep ** (depth + 1) >= least:
        depth += 1
    below = descendants(edges, scores.select("node")).filter(F.col("depth") <= depth)
    share = F.pow(F.lit(keep), F.col("depth"))
    moved = below.join(scores.withColumnRenamed("node", "root"), "root").groupBy("node").agg((F.sum(share * F.col("score")) / F.sum(share)).alias("spread"))
    return moved.join(scores, "node", "left").select("node", "score", F.round("spread", 6).alias("spread"))
