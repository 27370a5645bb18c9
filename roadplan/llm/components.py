"""Connected components of a graph too large for one machine: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadplan.operators.spatial import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of ``edges`` (a, b), the root being the least node of the component.

    Loops and repeated edges do no harm; an empty table gives an empty one. Each round writes its edges to the
    checkpoint folder, so a lost executor costs a round at most; rounds go on until no edge changes.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpointed(ends)
    state = _state(now)
    while state[0]:
        new = checkpointed(_small_star(_large_star(now)))
        new_state = _state(new)
        now, done, state = new, new_state == state, new_state
        if done:
            break
    loops = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "node")
    return loops.join(now.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("root"))
