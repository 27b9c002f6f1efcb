"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node of ``edges`` (a, b).

    Each round points every node at its least neighbour's least neighbour, if lower than
    itself, and goes on with the edges between the nodes pointed at. The edges shrink by at
    least half the nodes in each round; at the end the rounds' pointers are put together from
    the last to the first.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not rounds or left.limit(1).count():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        step = cut(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")))
        further = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
        step = cut(step.join(further, "label").select("node", F.col("to").alias("label")))
        rounds.append(step)
        ends = [step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to")) for c in ("a", "b")]
        moved = left.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        left = cut(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("final"))
        found = cut(rounds.pop().join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label")))
    return found
