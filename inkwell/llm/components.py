"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node it reaches.

    ``edges`` has columns a and b of one ordered type; direction and repetition don't matter. Alternates between hooking
    all larger neighbours of a node, and all smaller ones, to the smallest neighbour, until nothing moves: the number of
    rounds grows with the logarithm of the longest path. Every round is written to the shared folder. A node with very
    many neighbours is only ever the key of a minimum, which combines before the shuffle, and of a join that Spark
    splits where it is skewed.
    """
    pairs = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        after = scratch.keep(hooked)
        same = after.exceptAll(pairs).isEmpty() and after.count() == pairs.count()
        scratch.drop(pairs)
        pairs = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b"), F.col("b")).distinct())
