"""Trees given by parents: depths and ancestors by pointer jumping, so that the number of rounds is the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables


def flatten_tree(nodes: DataFrame, ancestors: bool = True) -> DataFrame:
    """nodes (doc_id, node_id, parent_id, type) with depth, parent_type and, if asked for, ancestors (their types, root first).

    Every node points to an ancestor, at first its parent. In a round it takes over that ancestor's pointer and adds up the steps
    (and the types between), so pointers reach twice as far each time. A node whose way ends elsewhere than at a root (an unknown
    parent, or a ring of parents) is in no tree and gets no row. Repeated ids give a row for each way to a root.
    """
    tables = Tables(nodes.sparkSession, "trees")
    plain = nodes.select("doc_id", "node_id", "parent_id", "type")
    parents = plain.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    roots = plain.where("parent_id is null").withColumn("parent_type", F.lit(None).cast("string"))
    below = plain.where("parent_id is not null").join(parents, ["doc_id", "parent_id"]).select(*roots.columns)
    path = [F.when(F.col("parent_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent_type")).alias("ancestors")] if ancestors else []
    rows, _ = tables.write(roots.union(below).select("doc_id", "node_id", "type", "parent_type", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("depth"), *path))
    reach, most = 1, None
    while True:
        # the longest way to a root is shorter than the number of nodes of its tree
        most = (rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0) if most is None else most
        if rows.where("up is not null").isEmpty() or reach > most:
            break
        far = rows.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), *([F.col("ancestors").alias("_path")] if ancestors else []))
        longer = [F.concat("_path", "ancestors").alias("ancestors")] if ancestors else []
        jumped = rows.where("up is not null").join(far, ["doc_id", "up"]).select("doc_id", "node_id", "type", "parent_type", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), *longer)
        rows, _ = tables.write(rows.where("up is null").union(jumped))
        reach *= 2
    return rows.where("up is null").select("doc_id", "node_id", "type", "depth", "parent_type", *(["ancestors"] if ancestors else []))


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """doc_id, elements, max_depth, types, counts (map by type)."""
    flat = flatten_tree(nodes, ancestors=False)
    counts = flat.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("elements"), F.max("d").alias("max_depth"), F.count("*").alias("types"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))
