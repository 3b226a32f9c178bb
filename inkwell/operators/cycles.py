"""Directed cycles of many graphs at once: the strongly connected components with more than one node, or with a self-loop.

Edges are (doc_id, source, target). Each round removes what can't be on a cycle and shortens what may be:

* nodes without incoming or without outgoing edges go, with their edges;
* of the nodes with one edge in and one out, those with a higher random number than such neighbours are taken out, and their
  two edges become one. A long chain or ring so loses a constant share of its nodes in each round. Whether such a node is on
  a cycle is told by its two neighbours: it is, if they are of one component.

When neither is possible, smallest names are passed along the edges until they settle, and each name's own node is followed
backwards among the nodes with that name: what is reached is a component. Rounds go on until few edges are left, which are then
searched graph by graph; each round is a written table, and nodes taken out are put back from the last round to the first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables

NODE = ["doc_id", "node"]
#: Of all graphs together; so many are searched without further rounds.
FEW_EDGES = 50_000


def _ends(edges: DataFrame, side: str) -> DataFrame:
    return edges.select("doc_id", F.col(side).alias("node"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    for side in ("source", "target"):
        edges = edges.join(nodes.select("doc_id", F.col("node").alias(side)), ["doc_id", side], "left_anti")
    return edges.select("doc_id", "source", "target")


def _shortened(edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(edges between nodes that may be on a cycle, nodes to take out with their neighbours)."""
    outgoing = edges.groupBy("doc_id", F.col("source").alias("node")).agg(F.count("*").alias("n_out"), F.min("target").alias("after"))
    incoming = edges.groupBy("doc_id", F.col("target").alias("node")).agg(F.count("*").alias("n_in"), F.min("source").alias("before"))
    live = outgoing.join(incoming, NODE).withColumn("draw", F.when((F.col("n_in") == 1) & (F.col("n_out") == 1), F.xxhash64("doc_id", "node", F.lit(number))))
    beside = lambda side: live.select("doc_id", F.col("node").alias(side), F.col("draw").alias(f"{side}_draw"))
    wins = lambda side: F.col(f"{side}_draw").isNull() | (F.col("draw") > F.col(f"{side}_draw"))
    out = live.where("draw is not null").join(beside("before"), ["doc_id", "before"]).join(beside("after"), ["doc_id", "after"]).where(wins("before") & wins("after"))
    both = edges
    for side in ("source", "target"):
        both = both.join(live.select("doc_id", F.col("node").alias(side)), ["doc_id", side], "left_semi")
    return both.select("doc_id", "source", "target"), out.select("doc_id", "node", "before", "after")


def _settled(edges: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, node, component): one component for each smallest name that settles."""
    nodes = _ends(edges, "source").union(_ends(edges, "target")).distinct()
    names, _ = tables.write(nodes.withColumn("name", F.col("node")))
    while True:
        passed = edges.join(names.select("doc_id", F.col("node").alias("source"), "name"), ["doc_id", "source"]).groupBy("doc_id", F.col("target").alias("node")).agg(F.min("name").alias("passed"))
        # what reaches the node of a name reaches the nodes with that name, so names travel twice as far each time
        behind = names.select("doc_id", F.col("node").alias("name"), F.col("name").alias("behind"))
        least = F.least("name", "passed", "behind")
        new, _ = tables.write(names.join(passed, NODE, "left").join(behind, ["doc_id", "name"]).select(*NODE, least.alias("name"), (least < F.col("name")).alias("moved")))
        names = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    of = lambda side: names.select("doc_id", F.col("node").alias(side), F.col("name").alias(f"{side}_name"))
    inner, _ = tables.write(edges.join(of("source"), ["doc_id", "source"]).join(of("target"), ["doc_id", "target"]).where("source_name = target_name").select("doc_id", "source", "target", F.col("source_name").alias("name")))
    reached = fresh = tables.write(names.where("node = name"))[0]
    while True:
        found = inner.join(fresh.select("doc_id", F.col("node").alias("target"), "name"), ["doc_id", "target", "name"]).select("doc_id", F.col("source").alias("node"), "name").distinct()
        fresh, _ = tables.write(found.join(reached, [*NODE, "name"], "left_anti"))
        if fresh.isEmpty():
            return reached.select(*NODE, F.col("name").alias("component"))
        reached, _ = tables.write(reached.union(fresh))


def _depth_first(after: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, by one depth-first search: a node is its component's first one if none behind it leads further back."""
    low: dict[str, float] = {}
    open_: list[str] = []
    out: list[list[str]] = []
    for start in after:
        todo = [] if start in low else [(start, len(low), len(open_), iter(after[start]))]
        if todo:
            low[start] = len(low)
            open_.append(start)
        while todo:
            node, number, at, rest = todo[-1]
            for t in rest:
                if t not in low:
                    todo.append((t, len(low), len(open_), iter(after.get(t, ()))))
                    low[t] = len(low)
                    open_.append(t)
                    break
                low[node] = min(low[node], low[t])
            else:
                todo.pop()
                if low[node] == number:
                    out.append(open_[at:])
                    del open_[at:]
                    low.update(dict.fromkeys(out[-1], float("inf")))
                elif todo:
                    parent = todo[-1][0]
                    low[parent] = min(low[parent], low[node])
    return out


def _searched(edges: DataFrame) -> DataFrame:
    """Components of more than one node of few edges, a graph at a time."""

    def search(key, table):
        after: dict[str, list[str]] = {}
        for s, t in zip(table.column("source").to_pylist(), table.column("target").to_pylist()):
            after.setdefault(s, []).append(t)
        rows = [(n, min(c)) for c in _depth_first(after) if len(c) > 1 for n in c]
        return pa.table([pa.array([key[0].as_py()] * len(rows), table.schema.field("doc_id").type), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "node", "component"])

    return edges.groupBy("doc_id").applyInArrow(search, f"doc_id {dict(edges.dtypes)['doc_id']}, node string, component string")


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, few_edges: int = FEW_EDGES) -> DataFrame:
    """(doc_id, node, component) of the nodes that lie on a cycle; component is its smallest node.

    With ``nodes`` (doc_id, id), edges to or from others are left out. Null ends count as unknown.
    """
    spark = edges.sparkSession
    tables = Tables(spark, "cycles")
    edges = edges.select("doc_id", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).where("source is not null and target is not null")
    if nodes is not None:
        for side in ("source", "target"):
            edges = edges.join(nodes.select("doc_id", F.col("id").cast("string").alias(side)).distinct(), ["doc_id", side], "left_semi")
    every, _ = tables.write(edges.select("doc_id", "source", "target").distinct())
    left, _ = tables.write(every.where("source != target"))
    loops = [_ends(every.where("source = target"), "source")]
    n, taken, found = left.count(), [], None
    while n > few_edges:
        both, out = _shortened(left, len(taken))
        out, _ = tables.write(out)
        joined = out.select("doc_id", F.col("before").alias("source"), F.col("after").alias("target"))
        after, _ = tables.write(_without(both, out).union(joined.where("source != target")).distinct())
        taken.append(out)
        loops.append(_ends(joined.where("source = target"), "source").distinct())
        rest = after.count()
        if rest == n:
            some = _settled(after, tables)
            found = some if found is None else found.union(some)
            after, _ = tables.write(_without(after, some))
            rest = after.count()
        left, n = after, rest
    if n:
        found = _searched(left) if found is None else found.union(_searched(left))
    alone = spark.createDataFrame([], f"doc_id {dict(every.dtypes)['doc_id']}, node string, component string")
    if found is not None:
        # a name that only its own node has is no cycle
        sizes = found.groupBy("doc_id", "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        alone = found.join(sizes, ["doc_id", "component"], "left_semi").select(*NODE, "component")
    known, _ = tables.write(alone)
    for k in range(len(loops) - 1, -1, -1):
        # loops[k + 1] were made with taken[k]: a node with one is a component, if it isn't part of a larger one
        single = loops[k].join(known, NODE, "left_anti").select(*NODE, F.col("node").alias("component"))
        known = known.union(single)
        if k:
            out = taken[k - 1]
            of = lambda side: known.select("doc_id", F.col("node").alias(side), F.col("component").alias(f"{side}_is"))  # noqa: E731, B023
            back = out.join(of("before"), ["doc_id", "before"]).join(of("after"), ["doc_id", "after"]).where("before_is = after_is").select(*NODE, F.col("before_is").alias("component"))
            known, _ = tables.write(known.union(back))
    least = known.groupBy("doc_id", "component").agg(F.min("node").alias("least"))
    return known.join(least, ["doc_id", "component"]).select("doc_id", "node", F.col("least").alias("component"))
