"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors form a class, of which one row stands for all.
2. Classes go to the shards of their nearest centroids, several each, so that shards overlap; centroids are learned on a
   bounded sample. A shard that is too large is dealt to blocks, and each pair of blocks is a task of its own.
3. Every task builds a flat graph of its rows: candidates are pruned robustly, so that a neighbour is kept only if no
   kept one is much closer to it than the row is. The adjacency lists of all tasks are united.
4. On the united lists, every task searches for each of its rows from the medoid and the row's own node: greedily to the
   row's surroundings, then on from every row within the range until the range has no unexpanded row. A row whose range is very full is compared
   with the whole block instead. What is found is verified in double precision.
5. A pair counts in the first shard that both rows share. Tasks return counts and a spanning forest, never the pairs;
   components are joined over all tasks.
6. Recall is audited: bounded samples of all rows and of rows that random cells bring together are compared with all rows. If too
   few of their links were found, everything is done again with more overlap; if less than LEAST_RECALL of them are found
   in the end, that is an error. Where the samples have no link at all, recall is not measured (null).

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do those of
another dimension than the most frequent one and rows without an id; rows that repeat an id count one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Scratch
from .vectors import bounded_sample, is_usable, matrix, of_common_size

MIN_COSINE = 0.95
TRAIN_ROWS = 8192
SHARD_ROWS = 1024
MAX_SHARDS = 4096
OVERLAP = 3
DEGREE = 20
CANDIDATES = 48
PRUNE = 1.2
BEAM = 24
FULL_RANGE = 24
AUDIT_ROWS = 256
AUDIT_RECALL = 0.98
LEAST_RECALL = 0.9
ATTEMPTS = 3


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means with a fixed start."""
    n = min(n, len(sample))
    centre = sample[np.random.default_rng(5).permutation(len(sample))[:n]]
    for _ in range(8):
        own = np.argmax(sample @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        centre = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centre)
    return centre


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, prune: float = PRUNE) -> list[np.ndarray]:
    """Adjacency lists of a flat graph of unit vectors."""
    n = len(x)
    out: list[np.ndarray] = []
    m = min(candidates, n - 1)
    for begin in range(0, n, 256):
        rows = np.arange(begin, min(begin + 256, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -2
        pick = np.argpartition(-near, m - 1, axis=1)[:, :m] if m else np.zeros((len(rows), 0), dtype=int)
        order = np.argsort(-np.take_along_axis(near, pick, axis=1), axis=1, kind="stable")
        pick = np.take_along_axis(pick, order, axis=1)
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, pick, axis=1), 0))
        among = np.sqrt(np.maximum(2 - 2 * np.einsum("bid,bjd->bij", x[pick], x[pick]), 0))
        alive, kept = np.ones(pick.shape, dtype=bool), np.zeros(pick.shape, dtype=bool)
        lines = np.arange(len(rows))
        for _ in range(min(degree, m)):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = np.argmax(alive, axis=1)
            kept[lines[some], first[some]] = True
            alive &= prune * among[lines, first] > far
            alive[lines, first] = False
        out += [p[k] for p, k in zip(pick, kept)]
    return out


def range_search(x: np.ndarray, lists: list[np.ndarray], min_cosine: float, beam: int = BEAM, full: int = FULL_RANGE) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row the rows found in its range, and which rows have more than ``full`` (whose lists are not complete).

    All rows search at once: in each round every one expands its best unexpanded candidate, first within the beam, then
    as long as one lies in the range.
    """
    n, width = len(x), max(max((len(a) for a in lists), default=0), 1)
    table = np.full((n, width), -1)
    for i, a in enumerate(lists):
        table[i, : len(a)] = a
    medoid = int(np.argmax(x @ unit(x.mean(axis=0, keepdims=True) + 1e-12)[0]))
    slots = beam + full + 1
    ids, near, expanded = np.full((n, slots), -1), np.full((n, slots), -2.0), np.ones((n, slots), dtype=bool)
    ids[:, 0], near[:, 0], expanded[:, 0] = medoid, x @ x[medoid], False
    seen = np.zeros((n, n), dtype=bool)
    seen[:, medoid] = True
    active = np.arange(n)
    # The row itself is a node too, from which its surroundings are one step away.
    other = active[active != medoid]
    ids[other, 1], near[other, 1], expanded[other, 1], seen[other, other] = other, 1.0, False, True
    while len(active):
        best = np.argmax(np.where(expanded[active], -3.0, near[active]), axis=1)
        open_ = ~expanded[active, best]
        active, best = active[open_], best[open_]
        if not len(active):
            break
        expanded[active, best] = True
        to = table[ids[active, best]]
        fresh = (to >= 0) & ~seen[active[:, None], to]
        seen[np.repeat(active, fresh.sum(axis=1)), to[fresh]] = True
        sims = np.where(fresh, np.einsum("bd,bwd->bw", x[active], x[to]), -2.0)
        all_ids = np.concatenate((ids[active], to), axis=1)
        all_near = np.concatenate((near[active], sims), axis=1)
        all_done = np.concatenate((expanded[active], ~fresh), axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :slots]
        ids[active], near[active], done = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_near, all_done))
        # Beyond the beam only rows in the range are still expanded.
        done[:, beam:] |= near[active][:, beam:] < min_cosine
        expanded[active] = done
        active = active[(near[active] >= min_cosine).sum(axis=1) <= full]
    inside = near >= min_cosine
    return [i[k] for i, k in zip(ids, inside)], inside.sum(axis=1) > full


def _tasks(shards: DataFrame, sizes: DataFrame, shard_rows: int) -> DataFrame:
    """Rows of every task (shard, i, j): a shard's pairs of blocks."""
    split = F.ceil(F.col("n") / shard_rows).cast("int")
    return (
        shards.join(F.broadcast(sizes), "shard").withColumn("blocks", split)
        .withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int")})
        .drop("n", "blocks", "other")
    )


def embedding_links(rows: DataFrame, min_cosine: float = MIN_COSINE, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_recall (of all, by the audited samples; null if not measured)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "graph")
    id_type = dict(rows.dtypes)[id_column]
    named = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).withColumn("usable", is_usable(F.col("v")) & F.col("id").isNotNull())
    keyed = scratch.keep(named.withColumn("key", F.when(F.col("usable"), F.concat(F.xxhash64("v"), F.lit(":"), F.xxhash64(F.lit(1), F.col("v"))))))
    usable = of_common_size(keyed.where("usable"), "v")
    classes = scratch.keep(usable.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v")))
    n = classes.count()
    if n:
        sample = unit(bounded_sample(classes, TRAIN_ROWS, "id", "v"))
        for attempt in range(ATTEMPTS):
            links, edges = _links(classes, sample, n, min_cosine, shard_rows, overlap * 2**attempt, scratch, id_type)
            recall = _audit(classes, links, n, sample_rows=AUDIT_ROWS, min_cosine=min_cosine)
            if recall is None or recall >= AUDIT_RECALL:
                break
        if recall is not None and recall < LEAST_RECALL:
            raise RuntimeError(f"only {recall:.3f} of the audited links were found")
    else:
        links, edges, recall = spark.createDataFrame([], "key string, others long"), spark.createDataFrame([], f"a {id_type}, b {id_type}"), None
    reached = connected_components(edges, scratch)
    of_class = (
        classes.select("key", "id", "weight").join(links, "key", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
        .select("key", F.coalesce("component", "id").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    return keyed.select("id", "key").join(of_class, "key", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"),
    )


def _links(classes: DataFrame, sample: np.ndarray, n: int, min_cosine: float, shard_rows: int, overlap: int, scratch: Scratch, id_type: str) -> tuple[DataFrame, DataFrame]:
    n_shards = max(1, min(MAX_SHARDS, len(sample), math.ceil(n * overlap / shard_rows)))
    centre = scratch.spark.sparkContext.broadcast(centroids(sample, n_shards))
    overlap = min(overlap, len(centre.value))

    def assign(batches):
        for batch in batches:
            near = unit(matrix(batch.column(3))) @ centre.value.T
            own = np.sort(np.argpartition(-near, overlap - 1, axis=1)[:, :overlap], axis=1) if len(near) else np.zeros((0, overlap), int)
            yield batch.append_column("shards", pa.array(own.astype(np.int32).tolist(), pa.list_(pa.int32())))

    assigned = classes.select("key", "id", "weight", "v").mapInArrow(assign, f"key string, id {id_type}, weight long, v {dict(classes.dtypes)['v']}, shards array<int>")
    shards = scratch.keep(assigned.withColumn("shard", F.explode("shards")))
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n"))  # at most MAX_SHARDS rows
    tasks = _tasks(shards, sizes, shard_rows)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        lists = robust_prune(unit(matrix(table.column("v"))))
        key = np.array(table.column("key").to_pylist(), dtype=object)
        return pa.table({"key": pa.array(key, pa.string()), "next": pa.array([key[a].tolist() for a in lists], pa.list_(pa.string()))})

    united = tasks.groupBy("shard", "i", "j").applyInArrow(build, "key string, next array<string>").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    searched = _tasks(shards.join(united, "key"), sizes, shard_rows)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, ids, weight = table.column("key").to_pylist(), table.column("id").to_pylist(), table.column("weight").to_numpy()
        x = unit(matrix(table.column("v")))
        place = {k: i for i, k in enumerate(keys)}
        lists = [np.array([place[k] for k in near if k in place], dtype=int) for near in table.column("next").to_pylist()]
        found, crowded = range_search(x, lists, min_cosine - 1e-6)
        side, mine = table.column("side").to_numpy(), np.array(table.column("shards").to_pylist())
        whole = (key[1].as_py() == key[2].as_py())
        root, totals, edges = list(range(len(x))), np.zeros(len(x), dtype=np.int64), []

        def top(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        partners: list[set[int]] = [set() for _ in keys]
        for i, near in enumerate(found):
            near = np.flatnonzero(x @ x[i] >= min_cosine) if crowded[i] else near[x[near] @ x[i] >= min_cosine]
            for j in near.tolist():
                if j != i:
                    partners[i].add(j)
                    partners[j].add(i)
        for i, others in enumerate(partners):
            if not others:
                continue
            j = np.fromiter(others, dtype=int, count=len(others))
            if not whole:
                j = j[side[j] != side[i]]
            # the first shard that both share
            common = (mine[i][None, :, None] == mine[j][:, None, :]).any(axis=2)
            j = j[np.where(common, mine[i][None, :], np.iinfo(np.int32).max).min(axis=1) == key[0].as_py()] if len(j) else j
            totals[i] = weight[j].sum()
            for k in j.tolist():
                a, b = top(i), top(k)
                if a != b:
                    root[a] = b
                    edges.append((ids[i], ids[k]))
        kind = table.schema.field("id").type
        counted = np.flatnonzero(totals)
        return pa.table({
            "key": pa.array([keys[i] for i in counted] + [None] * len(edges), pa.string()), "others": pa.array(totals[counted].tolist() + [0] * len(edges), pa.int64()),
            "a": pa.array([None] * len(counted) + [a for a, _ in edges], kind), "b": pa.array([None] * len(counted) + [b for _, b in edges], kind),
        })

    found = scratch.keep(searched.groupBy("shard", "i", "j").applyInArrow(search, f"key string, others long, a {id_type}, b {id_type}"))
    links = found.where("key is not null").groupBy("key").agg(F.sum("others").alias("others"))
    return links, found.where("a is not null").select("a", "b")


def _crowded(classes: DataFrame, n: int) -> DataFrame:
    """Keys of rows that lie in one cell of random half-spaces with another, of which many have links, whether found or not.

    The planes owe nothing to the shards or the graph. There are a few more than the logarithm of the rows, so that rows that are far
    from all others seldom share a cell.
    """
    planes = min(62, n.bit_length() + 4)

    def cells(batches):
        for batch in batches:
            x = unit(matrix(batch.column(1)))
            sides = np.random.default_rng(19).normal(size=(x.shape[1], planes)) if len(x) else np.zeros((0, planes))
            cell = ((x @ sides > 0) << np.arange(planes, dtype=np.int64)).sum(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int64())], names=["key", "cell"])

    placed = classes.select("key", "v").mapInArrow(cells, "key string, cell long")
    return placed.join(placed.groupBy("cell").agg(F.count("*").alias("rows")).where("rows > 1"), "cell").select("key")


def _audit(classes: DataFrame, links: DataFrame, n: int, sample_rows: int, min_cosine: float) -> float | None:
    """Share of the links of bounded samples of all rows and of rows in crowded cells that were found; None if they have none.

    Neither sample looks at what was found, so that a row whose links were all lost is as likely to be drawn as another.
    """
    order = (F.xxhash64("key"), "key")
    near = classes.select("key", "v").join(_crowded(classes, n).orderBy(*order).limit(sample_rows // 2), "key")
    chosen = classes.select("key", "v").orderBy(*order).limit(sample_rows // 2).union(near).dropDuplicates(["key"]).orderBy("key").collect()
    probe = unit(np.array([r.v for r in chosen], dtype=np.float64))
    keys = [r.key for r in chosen]
    shared = classes.sparkSession.sparkContext.broadcast((keys, probe))

    def compare(batches):
        keys, probe = shared.value
        total = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                near = unit(matrix(batch.column(2))) @ probe.T >= min_cosine
                near &= np.array(batch.column(0).to_pylist(), dtype=object)[:, None] != np.array(keys, dtype=object)[None, :]
                total += batch.column(1).to_numpy() @ near
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(total)], names=["key", "n"])

    truth = classes.select("key", "weight", "v").mapInArrow(compare, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    sums = truth.join(links, "key", "left").agg(F.sum("n").alias("n"), F.sum("others").alias("found")).first()
    return (sums.found or 0) / sums.n if sums.n else None
