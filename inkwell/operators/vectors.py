"""Vector tables: last-write-wins upserts, deletes, statistics and cosine top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vectors_upsert(store: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """The store (namespace, id, embedding, metadata) after new rows (with seq): the last write of an id wins.

    ``replace`` clears every namespace that new rows are written to.
    """
    columns = store.columns
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("namespace", "id").orderBy(F.desc("seq")))).where("_n = 1").select(*columns)
    key = ["namespace"] if replace else ["namespace", "id"]
    return store.join(last.select(*key).distinct(), key, "left_anti").select(*columns).unionByName(last)


def vectors_delete(store: DataFrame, namespace: str, ids: DataFrame) -> DataFrame:
    doomed = ids.select("id").distinct().withColumn("namespace", F.lit(namespace))
    return store.join(doomed, ["namespace", "id"], "left_anti").select(*store.columns)


def vectors_delete_namespace(store: DataFrame, namespace: str) -> DataFrame:
    return store.where(F.col("namespace") != namespace)


#: Scores that are held at once, and queries that share a block.
SCORES_AT_ONCE, QUERY_BLOCK = 1 << 22, 4096
_HIT = ["query_id", "id", "score"]


def _matrices(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, norms) by dimension, of the vectors that have a direction: not null or zero, and finite in every component."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    begins, flat = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        found = flat[begins[rows][:, None] + np.arange(size)]
        norms = np.sqrt(np.einsum("ij,ij->i", found, found))
        good = np.isfinite(norms) & (norms > 0)
        yield rows[good], found[good], norms[good]


class _Best:
    """The k most similar vectors so far of queries of one namespace and dimension, ties by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int):
        self.ids, self.vectors, self.norms, self.k = ids, vectors, norms, k
        self.query, self.score, self.found = np.zeros(0, dtype=np.int64), np.zeros(0), None
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        step = max(SCORES_AT_ONCE // len(self.ids), 1)
        for at in range(0, len(ids), step):
            self._add(ids[at : at + step], vectors[at : at + step], norms[at : at + step])

    def _add(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        # products of blocks tell which pairs can be among the best; those are scored one by one, alike wherever they stand
        rough = (vectors @ self.vectors.T) / norms[:, None] / self.norms
        least = self.least if len(ids) < self.k else np.maximum(self.least, np.partition(rough, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, query = np.nonzero(rough >= least - 1e-9)
        score = np.einsum("ij,ij->i", vectors[row], self.vectors[query]) / (norms[row] * self.norms[query])
        found = ids[row] if self.found is None else np.concatenate([self.found, ids[row]])
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        self.query, self.score, self.found = query[kept], score[kept], found[kept]
        last = np.searchsorted(self.query, np.arange(len(self.ids)), side="right") - 1
        full = np.bincount(self.query, minlength=len(self.ids)) == self.k
        self.least[full] = self.score[last[full]]

    def rows(self, types: list[pa.DataType]) -> pa.RecordBatch | None:
        if self.found is None or not len(self.query):
            return None
        return pa.RecordBatch.from_arrays([pa.array(c.tolist(), t) for c, t in zip((self.ids[self.query], self.found, self.score), [*types, pa.float64()])], names=_HIT)


def _sortable(ids: pa.Array) -> np.ndarray:
    out = ids.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def _asked(ids: np.ndarray, lists: pa.ListArray, k: int) -> dict[int, _Best]:
    """By dimension."""
    return {v.shape[1]: _Best(ids[rows], v, n, k) for rows, v, n in _matrices(lists) if len(rows)}


def _beside(queries: DataFrame, vectors: DataFrame, k: int, schema: str) -> DataFrame:
    """The best of each task's vectors, where they lie; queries, of which there are few, are sent to every task."""
    by_namespace: dict = {}
    table = queries.select("namespace", "query_id", "query_vector").toArrow()
    names = table.column("namespace").to_pylist()
    for name in dict.fromkeys(names):
        by_namespace[name] = table.filter(pa.array([n == name for n in names])) if name is not None else table.slice(0, 0)
    shared = queries.sparkSession.sparkContext.broadcast({n: (t.column("query_id").combine_chunks(), t.column("query_vector").combine_chunks()) for n, t in by_namespace.items()})

    def search(batches):
        best: dict = {}
        types: list[pa.DataType] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name in dict.fromkeys(names):
                if name not in shared.value:
                    continue
                ids, lists = shared.value[name]
                types = [ids.type, batch.schema.field(1).type]
                if name not in best:
                    best[name] = _asked(_sortable(ids), lists, k)
                part = batch.filter(pa.array([n == name for n in names]))
                own = _sortable(part.column(1))
                for rows, v, n in _matrices(part.column(2)):
                    if v.shape[1] in best[name] and len(rows):
                        best[name][v.shape[1]].add(own[rows], v, n)
        for found in best.values():
            yield from (r for b in found.values() if (r := b.rows(types)) is not None)

    return vectors.select("namespace", "id", "embedding").mapInArrow(search, schema)


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, n_queries: int, schema: str) -> DataFrame:
    """The best of each pair of a block of queries and a block of vectors of a namespace; a task holds one block of queries.

    A vector is copied for each block of queries, a query for each block of vectors, of which there are so many that a namespace
    with most rows is spread over all tasks.
    """
    q_blocks = max(-(-n_queries // QUERY_BLOCK), 1)
    v_blocks = -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // q_blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = queries.select("namespace", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q"), every(v_blocks).alias("v"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(dict(vectors.dtypes)["id"]).alias("id"), F.col("query_vector").cast("array<double>").alias("vector"))
    right = vectors.select("namespace", every(q_blocks).alias("q"), F.pmod(F.xxhash64("id"), F.lit(v_blocks)).alias("v"), F.lit(1).alias("side"), F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "id", F.col("embedding").cast("array<double>").alias("vector"))

    def search(batches):
        key, asked, best, types = None, [], None, []
        for batch in batches:
            types = [batch.schema.field(4).type, batch.schema.field(5).type]
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            cuts = [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip([0, *cuts], cuts):
                if end == begin:
                    continue
                part = batch.slice(begin, end - begin)
                if keys[begin][:3] != key:
                    yield from (r for b in (best or {}).values() if (r := b.rows(types)) is not None)
                    key, asked, best = keys[begin][:3], [], None
                if keys[begin][3] == 0:
                    asked.append(part)
                    continue
                if best is None:
                    table = pa.Table.from_batches(asked) if asked else part.slice(0, 0)
                    best = _asked(_sortable(pa.table({"x": table.column(4)}).column(0).combine_chunks()), table.column(6), k) if asked else {}
                own = _sortable(part.column(5))
                for rows, v, n in _matrices(part.column(6)):
                    if v.shape[1] in best and len(rows):
                        best[v.shape[1]].add(own[rows], v, n)
        yield from (r for b in (best or {}).values() if (r := b.rows(types)) is not None)

    both = left.where("namespace is not null").unionByName(right.where("namespace is not null"))
    return both.repartition("namespace", "q", "v").sortWithinPartitions("namespace", "q", "v", "side").mapInArrow(search, schema)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float | None = None, filters: dict[str, str] | None = None, max_broadcast_queries: int = 10_000) -> DataFrame:
    """query_id, rank, id, score of the k most similar vectors of each query's namespace, ties by id.

    queries: query_id, namespace, query_vector; vectors: namespace, id, embedding, metadata. The threshold is applied after
    the top k, so fewer may be left. Vectors that are null or zero, have another dimension or a component that is null or not
    finite take no part. Blocks are multiplied and every task keeps k rows for a query. Up to ``max_broadcast_queries`` queries
    are sent to the vectors, which then stay where they lie; more meet them by a shuffle on pairs of blocks.
    """
    for name, value in (filters or {}).items():
        vectors = vectors.where(F.col("metadata")[name] == value)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, score double"
    small = queries.select("query_id").limit(max_broadcast_queries + 1).count() <= max_broadcast_queries
    found = _beside(queries, vectors, k, schema) if small else _by_blocks(queries, vectors, k, queries.count(), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    return best if threshold is None else best.where(F.col("score") >= threshold)


def retrieve_for_chapters(chapters: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float | None = None) -> DataFrame:
    """chapter_id, chunk_ids, sources (distinct, sorted), grounded; a chapter without hits has empty lists.

    chapters: chapter_id, unit, title; queries: query_id = chapter_id with namespace and vector.
    """
    hits = vector_top_k(queries, vectors, k, threshold).join(vectors.select("id", F.col("metadata")["source"].alias("source")), "id")
    found = hits.groupBy(F.col("query_id").alias("chapter_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("chunk_ids"), F.array_sort(F.collect_set("source")).alias("sources"))
    return chapters.join(found, "chapter_id", "left").select("chapter_id", F.concat_ws(": ", "unit", "title").alias("query"), F.coalesce(F.size("chunk_ids"), F.lit(0)).alias("n_hits"), F.coalesce(F.array_join("chunk_ids", ","), F.lit("")).alias("chunk_ids"), F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"), F.col("chunk_ids").isNotNull().alias("grounded"))


def embedding_statistics(vectors: DataFrame, by: list[str]) -> DataFrame:
    """vectors, dimension (null unless uniform), average, smallest and largest dimension."""
    d = F.size("embedding")
    low, high = F.min(d), F.max(d)
    return vectors.groupBy(*by).agg(F.count("*").alias("vectors"), F.when(low == high, low).alias("dimension"), F.avg(d).alias("average_dimension"), low.alias("min_dimension"), high.alias("max_dimension"))
