"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after a rotation learned on a bounded sample (principal axes, then alternating between
codes and the rotation that fits them best), with several rotations side by side. A code is cut into substrings of eight
bits; each block of rows indexes every substring. Two codes that differ in at most m(t+1)-1 bits agree up to t bits in
one of m substrings, so probing every substring's values within t bits retrieves all codes within that radius. A query
probes ring after ring until the radius learned on the sample is complete and enough rows are found, then ranks the
rows within the radius by their exact distance.

Rows are dealt to blocks of bounded size by a hash; queries go to every block in bounded blocks of their own, and each
pair of blocks is one task that returns at most k rows a query. So memory is bounded whatever the numbers are, a hot
bucket is spread over all blocks, and no pair of rows leaves a task before it is ranked.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those of
another dimension than the most frequent one, nor rows without an id; rows that repeat an id count once, at their best
distance, and never for a query of that id; ties go to the smaller id. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import bounded_sample, is_usable, matrix, of_common_size

TRAIN_ROWS = 4096
BITS = 256
ROUNDS = 15
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
RADIUS_QUANTILE = 0.99
_BITS_IN = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_RINGS = [np.flatnonzero(_BITS_IN == t).astype(np.uint8) for t in range(9)]


class Codes:
    """A learned map from vectors to codes, and the radius that holds most true neighbours in the sample."""

    def __init__(self, sample: np.ndarray, k: int, bits: int = BITS):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        d = sample.shape[1]
        _, axes = np.linalg.eigh(centred.T @ centred)
        rng = np.random.default_rng(17)
        turns = []
        for _ in range(math.ceil(bits / d)):
            turn = axes @ np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.sign(centred @ turn).T @ centred)
                turn = (u @ v).T
            turns.append(turn)
        self.turn = np.hstack(turns)[:, :bits]
        codes = self.encode(sample)
        some = np.arange(min(len(sample), 256))
        distance = ((sample[some, None, :] - sample[None, :, :]) ** 2).sum(axis=2) if len(sample) <= 512 else (sample[some] ** 2).sum(1)[:, None] + (sample**2).sum(1) - 2 * sample[some] @ sample.T
        distance[some, some] = np.inf
        near = np.argsort(distance, axis=1)[:, : max(min(k, len(sample) - 1), 0)]
        apart = _BITS_IN[codes[some][:, None, :] ^ codes[near]].sum(axis=2, dtype=np.int32)
        self.radius = int(np.quantile(apart, RADIUS_QUANTILE)) if apart.size else bits

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)


class SubstringIndex:
    """Rows of a block listed by the value of each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, (self.n, self.m) = codes, codes.shape
        self.rows = np.argsort(codes, axis=0, kind="stable").T.ravel()
        counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(self.m)])
        self.ends = np.cumsum(counts, axis=1) + np.arange(self.m)[:, None] * self.n
        self.starts = self.ends - counts

    def ring(self, code: np.ndarray, t: int) -> np.ndarray:
        """Rows with a substring that differs in exactly t bits, with repeats."""
        values = code[:, None] ^ _RINGS[t][None, :]
        which = np.arange(self.m)[:, None]
        start, size = self.starts[which, values].ravel(), (self.ends - self.starts)[which, values].ravel()
        skip = np.cumsum(size) - size
        return self.rows[np.repeat(start - skip, size) + np.arange(int(size.sum()))]

    def within(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """All rows within the radius; if they are fewer than ``least``, all of a larger radius or all there are."""
        seen = np.zeros(self.n, dtype=bool)
        for t in range(9):
            seen[self.ring(code, t)] = True
            complete = self.m * (t + 1) - 1
            if complete < radius and t < 8:
                continue
            found = np.flatnonzero(seen)
            apart = _BITS_IN[self.codes[found] ^ code].sum(axis=1, dtype=np.int32)
            near = found[apart <= max(radius, complete if t else radius)] if (apart <= radius).sum() < least else found[apart <= radius]
            if len(near) >= least or t == 8:
                return near
        return np.arange(self.n)


def nearest(rows: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found rows of each query row."""
    id_type = dict(rows.dtypes)[id_column]
    used = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(is_usable(F.col("v")) & F.col("id").isNotNull())
    used = of_common_size(used, "v")
    total = used.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    n_blocks, q_blocks = math.ceil(total.n / block_rows), math.ceil(total.q / block_queries)
    result = f"query_id {id_type}, vec_id {id_type}, score double"
    if not total.q:
        return rows.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    codes = rows.sparkSession.sparkContext.broadcast(Codes(bounded_sample(used, TRAIN_ROWS, "id", "v"), k))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
        queries, data = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_q, out_v, out_s = [], [], []
        if len(data):
            index, stored, points = SubstringIndex(codes.value.encode(x[data])), ids[data], x[data]
            for q, code in zip(queries, codes.value.encode(x[queries]) if len(queries) else []):
                near = index.within(code, codes.value.radius, min(k + 1, len(data)))
                near = near[stored[near] != ids[q]]
                if len(near) < k:
                    near = np.flatnonzero(stored != ids[q])
                distance = np.sqrt(((points[near] - x[q]) ** 2).sum(axis=1))
                best = np.lexsort((stored[near], distance))
                best = best[np.sort(np.unique(stored[near][best], return_index=True)[1])[:k]]
                out_q.append(np.full(len(best), ids[q]))
                out_v.append(stored[near][best])
                out_s.append(distance[best])
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(flat(out_q, ids.dtype)), "vec_id": pa.array(flat(out_v, ids.dtype)), "score": pa.array(flat(out_s, float))})

    asked = used.where("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("asks", F.lit(True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = used.select("id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")).withColumn("part", every(q_blocks))
    ask = asked.select("id", "v", "asks", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("part")).withColumn("block", every(n_blocks))
    found = data.unionByName(ask).groupBy("block", "part").applyInArrow(search, result)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
