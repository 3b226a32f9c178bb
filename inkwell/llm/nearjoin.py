"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every text becomes the set of its word n-grams (hashes of 64 bits); documents with equal sets form a class, of which
   one member stands for all, so that copies are never compared. A signature gives one key per band; the numbers of
   bands and rows are chosen for a target recall at the threshold.
2. Classes shuffle on their band keys. Keys of few classes give candidate pairs, each of which is verified once. Keys of
   many classes are split into blocks: each pair of blocks is one task, which compares its members' sets itself and
   returns counts and a spanning forest, never the pairs. A pair that shares several keys is counted at one place.
3. Links give each document its number of links, and connected components of the links give its component.

Only the texts of classes that share a key are read again, by a join on the document.

Defined cases: null and empty texts, and texts without a word, have no n-gram and link with nothing; a text of fewer
words than n is one n-gram; identical sets link (similarity 1). A row whose doc_id is null has no identity: it links
with nothing and has null ids. A row is known by its doc_id and its text, so rows that repeat a doc_id count one by one, and
different texts of one doc_id don't stand for each other; rows that repeat both are one document. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import connected_components
from .storage import Scratch

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 256
SMALL_KEY = 24
BLOCK = 256
ROWS_AT_ONCE = 500


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, place (hash of the text), kind (digest of the n-gram set, null if empty), bands (null if empty)."""

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                grams, sizes = hashing.shingle_sets([t.encode() for t in part.column(2).to_pylist()], n)
                keys = iter(hashing.band_keys(hashing.minhash(grams, sizes, bands * rows), bands, rows).view(np.int64).tolist())
                upto = np.cumsum(sizes)
                kinds = [hashlib.blake2b(grams[e - s : e].tobytes(), digest_size=16).digest() if s else None for s, e in zip(sizes.tolist(), upto.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(kinds, pa.binary()), pa.array([next(keys) if s else None for s in sizes.tolist()], pa.list_(pa.int64()))],
                    names=["doc_id", "place", "kind", "bands"],
                )

    rows_in = docs.select("doc_id", F.xxhash64("text").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    return rows_in.mapInArrow(sign, f"doc_id {dict(docs.dtypes)['doc_id']}, place long, kind binary, bands array<long>")


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < threshold * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (small + large - both)


def _compare_block(key: np.ndarray, sets: list[np.ndarray], bands: list[np.ndarray], members: list[int], sides: list[int], weights: list[int], threshold: float):
    """Links within one block, or between two: (weight linked with each, edges of a spanning forest).

    A pair counts where ``key`` is the smallest of the large keys that both have.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    grams, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    common = np.zeros((n, n), dtype=np.float32)
    for begin in range(0, len(grams), 4096):
        lo, hi = np.searchsorted(where, (begin, begin + 4096))
        has = np.zeros((n, min(4096, len(grams) - begin)), dtype=np.float32)
        has[owner[lo:hi], where[lo:hi] - begin] = 1
        common += has @ has.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common.astype(np.float64))
    np.fill_diagonal(linked, False)
    side = np.array(sides)
    if side.any():
        linked &= side[:, None] != side[None, :]
    smaller = [b[b < key] for b in bands]
    keys, at = np.unique(np.concatenate(smaller), return_inverse=True)
    if len(keys):
        has = np.zeros((n, len(keys)), dtype=np.float32)
        has[np.repeat(np.arange(n), [len(b) for b in smaller]), at] = 1
        linked &= has @ has.T == 0
    totals = linked @ np.array(weights, dtype=np.int64)
    edges, free = [], np.ones(n, dtype=bool)
    for i in range(n):
        reached = [i] if free[i] else []
        free[i] = False
        while reached:
            x = reached.pop()
            new = np.flatnonzero(linked[x] & free)
            free[new] = False
            edges += [(members[x], members[j]) for j in new.tolist()]
            reached += new.tolist()
    return totals, edges


def _links(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, small_key: int = SMALL_KEY, block: int = BLOCK) -> DataFrame:
    """jaccard_links() with ``place``, which tells the texts of one doc_id apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    bands, rows = hashing.bands_for(threshold, recall, MAX_HASHES)
    signed = scratch.keep(signatures(docs, n, bands, rows))
    known = signed.where("kind is not null and doc_id is not null")
    classes = scratch.keep(known.groupBy("kind").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands")))
    keyed = classes.select("kind", F.explode("bands").alias("key"))
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    candidates = scratch.keep(keyed.join(shared, "key").withColumn("large", F.col("n") > small_key))

    # The sets of the classes that share a key, each once.
    own = candidates.groupBy("kind").agg(F.array_sort(F.collect_set(F.when(F.col("large"), F.col("key")))).alias("large_keys"))
    wanted = own.join(classes.select("kind", "first.doc_id", "first.place", "weight"), "kind")

    def to_set(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                grams, sizes = hashing.shingle_sets([t.encode() for t in part.column(0).to_pylist()], n)
                sets = [x.tobytes() for x in np.split(grams, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.binary())], names=["kind", "doc_id", "place", "weight", "large_keys", "grams"])

    id_type = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    sets = scratch.keep(
        texts.join(wanted, ["doc_id", "place"]).dropDuplicates(["kind"])
        .select("text", "kind", "doc_id", "place", "weight", "large_keys")
        .mapInArrow(to_set, f"kind binary, doc_id {id_type}, place long, weight long, large_keys array<long>, grams binary")
    )

    # Keys of few classes: candidate pairs, verified once each.
    few = candidates.where("not large").select("key", "kind")
    pairs = few.alias("l").join(few.alias("r"), F.expr("l.key = r.key and l.kind < r.kind")).select(F.col("l.kind").alias("ka"), F.col("r.kind").alias("kb")).distinct()
    left, right = (sets.select(*[F.col(c).alias(c[0] + side) for c in ("kind", "doc_id", "place", "weight", "large_keys", "grams")]) for side in "ab")
    both = pairs.join(left, "ka").join(right, "kb").where(~F.arrays_overlap("la", "lb"))

    def verify(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=["ka", "kb", "da", "pa", "db", "pb", "wa", "wb"]).filter(pa.array(good, pa.bool_()))

    linked = both.select("ga", "gb", "ka", "kb", "da", "pa", "db", "pb", "wa", "wb").mapInArrow(verify, f"ka binary, kb binary, da {id_type}, pa long, db {id_type}, pb long, wa long, wb long")
    linked = scratch.keep(linked)

    # Keys of many classes: every pair of blocks compares its members.
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int")
    many = (
        candidates.where("large").select("key", "kind", blocks.alias("blocks")).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "kind", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
        .join(sets, "kind")
    )

    def compare(key, group):
        group = group.sort_by("kind")
        members = list(zip(*(group.column(c).to_pylist() for c in ("kind", "doc_id", "place"))))
        found = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        keys = [np.array(k, dtype=np.int64) for k in group.column("large_keys").to_pylist()]
        totals, edges = _compare_block(key[0].as_py(), found, keys, members, group.column("side").to_pylist(), group.column("weight").to_pylist(), threshold)
        out = [(k, int(t), d, p, d, p) for (k, d, p), t in zip(members, totals) if t] + [(a[0], 0, *a[1:], *b[1:]) for a, b in edges]
        id_kind = group.schema.field("doc_id").type
        types = {"kind": pa.binary(), "n": pa.int64(), "da": id_kind, "pa": pa.int64(), "db": id_kind, "pb": pa.int64()}
        return pa.table({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(types.items())})

    in_blocks = scratch.keep(many.groupBy("key", "i", "j").applyInArrow(compare, f"kind binary, n long, da {id_type}, pa long, db {id_type}, pb long"))

    counted = linked.select(F.col("ka").alias("kind"), F.col("wb").alias("n")).union(linked.select("kb", "wa")).union(in_blocks.select("kind", "n"))
    links = counted.groupBy("kind").agg(F.sum("n").alias("others"))
    ends = [F.struct(F.col(f"d{x}").alias("doc_id"), F.col(f"p{x}").alias("place")).alias(x) for x in "ab"]
    reached = connected_components(linked.select(*ends).union(in_blocks.select(*ends)), scratch)
    of_class = (
        classes.select("kind", "first", "weight").join(links, "kind", "left")
        .join(reached.withColumnRenamed("node", "first"), "first", "left")
        .select("kind", F.col("first.doc_id").alias("class_id"), F.coalesce("component", "first").alias("stands"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    has_id = F.col("doc_id").isNotNull()
    stands = (F.col("stands.doc_id") == F.col("doc_id")) & (F.col("stands.place") == F.col("place"))
    return (
        signed.select("doc_id", "place", F.when(has_id, F.col("kind")).alias("kind")).join(of_class, "kind", "left")
        .select(
            "doc_id", "place", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("stands.doc_id", "doc_id").alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(stands, F.lit(True)).alias("kept"),
        )
    )


def jaccard_links(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, small_key: int = SMALL_KEY, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, component_id, n_links, kept.

    class_id: smallest doc_id with the same n-gram set; component_id: smallest doc_id reachable by links; n_links: other
    documents linked directly; kept: whether the document stands for its component (its own id, for a lone document).
    """
    return _links(docs, n, threshold, recall, small_key, block).drop("place")


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that an earlier one of their component (by doc_id, then by a hash of the text) stands for."""
    dropped = _links(docs, n, threshold).where("not kept").select(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).distinct()
    return docs.join(dropped, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_place")), "left_anti").select(*docs.columns)
