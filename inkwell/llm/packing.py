"""Tokenising documents and packing them into sequences by bounded-space online best-fit.

The rank file holds the vocabulary, and the tokenizer's file beside it (.json, if there is one) the added tokens: a text
is cut at these, each is its own id, and only what lies between is encoded. A document's ids are followed by an end id. A
longer document than a sequence is cut from its end into pieces of full
length, so that only its first piece can be shorter; full pieces fill sequences of their own. The rest are packed:
each partition keeps a fixed number of open bins in a bitset keyed by free space. A piece goes to the open bin with the
least free space that holds it; if none does, a bin is opened, and when too many are open, the fullest closes first.
Partitions are shuffled by a hash of the piece and sorted by another, so that lengths come in an order independent of
the source and a lost task packs its rows again in the same way. Spark merges small partitions, so that few bins stay
partly filled.

Defined cases: a null text counts as empty, and an empty document is its end id alone; every input row gives at least
one piece, repeated and null doc_ids included; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, codec

SEQUENCE_TOKENS = 1024
END_ID = 2
OPEN_BINS = 512
ROWS_AT_ONCE = 512


def added_tokens(rank_file: str) -> dict[str, bytes]:
    """The ids, as little-endian 32-bit numbers, of the added tokens in the tokenizer's file beside a rank file."""
    beside = Path(rank_file).with_suffix(".json")
    if not beside.exists():
        return {}
    tokens = json.loads(beside.read_text(encoding="utf-8"))["added_tokens"]
    for t in tokens:
        if t["lstrip"] or t["rstrip"] or t["single_word"]:
            raise ValueError(f"added tokens that take in their surroundings are not supported: {t['content']}")
    return {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens}


def encode(coder: Codec, texts: list[str], added: dict[str, bytes]) -> list[bytes]:
    """Ids of each text, in which added tokens stand for themselves."""
    holding = [i for i, t in enumerate(texts) if any(a in t for a in added)]
    if not holding:
        return coder.encode(texts)
    # of tokens that begin at the same place the longest counts
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    split = {i: cut.split(texts[i]) for i in holding}
    out = coder.encode(["" if i in split else t for i, t in enumerate(texts)])
    for i, parts in split.items():
        between = coder.encode(parts[::2])
        out[i] = b"".join(x for k, ids in enumerate(between) for x in (ids, added[parts[2 * k + 1]] if 2 * k + 1 < len(parts) else b""))
    return out


def pieces(docs: DataFrame, rank_file: str, pattern: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        coder, added = codec(rank_file, pattern), added_tokens(rank_file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows, piece, start, size, crc = [], [], [], [], []
                for row, ids in enumerate(encode(coder, part.column(1).to_pylist(), added)):
                    ids += end
                    n = len(ids) // 4
                    head = n % length or length
                    bounds = [0, *range(head, n + 1, length)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts.mapInArrow(cut, f"doc_id {dict(texts.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins in a bitset keyed by free space; bins of equal space are stacked."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.free_bits, self.stacks, self.n_open = 0, [[] for _ in range(capacity + 1)], 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        bin_id = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece."""
        fits = self.free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.next_id
            self.next_id += 1
            if free > size and self.n_open >= self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        left = free - size
        if left:
            self.stacks[left].append(bin_id)
            self.free_bits |= 1 << left
            self.n_open += 1
        return bin_id, self.capacity - free


def pack(rows: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """``rows`` of pieces() with sequence_id and offset. Lengths must be within 1..capacity."""
    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")

    def fill(batches):
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield batch.append_column("sequence_id", pa.array([b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return (
        rows.repartition(F.xxhash64(order)).sortWithinPartitions(order, "doc_id", "piece", "length")
        .mapInArrow(fill, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, rank_file: str, pattern: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces() of the documents, packed."""
    return pack(pieces(docs, rank_file, pattern, length, end_id), length, open_bins)
