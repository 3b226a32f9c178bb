"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``chunk_chars`` are encoded where they stand. Longer texts are cut into overlapping chunks that are spread
over the cluster; each chunk is pre-tokenised by itself, neighbours are stitched at the first boundary that both found
in their overlap (from there on they agree, as a pre-token depends only on what follows its start), and the pieces
between stitches are spread again and encoded. The ids of a text are its pieces' ids in order; decoding concatenates
the bytes of the ids.

Defined cases: a null text counts as empty; an empty text has no ids; any doc_id, null and repeated ones included, gives
one row per input row; other columns are not read. Where neighbours share no boundary in the overlap (a run of letters
longer than it), the stitcher pre-tokenises on from the last known boundary, so the result is exact for every text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import PartCache

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
ROWS_AT_ONCE = 256
_loaded: dict[str, "Codec"] = {}


class Codec:
    """A rank file and a pattern, held once per Python worker."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # regex counts a few control characters as white space, which the encoder does not
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]
        self.parts = PartCache(lambda parts: [array("I", self.bpe.encode_ordinary(p)).tobytes() for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        return [b"".join(parts) for parts in self.parts.encode(texts)]

    def decode(self, ids: bytes) -> bytes:
        return self.bpe.decode_bytes(np.frombuffer(ids, "<u4").tolist())

    def decimals(self, ids: bytes) -> str:
        return ",".join([self.decimal[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def boundaries(self, text: str, at: int = 0) -> Iterator[int]:
        """Starts of the pre-tokens from one that is known to begin at ``at``."""
        return (m.start() for m in self.pattern.finditer(text, at))


def codec(rank_file: str, pattern: str) -> Codec:
    key = f"{rank_file}\0{pattern}"
    if key not in _loaded:
        _loaded[key] = Codec(rank_file, pattern)
    return _loaded[key]


def stitch(chunks: list[tuple[int, str, np.ndarray]], coder: Codec) -> list[str]:
    """Pieces of a text whose every cut is a true pre-token boundary behind a character that isn't white space.

    (A run of white space is split by what follows it, so a piece must not end in one.)

    ``chunks``: for each chunk its place in the text, its characters (the overlap with the next one included) and the
    starts of its pre-tokens, found as if the text began there.
    """
    text = "".join(body[: chunks[i + 1][0] - at] if i + 1 < len(chunks) else body for i, (at, body, _) in enumerate(chunks))
    cuts, true = [0], chunks[0][2]
    for (at, body, _), (after, _, found) in zip(chunks, chunks[1:]):
        end = at + len(body)
        found = found + after
        # What a chunk found at its very end may owe to the text being cut there.
        both = np.intersect1d(true[true < end], found[found >= after], assume_unique=True)
        if len(both):
            true = found[found >= both[0]]
            cuts += [b for b in both.tolist() if not text[b - 1].isspace()][:1]
        else:
            known, wanted, fresh = int(true[-1]) if len(true) else cuts[-1], set(found.tolist()), []
            for b in coder.boundaries(text, known):
                fresh.append(b)
                if b > end and b in wanted:
                    break
            met = fresh[-1] if fresh and fresh[-1] in wanted and fresh[-1] > end else None
            true = found[found >= met] if met is not None else np.array(fresh or [known], dtype=np.int64)
            if met is not None and not text[met - 1].isspace():
                cuts.append(met)
    return [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)]) if a < b]


def bpe_ids(docs: DataFrame, rank_file: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian 32-bit), decoded (bytes of the ids)."""
    return _run(docs, rank_file, pattern, chunk_chars, overlap_chars, digest=False)


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """bpe_ids() with the SHA-256 of the comma-joined ids and of the decoded bytes in their place."""
    return _run(docs, rank_file, pattern, chunk_chars, overlap_chars, digest=True)


def _run(docs: DataFrame, rank_file: str, pattern: str, chunk_chars: int, overlap_chars: int, digest: bool) -> DataFrame:
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    values = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"

    def finished(coder: Codec, ids: list[bytes]) -> list:
        counts = pa.array([len(x) // 4 for x in ids], pa.int64())
        if digest:
            first = pa.array([hashlib.sha256(coder.decimals(x).encode()).hexdigest() for x in ids], pa.string())
            second = pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string())
        else:
            first, second = pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())
        return [counts, first, second]

    names = ["n_tokens", *(x.split()[0] for x in values.split(", "))]

    def encode_short(batches):
        coder = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *finished(coder, ids)], names=["doc_id", *names])

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = list(range(0, max(len(text) - overlap_chars, 1), chunk_chars))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(starts)), pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int64()), pa.array([text[s : s + chunk_chars + overlap_chars] for s in starts])],
                    names=["key", "no", "start", "body"],
                )

    def split(batches):
        coder = codec(rank_file, pattern)
        for batch in batches:
            found = [np.fromiter(coder.boundaries(t), dtype="<i8").tobytes() for t in batch.column(3).to_pylist()]
            yield batch.append_column("found", pa.array(found, pa.binary()))

    def pieces(key, table):
        table = table.sort_by("no")
        chunks = [(s, b, np.frombuffer(f, "<i8")) for s, b, f in zip(*(table.column(c).to_pylist() for c in ("start", "body", "found")))]
        parts = stitch(chunks, codec(rank_file, pattern))
        return pa.table({"key": pa.array([key[0].as_py()] * len(parts)), "no": pa.array(range(len(parts)), pa.int32()), "body": pa.array(parts)})

    def encode_pieces(batches):
        coder = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(coder.encode(part.column(2).to_pylist()), pa.binary())], names=["key", "no", "ids"])

    def join_ids(key, table):
        ids = b"".join(table.sort_by("no").column("ids").to_pylist())
        return pa.table([pa.array([key[0].as_py()]), *finished(codec(rank_file, pattern), [ids])], names=["key", *names])

    is_long = F.length("text") > chunk_chars
    short = texts.where(~is_long).mapInArrow(encode_short, f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens long, {values}")
    # Equal long texts are encoded once.
    keyed = texts.where(is_long).withColumn("key", F.sha2("text", 256))
    ids = (
        keyed.groupBy("key").agg(F.first("text").alias("text"))
        .mapInArrow(cut, "key string, no int, start long, body string")
        .repartition("key", "no")
        .mapInArrow(split, "key string, no int, start long, body string, found binary")
        .groupBy("key").applyInArrow(pieces, "key string, no int, body string")
        .repartition("key", "no")
        .mapInArrow(encode_pieces, "key string, no int, ids binary")
        .groupBy("key").applyInArrow(join_ids, f"key string, n_tokens long, {values}")
    )
    return short.unionByName(keyed.select("doc_id", "key").join(ids, "key").drop("key"))
