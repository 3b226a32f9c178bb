"""Removal of byte strings that an earlier document holds, by distributed prefix doubling over shared positions.

A position's name of h bytes stands for its rank among all strings of h bytes: equal strings, and only they, have equal
names. Spark sorts positions by pairs of names at growing offsets, drops those whose pair is unique, and names the rest
anew, until ``length`` bytes are covered:

1. ``start`` bytes. Winnowing thins the positions out: every stretch of ``length`` bytes is marked by its smallest name
   of start bytes, so equal stretches have equal marks. Marks that only one document has are unique; their stretches are
   settled. A mark stands with all the stretches (positions) that it marks side by side, the block.
2. ``2 x start`` bytes. A mark's name is paired with the name of the start bytes behind it, and with that of the start
   bytes before it: every stretch of the block contains one of the two doubled strings. Positions of a unique pair are
   settled.
3. ``length`` bytes. The positions left pair the mark's name with the name of the whole stretch, made by doubling; Spark
   sorts the pairs by name and doc_id, and those that aren't the first document of their pair are repeated.

Documents with equal texts count once, and so do equal blocks of a mark: copies are wholly repeated, whatever the first
of them turns out to be, so that only the first goes through the rounds 2 and 3. Within a document every different block
counts once, so a string that all documents have many times is one narrow row of each; and rows of a group pass by in a
sorted stream, so that no group is ever gathered in memory.

A string that very many documents have is no hot group: every task settles what the documents it takes at once tell by
themselves, before anything is shuffled. Of a mark only the two outermost of these documents meet those of other tasks;
of a block, and of a whole stretch, only the first document does, as the others repeat it. What is settled goes its way
spread over all tasks. The pairs of round 2 are aggregated before they are shuffled.

Names are hashes of 64 bits. Equal blocks are told by their bytes. Names of rounds 2 and 3 count only among blocks of one
mark, which have the mark's bytes in common: a million blocks of one mark confuse two strings with a chance of 3 in 10^8.

Each round is one job, whose result is a table in the shared folder; its shuffle files are removed when it ends. Strings only
meet strings of equal marks, so that of a large input every round is done for one slice of all names after the other, and the
shuffle files of only one slice lie on the disks.

Defined cases: a null text counts as empty; a row whose doc_id is null is left whole and makes others lose nothing; rows
that repeat a doc_id don't touch each other; strings are judged on the input, and overlaps count; other columns, whatever
their names, are carried and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import U64, mix64, stream64
from .storage import Scratch

LENGTH = 50
START = 16
#: Texts that are taken from a batch at once in a task, and blocks.
ROWS_AT_ONCE = 500
BLOCKS_AT_ONCE = 4000
#: Bytes of blocks that a task holds at once, to tell documents' equal ones before the shuffle; then it starts afresh.
HELD_BYTES = 1 << 24
#: Marks of a slice of names, and most slices, each of which reads the marks and blocks of all.
MARKS_A_SLICE = 16_000_000
SLICES = 8
_VALUE = stream64(77, 256)
_BASE = 0x9E3779B97F4A7C15 | 1


def names(buf: np.ndarray, length: int) -> np.ndarray:
    """The name of every position that ``length`` bytes follow: names of doubled length are made from pairs."""
    if len(buf) < length:
        return np.zeros(0, dtype=U64)
    whole, done, step, size, left = None, 0, _VALUE[buf], 1, length
    while True:
        if left & 1:
            if whole is None:
                whole, done = step, size
            else:
                n = len(buf) - done - size + 1
                whole = whole[:n] * U64(pow(_BASE, size, 1 << 64)) + step[done : done + n]
                done += size
        left >>= 1
        if not left:
            return mix64(whole)
        n = len(buf) - 2 * size + 1
        step = step[:n] * U64(pow(_BASE, size, 1 << 64)) + step[size : size + n]
        size *= 2


def marks(buf: np.ndarray, length: int, start: int) -> np.ndarray:
    """For every stretch of ``length`` bytes the smallest name of ``start`` bytes in it."""
    low, size, width = names(buf, start), 1, length - start + 1
    if len(low) < width:
        return low[:0]
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def placed_marks(buf: np.ndarray, length: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """marks() and the first place of each."""
    low, size, width = names(buf, start), 1, length - start + 1
    if len(low) < width:
        return low[:0], np.zeros(0, dtype=np.int64)
    at = np.arange(len(low))

    def nearer(d):
        first = low[:-d] <= low[d:]
        return np.where(first, low[:-d], low[d:]), np.where(first, at[:-d], at[d:])

    while 2 * size <= width:
        low, at = nearer(size)
        size *= 2
    return nearer(width - size) if width - size else (low, at)


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _place() -> Column:
    """Tells the rows of a doc_id apart by their texts; rows that repeat both are judged alike."""
    return F.hash("text")


def _ranks(ids: pa.Array) -> np.ndarray:
    return pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)


def _groups(rank: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by keys and rank, and for each row in it the first and the last place of its keys."""
    order = np.lexsort((rank, *keys))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return order, begin[group], (np.append(begin[1:], len(order)) - 1)[group]


def _lanes(name: np.ndarray, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """0 for the rows that must meet others of their mark, else a number that spreads them.

    Where a mark has several documents among the rows, it is shared, and the smallest and the largest stand for all.
    """
    order, first, last = _groups(rank[row], name)
    sorted_rank, at = rank[row][order], np.arange(len(order))
    settled = order[(sorted_rank[first] < sorted_rank[last]) & (at != first) & (at != last)]
    lane = np.zeros(len(name), dtype=np.int32)
    lane[settled] = 1 + row[settled]
    return lane


def _marks(texts: DataFrame, length: int, start: int, id_type: str) -> DataFrame:
    """name, lane, doc_id, place: the marks of each text."""

    def mark(batches):
        for batch in _parts(batches, ROWS_AT_ONCE):
            found = [np.unique(marks(np.frombuffer(t.encode(), np.uint8), length, start)) for t in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            name = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            lane = _lanes(name, row, _ranks(batch.column(0)))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(lane), batch.column(0).take(rows), batch.column(1).take(rows)], names=["name", "lane", "doc_id", "place"])

    return texts.mapInArrow(mark, f"name long, lane int, doc_id {id_type}, place int")


def _slices(marks: DataFrame) -> list[Column]:
    """Which names each slice has."""
    n = min(SLICES, max(1, -(-marks.count() // MARKS_A_SLICE)))
    return [F.pmod("name", F.lit(n)) == k for k in range(n)]


def _shared_marks(marks: DataFrame) -> DataFrame:
    """Round 1. doc_id, place, found: the marks of each text that another document has too."""
    named = marks.repartition("name", "lane")
    # places, of which none is null, are counted so that both sides of the join read the same columns, and so one exchange
    counted = named.groupBy("name", "lane").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("place").alias("places"))
    shared = counted.where("(lane > 0 or low < high) and places > 0").select("name", "lane")
    return named.join(shared.hint("shuffle_hash"), ["name", "lane"]).groupBy("doc_id", "place").agg(F.collect_list("name").alias("found"))


def _blocks(texts: DataFrame, found: DataFrame, length: int, start: int, id_type: str) -> DataFrame:
    """name, doc_id, place, at, more, lead, n, copy, body: the different blocks of shared marks of each document.

    ``at``: first position, and ``more``: how much further on the document has the block again, null if it doesn't;
    ``lead``: bytes before the mark; ``n``: positions; ``copy``: an earlier document taken at once has the block alike;
    ``body``: all bytes of the block's stretches, null for copies.
    """
    columns = ["name", "doc_id", "place", "at", "more", "lead", "n", "copy", "body"]

    def joined(batch, ready):
        row, name, at, lead, n, more, copy, body = zip(*ready)
        rows = pa.array(np.repeat(row, [len(x) for x in name]))
        whole = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind))
        listed = lambda parts, kind: pa.array(list(chain.from_iterable(parts)), kind)
        ids = (batch.column(c).take(rows) for c in (0, 1))
        ends = [whole(lead, np.int32), whole(n, np.int32), listed(copy, pa.bool_()), listed(body, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(name).view(np.int64)), *ids, whole(at, np.int32), listed(more, pa.list_(pa.int32())), *ends], names=columns)

    def cut(batches):
        for batch in _parts(batches, ROWS_AT_ONCE):
            holder: dict[tuple[bytes, int], int] = {}
            ready, held = [], 0
            rank, texts, found = _ranks(batch.column(0)), batch.column(2), batch.column(3)
            for row in np.argsort(rank, kind="stable").tolist():
                raw, mine, own_rank = texts[row].as_py().encode(), found[row], int(rank[row])
                low, at = placed_marks(np.frombuffer(raw, np.uint8), length, start)
                edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                wanted = np.isin(low[edge], mine.values.to_numpy().view(U64))
                last = np.concatenate((edge[1:], [len(at)]))[wanted]
                edge = edge[wanted]
                lead = at[edge] - edge
                first: dict[tuple[bytes, int], int] = {}
                again: dict[int, list[int]] = {}
                for i, (x, y, z) in enumerate(zip(edge.tolist(), last.tolist(), lead.tolist())):
                    one = first.setdefault((raw[x : y - 1 + length], z), i)
                    if one != i:
                        again.setdefault(one, []).append(x - int(edge[one]))
                own = np.fromiter(first.values(), dtype=np.int64, count=len(first))
                more = [again.get(i) for i in own.tolist()] if again else [None] * len(own)
                copy = [holder.setdefault(k, own_rank) < own_rank for k in first]
                body = [None if c else k[0] for k, c in zip(first, copy)]
                ready.append((row, low[edge[own]], edge[own], lead[own], (last - edge)[own], more, copy, body))
                held += sum(map(len, filter(None, body)))
                if held > HELD_BYTES:
                    yield joined(batch, ready)
                    holder, ready, held = {}, [], 0
            if ready:
                yield joined(batch, ready)

    return texts.join(found, ["doc_id", "place"]).select("doc_id", "place", "text", "found").mapInArrow(cut, f"name long, doc_id {id_type}, place int, at int, more array<int>, lead int, n int, copy boolean, body binary")


def _later(batch: pa.RecordBatch, keys: list[str], last: list | None) -> tuple[np.ndarray, list]:
    """Which rows, sorted by keys and doc_id, have an earlier document of equal keys; and what the next batch must know."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for c in (batch.column(k) for k in keys):
        new[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    new[0] = last is None or any(batch.column(k)[0].as_py() != v for k, v in zip(keys, last))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    holder = ids[np.maximum(at, 0)]
    if not new[0]:
        holder[at < 0] = last[-1]
    return holder < ids, [*(batch.column(k)[-1].as_py() for k in keys), holder[-1]]


def _firsts(blocks: DataFrame, length: int, id_type: str) -> DataFrame:
    """The blocks that may be the first of their kind; those that an earlier document has alike become copies, too."""
    columns = ["name", "doc_id", "place", "at", "more", "lead", "n"]

    def sweep(batches):
        last = None
        for batch in batches:
            if batch.num_rows:
                copy, last = _later(batch, ["name", "lead", "body"], last)
                body = batch.column("body")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(copy), pa.compute.if_else(pa.array(copy), pa.scalar(None, body.type), body)], names=[*columns, "copy", "body"])

    sent = blocks.where("not copy").drop("copy").repartition("name", F.xxhash64("body")).sortWithinPartitions("name", "lead", "body", "doc_id")
    return sent.mapInArrow(sweep, f"name long, doc_id {id_type}, place int, at int, more array<int>, lead int, n int, copy boolean, body binary")


def _doubled(firsts: DataFrame, length: int, start: int) -> DataFrame:
    """Round 2. Those first blocks that have the mark with the bytes before it or behind it in common with others."""
    step = min(start, (length - start + 1) // 2)
    lead, size, keys = F.col("lead"), F.octet_length("body"), ["name", "before", "pair"]
    before = F.when(lead >= step, F.xxhash64(F.substring("body", lead - step + 1, F.lit(step))))
    behind = F.when(lead + start + step <= size, F.xxhash64(F.substring("body", lead + start + 1, F.lit(step))))
    sides = F.array(F.struct(F.lit(True).alias("before"), before.alias("pair")), F.struct(F.lit(False).alias("before"), behind.alias("pair")))
    pairs = firsts.select("name", "doc_id", "place", "at", F.inline(sides)).where("pair is not null")
    shared = pairs.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*keys)
    open_ = pairs.join(shared.hint("shuffle_hash"), keys).groupBy("doc_id", "place", "at").agg(F.bool_or("before").alias("before"), F.bool_or(~F.col("before")).alias("behind"))
    return firsts.join(open_, ["doc_id", "place", "at"])


def _repeated(doubled: DataFrame, length: int, start: int, id_type: str) -> DataFrame:
    """Round 3. doc_id, place, at, more: positions whose stretch an earlier document has."""
    step = min(start, (length - start + 1) // 2)
    columns = ["known", "name", "full", "doc_id", "place", "at", "more"]

    def name_all(batches):
        for part in _parts(batches, BLOCKS_AT_ONCE):
            lead, at, n = (part.column(c).to_numpy() for c in ("lead", "at", "n"))
            before, behind = (part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("before", "behind"))
            buf = np.frombuffer(b"".join(part.column("body").to_pylist()), np.uint8)
            sizes = n.astype(np.int64) + length - 1
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            left = lead[row] - inside
            # a stretch that holds a doubled string is open only if the string is shared
            open_ = (before[row] | (left < step)) & (behind[row] | (length - start - left < step))
            row, inside = row[open_], inside[open_]
            full = names(buf, length)[(np.cumsum(sizes) - sizes)[row] + inside] if len(row) else np.zeros(0, U64)
            name, rank = part.column("name").to_numpy()[row], _ranks(part.column("doc_id"))[row]
            # repeated here already: no longer part of its group, and spread over all tasks
            order, first, _ = _groups(rank, full, name)
            known = np.zeros(len(row), dtype=bool)
            known[order] = rank[order] > rank[order][first]
            name, full = np.where(known, 0, name), np.where(known, mix64(full + np.arange(len(row), dtype=U64)), full)
            doc_id, place, more = (part.column(c).take(pa.array(row)) for c in ("doc_id", "place", "more"))
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(name), pa.array(full.view(np.int64)), doc_id, place, pa.array((at[row] + inside).astype(np.int32)), more], names=columns)

    def sweep(batches):
        last = None
        for batch in batches:
            if batch.num_rows:
                later, last = _later(batch, ["known", "name", "full"], last)
                yield batch.select(columns[3:]).filter(pa.compute.or_(batch.column("known"), pa.array(later)))

    named = doubled.mapInArrow(name_all, f"known boolean, name long, full long, doc_id {id_type}, place int, at int, more array<int>")
    # the whole stretch's name first, as Spark compares rows by their first column before all others
    sent = named.repartition("name", "full").sortWithinPartitions("full", "name", "known", "doc_id")
    return sent.mapInArrow(sweep, f"doc_id {id_type}, place int, at int, more array<int>")


def _covered(begin: np.ndarray, end: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte spans of runs of stretches begin..end-1."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order] - 1 + length)
    cut = np.flatnonzero(begin[1:] > reach[:-1])
    return list(zip(begin[np.concatenate(([0], cut + 1))].tolist(), reach[np.concatenate((cut, [len(reach) - 1]))].tolist())) if len(begin) else []


def _removed(docs: DataFrame, length: int, start: int, as_text: bool) -> DataFrame:
    """row (all columns of the document as a struct), n_bytes, spans, kept."""
    if not 0 < start < length:
        raise ValueError("start must be shorter than length")
    scratch = Scratch(docs.sparkSession, "repeats")
    id_type = dict(docs.dtypes)["doc_id"]
    known = docs.where("doc_id is not null").select("doc_id", _place().alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    narrow = scratch.keep(known.select("doc_id", "place", F.unhex(F.sha2("text", 256)).alias("digest")))
    groups = narrow.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = scratch.keep(narrow.join(groups, "digest").where("doc_id > low").select("doc_id", "place").distinct())
    scratch.drop(narrow)
    long_enough = known.where(F.octet_length("text") >= length).join(copies, ["doc_id", "place"], "left_anti").select("doc_id", "place", "text")
    marks = scratch.keep(_marks(long_enough, length, start, id_type))
    slices = _slices(marks)
    found = [scratch.keep(_shared_marks(marks.where(own))) for own in slices]
    scratch.drop(marks)
    of_text = found[0] if len(slices) == 1 else reduce(DataFrame.unionByName, found).groupBy("doc_id", "place").agg(F.flatten(F.collect_list("found")).alias("found"))
    blocks = scratch.keep(_blocks(long_enough, of_text, length, start, id_type))
    for part in found:
        scratch.drop(part)
    settled = []
    for own in slices:
        mine = blocks.where(own)
        firsts = scratch.keep(_firsts(mine, length, id_type))
        settled.append(scratch.keep(firsts.unionByName(mine).where("copy").select("doc_id", "place", "at", "more", "n")))
        doubled = scratch.keep(_doubled(firsts.where("not copy"), length, start))
        scratch.drop(firsts)
        settled.append(scratch.keep(_repeated(doubled, length, start, id_type).withColumn("n", F.lit(1))))
        scratch.drop(doubled)
    scratch.drop(blocks)
    runs = reduce(DataFrame.unionByName, settled).select("doc_id", "place", F.explode(F.concat(F.array(F.lit(0)), F.coalesce("more", F.array().cast("array<int>")))).alias("on"), "at", "n")
    starts = runs.select("doc_id", "place", (F.col("at") + F.col("on")).alias("a"), (F.col("at") + F.col("on") + F.col("n")).alias("b"))
    marked = scratch.keep(starts.groupBy("doc_id", "place").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")))
    for part in settled:
        scratch.drop(part)
    marked = marked.unionByName(copies.select("doc_id", "place", F.lit(True).alias("copy")), allowMissingColumns=True)
    kept_type = "string" if as_text else "binary"

    def remove(batches):
        for batch in _parts(batches, ROWS_AT_ONCE):
            spans, kept, sizes = [], [], []
            texts = pa.compute.fill_null(pa.compute.struct_field(batch.column("row"), "text"), "").to_pylist()
            for text, a, b, copy in zip(texts, batch.column("a"), batch.column("b"), batch.column("copy").to_pylist()):
                raw = text.encode()
                own = [(0, len(raw))] if copy and len(raw) >= length else _covered(a.values.to_numpy(), b.values.to_numpy(), length) if a.is_valid else []
                at, left = 0, []
                for begin, end in own:
                    left.append(raw[at:begin])
                    at = end
                spans.append([{"begin": x, "end": y} for x, y in own])
                kept.append(b"".join([*left, raw[at:]]))
                sizes.append(len(raw))
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(spans, kind), left], names=["row", "n_bytes", "spans", "kept"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _place().alias("place"))
    return rows.join(marked, ["doc_id", "place"], "left").select("row", "a", "b", "copy").mapInArrow(
        remove, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, spans array<struct<begin:int,end:int>>, kept {kept_type}"
    )


def repeated_bytes(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """One row per document: its columns, n_bytes, spans (removed bytes) and kept (remaining bytes).

    A document's column of one of these names is left out.
    """
    return _removed(docs, length, start, as_text=False).select(*(f"row.`{c}`" for c in docs.columns if c not in ("n_bytes", "spans", "kept")), "n_bytes", "spans", "kept")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated bytes removed; those with nothing but white space left are removed whole.

    What is left of a character that was cut goes with it. n_chars, if there, counts the new text; null texts stay.
    """
    done = _removed(docs, length, START, as_text=True)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("row.text").isNotNull(), F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    emptied = (F.size("spans") > 0) & (F.length(F.btrim(F.regexp_replace("kept", r"\s+", " "))) == 0)
    return done.where(~emptied).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    done = _removed(docs.select("doc_id", "text"), length, START, as_text=False)
    return done.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
