"""Periodic runs of words: stretches that repeat with a period, as long as they can be.

A run is a stretch of words whose smallest period q fits into it at least twice, that has ``min_length`` words or more, and
that no neighbouring word extends with that period. For every period p the grid 0, p, 2p, ... meets each run of period p
within its first p words, so the words at i and i + p, for i on the grid, are extended to both sides; all grids together
have about n ln n points (the harmonic sum), of which only those with equal words are followed.

How far two places agree is found from a difference cover: for any two places there is a shift below ``MODULUS`` that
brings both to sampled places. The few words up to there are compared one by one; what agrees so far goes on by the
sorted sampled suffixes, whose neighbours' common lengths lie in a sparse table of range minima. Only sampled suffixes are
sorted (by three words at a time, then by pairs of ranks at doubling distances, and only those that still tie), and only
of documents with a pair that reaches its samples. Extensions to the left use the same on the reversed words.

Everything happens within a document, so nothing is shuffled; a task takes ``WORDS_AT_ONCE`` words at once, or one longer
document.

Defined cases: a null or empty text has no words and no runs; any doc_id, null and repeated ones included, gives one row for
each row; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
#: A perfect difference cover: every difference modulo 31 is that of two of these.
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
WORDS_AT_ONCE = 200_000
PAIRS_AT_ONCE = 1 << 18
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _shift_table() -> np.ndarray:
    """For residues a and b, at a * MODULUS + b: the smallest shift that brings both into the cover."""
    member = np.isin(np.arange(MODULUS), COVER)
    out = np.empty(MODULUS * MODULUS, dtype=np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a * MODULUS + b] = next(d for d in range(MODULUS) if member[(a + d) % MODULUS] and member[(b + d) % MODULUS])
    return out


SHIFTS = _shift_table()


def agreeing(words: np.ndarray, i: np.ndarray, j: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many words agree from each i and j on, counted up to ``upto``."""
    out, t = np.zeros(len(i), dtype=np.int64), 0
    live = np.flatnonzero(upto > 0)
    while len(live):
        live = live[words[i[live] + t] == words[j[live] + t]]
        t += 1
        out[live] = t
        live = live[upto[live] > t]
    return out


def to_samples(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return SHIFTS[i % MODULUS * MODULUS + j % MODULUS]


class Extensions:
    """Common extensions of two places of ``words``, whose documents end with numbers that occur once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        places = np.flatnonzero(np.isin(np.arange(MODULUS), COVER)[np.arange(len(words)) % MODULUS])
        self.of_place = np.full(len(words), -1, dtype=np.int64)
        self.of_place[places] = np.arange(len(places))
        order, levels = self._sorted(places)
        self.rank = np.empty(len(places), dtype=np.int64)
        self.rank[order] = np.arange(len(places))
        self.table = self._minima(self._common(places[order], levels))

    def _sorted(self, places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Samples in the order of their suffixes; and their names by the first MODULUS, 2 * MODULUS, ... words."""
        n = len(places)
        bits = max(int(self.words.max()), 1).bit_length()
        step = min(3, 62 // bits)
        padded = np.concatenate([self.words, np.zeros(MODULUS + step, dtype=np.int64)])
        order, head = np.arange(n), np.zeros(n, dtype=np.int64)

        def split(slots: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Sort the samples in these slots by (group, key); a group is named by its first slot. Returns slots of ties."""
            by = np.lexsort((key, head[slots]))
            key, group = key[by], head[slots]
            order[slots] = order[slots][by]
            first = np.ones(len(slots), dtype=bool)
            first[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
            head[slots] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            alone = first & np.append(first[1:], True)
            return slots[~alone]

        tied = np.arange(n)
        for at in range(0, MODULUS, step):
            key = np.zeros(len(tied), dtype=np.int64)
            for t in range(at, at + step):
                key = (key << bits) | padded[places[order[tied]] + t]
            tied = split(tied, key)
            if not len(tied):
                break
        levels, width = [], MODULUS
        while True:
            names = np.empty(n, dtype=np.int64)
            names[order] = head
            levels.append(names)
            if not len(tied):
                return order, levels
            tied = split(tied, names[self.of_place[places[order[tied]] + width]])
            width *= 2

    def _common(self, places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sorted suffix shares with the one before it."""
        i, j = places[:-1], places[1:]
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][self.of_place[i + done]] == levels[k][self.of_place[j + done]]
            done[same] += MODULUS << k
        return done + agreeing(self.words, i + done, j + done, np.full(len(i), len(self.words)))

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        table = [common.astype(np.int32) if len(common) == 0 or common.max() < 2**31 else common]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j (different places) on."""
        shift = to_samples(i, j)
        out = agreeing(self.words, i, j, shift)
        far = np.flatnonzero(out == shift)
        a, b = (self.rank[self.of_place[x[far] + shift[far]]] for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[far[at]] += np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def grid_pairs(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, min_length: int):
    """Chunks (document, place, period) of the grid points whose word is the same one period on."""
    whole = np.flatnonzero(sizes >= min_length)
    most = sizes[whole] // 2
    doc = np.repeat(whole, most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[doc] - 1) // period
    upto = np.cumsum(points)
    at = 0
    while at < len(doc):
        end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")), at + 1)
        n = points[at:end]
        step = np.repeat(period[at:end], n)
        i = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step + np.repeat(begins[doc[at:end]], n)
        same = np.flatnonzero(words[i] == words[i + step])
        yield np.repeat(doc[at:end], n)[same], i[same], step[same]
        at = end


def find_runs(documents: list[np.ndarray], min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs of documents given as arrays of numbers from 0, by document, start, period."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    base = max((int(d.max()) for d in documents if len(d)), default=0) + 1

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some documents, with a number of its own before, between and behind them, and their begins."""
        parts = [np.array([base])]
        for k, d in enumerate(which.tolist()):
            parts += [documents[d], np.array([base + k + 1])]
        return np.concatenate(parts).astype(np.int64), np.cumsum(sizes[which] + 1) - sizes[which]

    every = np.arange(len(documents))
    words, begins = joined(every)
    turned = words[::-1].copy()
    last = len(words) - 1
    near, far = [], []
    for doc, i, period in grid_pairs(words, begins, sizes, min_length):
        j = i + period
        ahead, behind = to_samples(i, j), to_samples(last - i + 1, last - j + 1)
        f, b = agreeing(words, i, j, ahead), agreeing(turned, last - i + 1, last - j + 1, behind)
        open_ = (f == ahead) | (b == behind)
        near.append(np.stack([doc, i - begins[doc], period, f, b])[:, ~open_])
        far.append(np.stack([doc, i - begins[doc], period])[:, open_])
    far = np.concatenate(far, axis=1) if far else np.zeros((3, 0), dtype=np.int64)
    if far.shape[1]:
        doc, i, period = far
        which = np.unique(doc)
        words, begins = joined(which)
        i = i + begins[np.searchsorted(which, doc)]
        last = len(words) - 1
        f = Extensions(words).of(i, i + period)
        b = Extensions(words[::-1].copy()).of(last - i + 1, last - i - period + 1)
        near.append(np.stack([*far, f, b]))
    doc, i, period, f, b = np.concatenate(near, axis=1) if near else np.zeros((5, 0), dtype=np.int64)
    good = (b < period) & (f + b >= period) & (f + b + period >= min_length)
    doc, start, period, length = doc[good], (i - b)[good], period[good], (f + b + period)[good]
    # a run is met again at multiples of its period
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = doc[first], start[first], length[first], period[first]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; words from 0), collapsed.

    Words are runs of characters other than ASCII white space. ``collapsed`` is the text's words joined by single spaces,
    without those behind the first period of a run.
    """
    id_type = dict(docs.dtypes)["doc_id"]

    def solve(ids: list, texts: list[list[bytes]], numbers: list[np.ndarray], arrow_id: pa.DataType) -> pa.RecordBatch:
        doc, start, length, period = find_runs(numbers, min_length)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        depth = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
        np.add.at(depth, begins[doc] + start + period, 1)
        np.add.at(depth, begins[doc] + start + length, -1)
        kept, has = np.cumsum(depth) == 0, set(doc.tolist())
        out = [b" ".join(compress(t, kept[b : b + len(t)].tolist()) if k in has else t).decode() for k, (t, b) in enumerate(zip(texts, begins.tolist()))]
        rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
        offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, arrow_id), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(out, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
        )

    def work(batches):
        ids, texts, numbers, total = [], [], [], 0
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                found = text.as_py().encode().split()
                ids.append(key.as_py())
                texts.append(found)
                numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                total += len(found)
                if total >= WORDS_AT_ONCE:
                    yield solve(ids, texts, numbers, arrow_id)
                    ids, texts, numbers, total = [], [], [], 0
                    known.clear()
        if ids:
            yield solve(ids, texts, numbers, arrow_id)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(work, f"doc_id {id_type}, n_words long, runs array<{RUN}>, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a document in ten the words from one on repeat with a period, which checks of runs look for.

    With h = crc32 of the decimal doc_id, g = h / 10 and n words: if h % 10 is 0, words from a = g % n on repeat with the
    period 1 + (n - a) / (3 + g % 8). Words are then joined by single spaces; other texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    # worked out once a row, and only where the tail repeats
    w = F.when(h % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    rows = docs.select("doc_id", "text", F.inline(F.array(F.struct(w.alias("w"), F.floor(h / 10).alias("g")))))
    n = F.size("w")
    at = rows.select("*", F.inline(F.array(F.struct(F.when(n > 0, (F.col("g") % n).cast("int")).alias("a")))))
    span = n - F.col("a")
    period = (F.lit(1) + F.floor(span / (F.lit(3) + F.col("g") % 8))).cast("int")
    cycle = F.slice("w", F.col("a") + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(span / period).cast("int"))), F.lit(1), span)
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return at.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs(): doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
