"""Quality classifier: a factorisation machine on hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in
time linear in the features, by the sum-of-squares identity.

The model is fitted on at most ``TRAIN_DOCS`` labelled documents in the order of a hash of their ids, up to the one with which
their sparse features come to more than ``TRAIN_FEATURES``: of long texts fewer are learned from, and each on its whole text.
These features (eight bytes each) are all that the driver receives, and the fitted weights, of fixed size, are all that the
executors do. Every document is scored on its whole text.

Defined cases: null and empty texts have only the features of an empty text and are scored like any other; if the
labels hold fewer than two classes, every score is the share of label 1 (0.5 without labels); repeated and null doc_ids
give one row each; a document is learned from once, with its largest label, and with one of its texts if its doc_id is
repeated; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import id_remainder
from .storage import Scratch

WORD_FEATURES = 1 << 15
RANK = 8
TRAIN_DOCS = 6000
TRAIN_FEATURES = 8_000_000
EPOCHS = 12
BATCH = 128
RATE = 0.08
DECAY = 1e-4
PREDICT_FROM = 0.3

_PLAIN_WORD = re.compile(r"[^\W\d_]+")
#: structure statistics, each a feature of its own with a value from 0 to 1
STATISTICS = (
    "bias", "log_chars", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "upper", "digits", "white",
    "marks", "mark_kinds", "pipes", "word_ends_in_mark", "all_upper_words", "same_as_previous", "lines", "distinct_lines", "words_per_line", "stops",
)
FEATURES = WORD_FEATURES + len(STATISTICS)
_LETTER_OR_SPACE = re.compile(r"[\w\s.,]+")
_hashed: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _hashed.get(word)
    if found is None:
        if len(_hashed) > 200_000:
            _hashed.clear()
        found = _hashed[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_FEATURES
    return found


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features; the hashed words' values have length 1 together."""
    words = text.split()
    n, chars = len(words), len(text)
    counts = Counter(words)
    plain: Counter[int] = Counter()
    for w, k in counts.items():
        plain[_bucket(w.lower())] += k
    marks = _LETTER_OR_SPACE.sub("", text)
    lines = text.split("\n")
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    letters = sum(map(len, counts)) / max(len(counts), 1)
    upper = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    ends = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,")
    values = [
        1.0, math.log1p(chars) / 16, math.log1p(n) / 14, min(letters / 20, 1), sum(k for w, k in counts.items() if len(w) > 20) * per_word, len(counts) * per_word,
        max(counts.values(), default=0) * per_word, sum(map(str.isupper, text)) * per_char if upper else 0.0, sum(text.count(d) for d in "0123456789") * per_char, 1 - sum(len(w) * k for w, k in counts.items()) * per_char,
        min(len(marks) * per_char * 4, 1), min(len(set(marks)) / 10, 1), min(text.count("|") * per_word, 1), ends * per_word, upper * per_word,
        sum(a == b for a, b in zip(words, words[1:])) * per_word, math.log1p(len(lines)) / 10, len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 10, min((text.count(".") + text.count(",")) * per_word, 1),
    ]
    index = np.fromiter(plain.keys(), dtype=np.int32, count=len(plain))
    value = np.log1p(np.fromiter(plain.values(), dtype=np.float64, count=len(plain)))
    value /= max(float(np.sqrt((value * value).sum())), 1e-9)
    return np.concatenate((index, np.arange(WORD_FEATURES, FEATURES, dtype=np.int32))), np.concatenate((value, values)).astype(np.float32)


@dataclass(frozen=True)
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        mixed = self.v[index] * value[:, None]
        z = self.w0 + float(self.w[index] @ value) + 0.5 * float((mixed.sum(axis=0) ** 2 - (mixed**2).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> FactorisationMachine:
    """Adaptive gradient steps on the log loss, in a fixed order."""
    rng = np.random.default_rng(7)
    w, v = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK))
    gw, gv = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2)
    y = np.array(labels, dtype=float)
    share = float(y.mean()) if len(y) else 0.5
    w0 = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if not 0 < share < 1 or not len(y):
        return FactorisationMachine(w0, w, np.zeros_like(v))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(rows[i][0]) for i in some])
            begin = np.cumsum(sizes) - sizes
            index, x = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some]).astype(float)
            mixed = v[index] * x[:, None]
            sums = np.add.reduceat(mixed, begin)
            z = w0 + np.add.reduceat(w[index] * x, begin) + 0.5 * (sums**2 - np.add.reduceat(mixed**2, begin)).sum(axis=1)
            error = (1 / (1 + np.exp(-z.clip(-30, 30))) - y[some]) / len(some)
            each = np.repeat(error, sizes)
            dv_rows = (each * x)[:, None] * (np.repeat(sums, sizes, axis=0) - mixed)
            used, inverse = np.unique(index, return_inverse=True)
            dw = np.bincount(inverse, weights=each * x) + DECAY * w[used]
            dv = np.stack([np.bincount(inverse, weights=dv_rows[:, f]) for f in range(RANK)], axis=1) + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            w0 -= RATE * float(error.sum())
    return FactorisationMachine(w0, w.astype(np.float32), v.astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_features: int = TRAIN_FEATURES) -> FactorisationMachine:
    """A machine for ``labels`` (doc_id, quality) of the documents (doc_id, text)."""
    scratch, id_type = Scratch(docs.sparkSession, "quality"), dict(docs.dtypes)["doc_id"]
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = [features(t) for t in part.column(0).to_pylist()]
                columns = [pa.array([len(i) for i, _ in rows], pa.int64()), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=["doc_id", "quality", "n", "index", "value"])

    found = scratch.keep(texts.select("text", "doc_id", "quality").mapInArrow(extract, f"doc_id {id_type}, quality int, n long, index binary, value binary"))
    # how far the order of hashes goes: of at most train_docs rows a number and a hash
    place, total, last = F.xxhash64("doc_id"), 0, None
    for row in sorted(found.select(place.alias("place"), "doc_id", "n").collect()):
        total += row.n
        if last is not None and total > train_features:
            break
        last = (row.place, row.doc_id)
    if last is None:
        return fit([], [])
    rows = found.where((place < last[0]) | ((place == last[0]) & (F.col("doc_id") <= last[1]))).collect()
    scratch.drop(found)
    rows.sort(key=lambda r: r.doc_id)
    return fit([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in rows], [int(r.quality > 0) for r in rows])


def score(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """One row per document: doc_id, held_out (id remainder modulo 5 is 0), score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def judge(batches):
        for batch in batches:
            scores = [shared.value.score(*features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT_FROM) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (id_remainder(5) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(judge, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of all documents by a machine learned from labels whose id remainder modulo 5 is not 0."""
    return score(docs, learn(docs, labels.where(id_remainder(5) != 0)))
