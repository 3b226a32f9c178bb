"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, word edges included), in order
of frequency. A document's own list is compared with each profile by the out-of-place distance: every n-gram costs the
difference of its two ranks, and the profile's length if the profile lacks it.

Profiles are learned from at most ``docs_per_language`` labelled documents of each language, chosen by a hash: the counts
of languages give each a threshold of the hash, so that a language that most documents have sends few of them to be
ordered. Counts are summed by Spark; what reaches the driver is one list of ``PROFILE_GRAMS`` for each language. Their size is
summed first: beyond ``MAX_BYTES`` learning fails, as every task holds all profiles.

Defined cases: null text, empty text and text without a letter are ``und`` with score 0; so is every text if there is
nothing to learn from; ties go to the alphabetically smaller language; documents without a language are not learned
from; repeated and null doc_ids give one row each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch

UNDETERMINED = "und"
PROFILE_GRAMS = 400
DOCUMENT_GRAMS = 300
DOCS_PER_LANGUAGE = 1000
#: Of all profiles together, at 16 bytes and its name for each n-gram of a language: about 30,000 languages.
MAX_BYTES = 256 << 20
#: Stands before a shorter n-gram in its 3 x 21 bits; no code point is as large.
_NONE = np.uint64(0x1FFFFF)
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point its lower-case form if it is a letter, else 0."""
    if not _tables:
        table = np.zeros(0x110000, dtype=np.uint64)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _tables.append(table)
    return _tables[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, in order, and their counts."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    a = np.zeros(len(codes) + 2, dtype=np.uint64)
    a[1:-1] = codes
    a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]  # one gap between words
    s = np.uint64(21)
    one = a[a != 0] | (_NONE << np.uint64(42)) | (_NONE << s)
    two = ((a[:-1] << s) | a[1:]) | (_NONE << np.uint64(42))
    three = ((a[:-2] << np.uint64(42)) | (a[1:-1] << s) | a[2:])[a[1:-1] != 0]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    return grams[np.argsort(-counts, kind="stable")[:most]]


@dataclass(frozen=True)
class Profiles:
    """For each n-gram, in order, the languages whose profile has it and its rank there."""

    languages: list[str]
    grams: np.ndarray
    begins: np.ndarray  # of each n-gram's stretch of the next two, and the end
    owners: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(languages: np.ndarray, grams: np.ndarray, ranks: np.ndarray) -> Profiles:
        """From one row for each language and n-gram."""
        names, owners = np.unique(languages.astype(str), return_inverse=True)
        grams = grams.astype(np.uint64)
        order = np.lexsort((owners, grams))
        kinds, begins = np.unique(grams[order], return_index=True)
        return Profiles(names.tolist(), kinds, np.append(begins, len(order)), owners[order].astype(np.int64), ranks[order].astype(np.int64))

    def judge(self, text: str) -> tuple[str, float, float]:
        """(language, score, lead over the second)."""
        grams, counts = gram_counts(text)
        if not len(self.languages) or not np.any((grams >> np.uint64(21)) == ((_NONE << np.uint64(21)) | _NONE)):
            return UNDETERMINED, 0.0, 0.0
        own = ranked(grams, counts, DOCUMENT_GRAMS)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        places = np.flatnonzero(self.grams[at] == own)
        begins, sizes = self.begins[at[places]], np.diff(self.begins)[at[places]]
        entry = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        # a profile that lacks an n-gram pays its length, so each one that it has saves some of that
        saved = PROFILE_GRAMS - np.abs(self.ranks[entry] - np.repeat(places, sizes))
        near = np.bincount(self.owners[entry], weights=saved, minlength=len(self.languages)) / (PROFILE_GRAMS * len(own))
        best = int(np.argmax(near))
        lead = float(near[best] - np.delete(near, best).max()) if len(near) > 1 else float(near[best])
        return self.languages[best], float(near[best]), lead


def learn_profiles(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, max_bytes: int = MAX_BYTES) -> Profiles:
    """Profiles from the columns doc_id, text and lang."""
    scratch = Scratch(labelled.sparkSession, "langid")
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    place = F.xxhash64("doc_id")
    # a share of the hashes that holds docs_per_language documents beyond doubt
    share = (docs_per_language + 10 * docs_per_language**0.5 + 50) / F.count("*")
    some = scratch.keep(rows.groupBy("lang").agg((F.least(share, F.lit(1.0)) * 2.0**64 - 2.0**63).alias("below")))

    def check(table: DataFrame) -> None:
        n_bytes = table.agg(F.sum(F.octet_length("lang") + 16)).first()[0] or 0
        if n_bytes > max_bytes:
            raise ValueError(f"{n_bytes} bytes of languages or profiles are more than a task should hold (max_bytes {max_bytes})")

    check(some)
    first = rows.select("lang", place.alias("place")).join(F.broadcast(some), "lang").where("place <= below")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("n") <= docs_per_language)
    bound = first.groupBy("lang").agg(F.max("place").alias("bound"))
    chosen = rows.withColumn("place", place).join(F.broadcast(bound), "lang").where("place <= bound")

    def count(batches):
        for batch in batches:
            sums: dict[str, dict[int, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in gram_counts(text))):
                    own[g] = own.get(g, 0) + n
            for lang, own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])

    sums = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = scratch.keep(sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE_GRAMS).select("lang", "gram", "rank"))
    check(top)
    found = top.toArrow()
    scratch.drop(top)
    return Profiles.of(*(found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "rank")))


def predict(docs: DataFrame, profiles: Profiles, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (doc_id if not given) with lang_pred, score (1 - distance / largest distance) and lead."""
    carry = ["doc_id"] if carry is None else carry
    types = dict(docs.dtypes)
    sent = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text_"))

    def judge(batches):
        for batch in batches:
            found = [profiles.judge(t) for t in batch.column(len(carry)).to_pylist()]
            new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *new], names=[*carry, "lang_pred", "score", "lead"])

    return sent.mapInArrow(judge, ", ".join(f"`{c}` {types[c]}" for c in carry) + ", lang_pred string, score double, lead double")


def id_remainder(divisor: int) -> Column:
    """crc32 of the doc_id in writing, modulo; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """Profiles learned from the documents whose id remainder modulo 4 is not 2; all documents predicted."""
    profiles = learn_profiles(docs.where(id_remainder(4) != 2))
    return predict(docs.withColumn("held_out", id_remainder(4) == 2), profiles, ["doc_id", "held_out"])


def recognised(docs: DataFrame, min_score: float = 0.1) -> DataFrame:
    """The documents whose language is told with a score of at least ``min_score``.

    Undetermined documents go, and those that share next to nothing with any learned language. If no language can be
    learned at all, every document stays.
    """
    profiles = learn_profiles(docs.where(id_remainder(4) != 2))
    if not profiles.languages:
        return docs
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    judged = predict(docs.select("text", *[F.col(c).alias(n) for c, n in names.items()]), profiles, list(names.values()))
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select(*[F.col(n).alias(c) for c, n in names.items()])
