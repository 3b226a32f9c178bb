"""Periodic runs against a scan of every period, and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np

from inkwell.llm import runs
from inkwell.llm.queries import op11_runs

SCHEMA = "doc_id long, text string, runs string, start int, collapsed int"


def scanned(words, min_length=12):
    """(start, length, period) of all runs, by following every period through the whole document."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            begin = i
            while i < len(words) - p and words[i] == words[i + p]:
                i += 1
            if i - begin + p >= max(min_length, 2 * p):
                found.setdefault((begin, i - begin + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def words_of(r):
    words = [r.randrange(r.choice([1, 2, 3, 10, 100])) for _ in range(r.choice([0, 1, 11, 12, 30, 100, 400]))]
    if words and r.random() < 0.6:
        a = r.randrange(len(words))
        p = 1 + (len(words) - a) // (3 + r.randrange(8))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_every_pair_of_residues_meets_in_the_cover():
    assert len(runs.SHIFTS) == runs.MODULUS**2 and runs.SHIFTS.max() < runs.MODULUS
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))


def test_extensions_equal_comparing():
    r = random.Random(2)
    for _ in range(30):
        words = np.array(words_of(r) + [500] + words_of(r) + [501])
        pairs = np.array([(i, j) for i in range(len(words)) for j in r.sample(range(len(words)), min(6, len(words))) if i != j]).T
        assert (runs.Extensions(words).of(*pairs) == runs.agreeing(words, *pairs, np.full(pairs.shape[1], len(words)))).all()


def test_runs_equal_a_scan(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS_AT_ONCE", 500)
    r = random.Random(1)
    for _ in range(150):
        documents = [words_of(r) for _ in range(r.randrange(1, 8))]
        got = [[] for _ in documents]
        for d, *run in zip(*(x.tolist() for x in runs.find_runs([np.array(d, dtype=np.int64) for d in documents]))):
            got[d].append(tuple(run))
        assert got == [scanned(d) for d in documents]


def test_a_long_document():
    r = random.Random(7)
    words = [r.randrange(2000) for _ in range(200_000)]
    words = [w if i < 30_000 else words[30_000 + (i - 30_000) % 41_000] for i, w in enumerate(words)]
    assert [x.tolist() for x in runs.find_runs([np.array(words)])] == [[0], [30_000], [170_000], [41_000]]


def by_hand(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = scanned(words)
    top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_run_digests(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(f"é{r.randrange(6)}" for _ in range(r.randrange(80)))) for i in range(300)]
    rows += [(i, f" \t{'ab ' * 40}\n\x0b{'c d e ' * (i % 9)} x ") for i in range(300, 380)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "a b " * 9), (7, "x y " * 8), (7, "x y " * 8), (2000, "z" * 100_000), (2001, "long " * 50_000)]
    spark.createDataFrame([(*x, "r", 1, 2) for x in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_runs(spark, f"file://{tmp_path}").collect()
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = sorted((str(k), *map(str, by_hand(k, t))) for k, t in rows if k != 2001)
    assert sorted((str(g.doc_id), *[str(g[c]) for c in columns]) for g in got if g.doc_id != 2001) == expected
    (row,) = [g for g in got if g.doc_id == 2001]
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 50_000, 1, 50_000_000)


def test_no_documents(spark):
    assert runs.run_digests(runs.periodic_runs(runs.with_periodic_tails(spark.createDataFrame([], SCHEMA)))).count() == 0
