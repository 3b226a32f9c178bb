"""Vectorised hashing of words, word n-grams and byte n-grams, shared by the near-duplicate operators.

A *word* is a run of ASCII letters and digits and of non-ASCII bytes, with A-Z lowered; everything else separates
words. All hashes are 64-bit and depend only on the bytes, never on the process, so every executor agrees.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit over the whole word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers for a seed."""
    step = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix64(step + U64(seed & 0xFFFFFFFFFFFFFFFF))


_BYTE_VALUE = stream64(11, 256)
_BYTE_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IS_WORD[_lo:_hi] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many each text has."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    word = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    # Horner-free polynomial hash: prefix sums of byte * base^position, shifted back to the word's own origin.
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[buf] * _powers(_BASE, len(buf)), out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * _powers(_BASE_INV, len(buf) + 1)[starts])
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    upto = np.searchsorted(starts, bounds)
    return hashes, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-gram hashes, sorted within each text, and how many each text has.

    A text of one to n-1 words has one shingle, all its words; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    grams = np.zeros(max(len(hashes) - n + 1, 0), dtype=U64)
    for j, c in enumerate(stream64(23, n)):
        grams += hashes[j : j + len(grams)] * (c | U64(1))
    grams = mix64(grams)
    sets, sizes, at = [], np.zeros(len(texts), dtype=np.int64), 0
    for i, k in enumerate(counts.tolist()):
        if k >= n:
            s = np.unique(grams[at : at + k - n + 1])
        elif k:
            s = mix64(np.array([(hashes[at : at + k] * (stream64(29 + k, k) | U64(1))).sum(dtype=U64)], dtype=U64))
        else:
            s = grams[:0]
        sets.append(s)
        sizes[i] = len(s)
        at += k
    return (np.concatenate(sets) if sets else grams[:0]), sizes


def minhash(grams: np.ndarray, sizes: np.ndarray, n_hashes: int, seed: int = 41) -> np.ndarray:
    """Signatures, one row per text that has shingles (texts of size 0 are left out)."""
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    a, b = stream64(seed, n_hashes) | U64(1), stream64(seed + 1, n_hashes)
    out = np.empty((len(full), n_hashes), dtype=U64)
    if len(full):
        for k in range(n_hashes):
            out[:, k] = np.minimum.reduceat(grams * a[k] + b[k], begin)
    return out


def bands_for(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose recall at the threshold is enough within max_hashes."""
    best = None
    for rows in range(1, 17):
        p = threshold**rows
        bands = 1
        while bands * rows <= max_hashes and 1 - (1 - p) ** bands < recall:
            bands += 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall within max_hashes")
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    weights = stream64(57, rows) | U64(1)
    sig = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    return mix64((sig * weights).sum(axis=2, dtype=U64) + stream64(61, bands)[None, :])
