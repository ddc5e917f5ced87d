"""Vectorised word and shingle hashing over batches of texts (numpy, inside tasks).

Words are maximal runs without ASCII white space, lower case. All arithmetic is modulo 2**64.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_POW = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**0..p**(n-1) and their inverses modulo 2**64."""
    if _POW.get("n", -1) < n:
        size = 1 << max(12, int(n).bit_length())
        for key, base in (("p", _P), ("q", _P_INV)):
            out = np.ones(size, np.uint64)
            done, step = 1, np.uint64(base)
            while done < size:  # doubling
                m = min(done, size - done)
                np.multiply(out[:m], step, out=out[done:done + m])
                done += m
                step = np.uint64((int(step) ** 2) % 2**64)
            _POW[key] = out
        _POW["n"] = size
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array and the n + 1 row offsets into them (null: empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if len(texts) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(texts.buffers()[2], np.uint8, off[-1] - off[0], off[0]), off - off[0]


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the n + 1 offsets of the rows into them."""
    data, off = utf8_bytes(pc.utf8_lower(texts) if lower else texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = off[:-1][off[:-1] < n]
    starts[firsts] = inside[firsts]  # a row begins a new word
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = off[1:][off[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    p, q = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:n], out=total[1:])
    return mix((total[e] - total[s]) * q[s]), np.searchsorted(s, off)


def shingle_hashes(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word shingle in order (repeats kept) and the row offsets.

    A text of 1 to size - 1 words has one shingle, all of its words; a text without words has none.
    """
    h, off = word_hashes(texts)
    return shingles_of_words(h, off, size)


def shingles_of_words(h: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(off)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.zeros(len(h), np.uint64)
    factor = 1
    for j in range(min(size, len(h))):
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        out[:len(h) - j] += h[j:] * np.uint64(factor)
    short = np.flatnonzero((n > 0) & (n < size))
    for i in short.tolist():  # rare
        v, factor = 0, 1
        for w in h[off[i]:off[i + 1]].tolist():
            factor = factor * 0xD6E8FEB86659FD93 % 2**64
            v = (v + w * factor) % 2**64
        out[off[i]] = v ^ int(n[i])
    new = np.zeros(len(off), np.int64)
    np.cumsum(count, out=new[1:])
    keep = np.arange(new[-1], dtype=np.int64) + np.repeat(off[:-1] - new[:-1], count)
    return mix(out[keep]), new


def distinct_per_row(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, offsets): within each row the distinct hashes, ascending, and how often each occurs."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))
    order = np.lexsort((h, row)) if len(h) else np.zeros(0, np.int64)
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    new = np.searchsorted(row[at], np.arange(len(off)))
    return h[at], np.diff(np.append(at, len(h))), new
