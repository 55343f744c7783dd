"""Hashes of word shingles, vectorised over Arrow string columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# A-Z count as a-z
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_pow = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if len(_pow["p"]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            p = np.full(size, _P, np.uint64)
            q = np.full(size, np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64)
            p[0] = q[0] = 1
            _pow["p"], _pow["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pow["p"], _pow["q"]


def fmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text given as UTF-8 bytes, in order."""
    if not len(data):
        return np.empty(0, np.uint64)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    return fmix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, np.uint64(n))
    for j in range(n):
        h = h * np.uint64(0x2127599BF4325C37) + words[j : j + m] * _COEF[j]
    return fmix(h)


def shingle_set(data: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer than n words the whole sequence is one shingle."""
    words = word_hashes(data)
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of every text of an Arrow string column, without copying; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else raw[:0]
