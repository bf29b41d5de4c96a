"""Vectorised word hashing: a batch of texts becomes arrays, with no Python loop over words.

Bytes go through a table of random 64-bit values; a prefix sum of value times
power gives every word's polynomial hash by one subtraction, and the same trick
over word hashes gives the hash of any run of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64, for i < n."""
    if not _POW or len(_POW[0]) < n:
        size = max(1 << 16, n + n // 8)
        out = []
        for b in (_BASE, _INV):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values (length len - n + 1, or 0)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    p, q = powers(len(values) + 1)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=c[1:])
    return mix((c[n:] - c[:-n]) * q[: len(values) - n + 1])


def chunks(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; one long text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def word_arrays(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text with the end last, bytes, word starts, word ends)."""
    enc = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    buf = np.frombuffer(b" ".join([*enc, b""]) or b" ", np.uint8)
    at = np.zeros(len(enc) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in enc], out=at[1:])
    space = _SPACE[buf]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    p, q = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    value = (_LOWER if lower else _TABLE)[buf]
    value *= p[:-1]
    np.cumsum(value, out=c[1:])
    del value
    return mix((c[ends] - c[starts]) * q[starts]), np.searchsorted(starts, at), buf, starts, ends
