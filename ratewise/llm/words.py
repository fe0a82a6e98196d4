"""Vectorised word hashing over the UTF-8 bytes of a text.

A word is a run of bytes other than space and \\x09-\\x0D.  All words of a text
are hashed together: a running sum of byte codes times powers of an odd base
(arithmetic modulo 2**64) gives every word's polynomial by one subtraction, and
the inverse power moves it to a common origin.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random-looking 64-bit code per byte value, so short words differ in all bits.
_CODE = np.array([pow(2 * b + 3, 0x1234567, (1 << 64) - 59) for b in range(256)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    forward = np.full(_PIECE, _BASE, np.uint64)
    back = np.full(_PIECE, _INVERSE, np.uint64)
    forward[0] = back[0] = 1
    return np.multiply.accumulate(forward), np.multiply.accumulate(back)


def _power(base: int, exponent: int) -> np.uint64:
    return np.uint64(pow(base, exponent, 1 << 64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in a byte array."""
    edge = np.ones(len(data) + 2, bool)
    np.take(_SPACE, data, out=edge[1:-1])
    change = np.flatnonzero(edge[1:] != edge[:-1])  # into a word and out of it in turn
    return change[::2], change[1::2]


def lowered(text: str | None) -> np.ndarray:
    """UTF-8 bytes of a text with A-Z lower-cased; NULL is empty.

    A lone surrogate, which UTF-8 can't hold, becomes '?'.
    """
    return _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]


def word_hashes(data: np.ndarray, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of each word, in order (``bounds`` if the words' bounds are known)."""
    starts, ends = bounds or word_bounds(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    forward, back = _powers()
    total = np.zeros(n + 1, np.uint64)
    for lo in range(0, n, _PIECE):
        hi = min(lo + _PIECE, n)
        part = np.multiply(_CODE[data[lo:hi]], forward[:hi - lo], out=total[lo + 1:hi + 1])
        if lo:
            part *= _power(_BASE, lo)
    np.add.accumulate(total, out=total)
    raw = total[ends] - total[starts]
    origin = back[starts % _PIECE]
    if n > _PIECE:
        jump = np.array([pow(_INVERSE, int(k) * _PIECE, 1 << 64) for k in range(n // _PIECE + 1)], np.uint64)
        origin = origin * jump[starts // _PIECE]
    return mix(raw * origin + (ends - starts).astype(np.uint64))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles.

    Fewer words make one shingle of the whole sequence; no words make none.
    """
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_BASE) + hashes[k:len(hashes) - width + 1 + k])
    return np.unique(out)
