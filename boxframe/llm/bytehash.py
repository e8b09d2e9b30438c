"""Polynomial hashes of many substrings of a byte buffer at once, in numpy.

With b[i] the bytes (plus one) and P the prefix sums of b[i] * BASE**i modulo 2**64, the hash of [s, e) is
(P[e] - P[s]) * BASE**-s, which depends on the bytes only.
"""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _Tables(dict):
    """A cache that travels empty."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.ones(1, np.uint64)
        while len(t) < n:
            t = np.concatenate([t, t * np.uint64(pow(base, len(t), 1 << 64))])
        _tables[base] = t
    return t[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """The prefix sums P of a uint8 array; one longer than it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash's high bits, where the polynomial is strong, over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    return mix((p[end] - p[start]) * powers(INVERSE, len(p))[start])


def grams(p: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all substrings of q bytes."""
    n = len(p) - q
    return mix((p[q:] - p[:n]) * powers(INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)
