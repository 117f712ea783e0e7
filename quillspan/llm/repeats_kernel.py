"""Numpy kernels of the suffix index: content-chosen suffixes and their fingerprints.

Symbols of many documents are handled together in one buffer: their bytes, or fingerprints of their
words.  ``match`` is the length of the strings that are looked for.  Each start s of such a string picks
a suffix that begins in [s, s + window): the leftmost one with the smallest hash of its first symbols.
Equal strings pick suffixes at equal places in them, so only picked suffixes need an index, and two equal
strings have picked suffixes that agree for at least ``match - window + 1`` symbols (the depth).
"""

from __future__ import annotations

import numpy as np

WINDOW = 128
# a value of Spark has fewer bytes than 2**31
POS_BITS = 31
BYTES, WORDS = 0, 1
_POS = np.uint64((1 << POS_BITS) - 1)
_rng = np.random.default_rng(20260101)
_TABLES = _rng.integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_cache: dict = {}


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2**64, for n places at least."""
    if _cache.get("n", 0) < n:
        n = max(n, 1 << 20)
        out = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, b, dtype=np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            out.append(tuple(pair))
        _cache.update(n=n, powers=out)
    return _cache["powers"]


def window_of(match: int) -> int:
    return min(WINDOW, match // 2)


def depth_of(match: int) -> int:
    return match - window_of(match) + 1


def symbols(data: np.ndarray, offsets: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of documents laid end to end, and their n + 1 bounds: the bytes, or fingerprints of the words.

    Words are runs of bytes other than space and 0x09 to 0x0D, as they are.
    """
    if unit == BYTES:
        return data, offsets
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return Prints(data, (0,)).of(starts, ends).view(np.uint64), np.searchsorted(starts, offsets)


class Prints:
    """Fingerprints of any range of symbols of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: tuple[int, ...] = (0, 1)):
        powers = _powers(len(data) + 1)
        self.parts = []
        for k in which:
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            values = _TABLES[k][data] if data.dtype == np.uint8 else _mixed(data ^ _TABLES[k][0])
            np.cumsum(values * powers[k][0][: len(data)], out=sums[1:])
            self.parts.append((sums, powers[k][1]))

    def of(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        sums, inverse = self.parts[k]
        x = (sums[end] - sums[start]) * inverse[start]
        x ^= x >> np.uint64(31)
        return (x * _M2).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    return x


def picks(data: np.ndarray, offsets: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """Runs of starts that pick the same suffix: document index, first start, last start, suffix.

    data holds the symbols of documents end to end, offsets their n + 1 bounds; all places are in data.
    """
    none = np.empty(0, dtype=np.int64)
    sizes = np.diff(offsets)
    docs = np.flatnonzero(sizes >= match)
    if not len(docs):
        return none, none, none, none
    n = len(data)
    window = window_of(match)
    padded = np.concatenate([data, np.zeros(8 + window, dtype=data.dtype)])
    if data.dtype == np.uint8:
        heads = np.ndarray(shape=(n + window,), dtype="<u8", buffer=padded, strides=(1,))
    else:
        heads = _mixed(padded[: n + window]) + padded[1 : n + window + 1]
    key = _mixed(heads)
    key ^= key >> np.uint64(32)
    key *= _M1
    key &= ~_POS
    key |= np.arange(n + window, dtype=np.uint64)
    step = 1
    while step < window:
        ahead = min(step, window - step)
        key = np.minimum(key[: len(key) - ahead], key[ahead:])
        step += ahead
    counts = sizes[docs] - match + 1
    first = np.cumsum(counts) - counts
    starts = np.repeat(offsets[docs] - first, counts) + np.arange(int(counts.sum()))
    picked = (key[starts] & _POS).astype(np.int64)
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    np.not_equal(picked[1:], picked[:-1], out=new[1:])
    new[first] = True
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(starts)) - 1
    return docs[np.searchsorted(first, lo, side="right") - 1], starts[lo], starts[hi], picked[lo]
