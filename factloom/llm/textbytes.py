"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and 9 to 13, with A-Z lower-cased.
All these bytes are ASCII, so UTF-8 texts can be cut there without decoding.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        both = []
        for base in (_P, _INV):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        if size > 1 << 21:
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def solid(data: np.ndarray) -> np.ndarray:
    """Whether each byte is part of a word."""
    return _SOLID[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each text.

    ``offsets`` has one more entry than there are texts; so has the third
    result. Texts lie one after another; a word never spans two texts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _SOLID[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text.

    A text of 1 to k-1 words has one shingle, its whole sequence (marked by its
    length); a text without words has none.
    """
    odd = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & (1 << 64) - 1 | 1) for i in range(1, k + 1)]
    n = len(words)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        full += words[i : i + len(full)] * odd[i]
    full = mix64(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        m = b - a
        if m >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif m:
            h = np.full(1, m, np.uint64)
            for i in range(m):
                h += words[a + i : a + i + 1] * odd[i]
            out.append(mix64(h * np.uint64(3) + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
