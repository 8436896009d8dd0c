"""Hashed n-gram counts of whole texts, of bytes or of characters, for the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from factloom.llm.common import doc_runs, text_column


_LOWER = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, lower-cased where that is one code point of the first plane, and their offsets."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[start].astype(np.uint32)
    more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(lead < 0x80, lead, lead & (0x3F >> more).astype(np.uint32))
    for k in range(1, 4):
        at = np.flatnonzero(more >= k)
        point[at] = point[at] << np.uint32(6) | (data[np.minimum(start[at] + k, len(data) - 1)] & 0x3F)
    first = point < len(_LOWER)
    point[first] = _LOWER[point[first]]
    return point, np.searchsorted(start, offsets)


def hashed_counts(batch: pa.RecordBatch, bits: int, orders: tuple[int, ...], lower: bool, name: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, the hashed n-grams it holds (sorted) and their counts: of lower-cased characters, or of bytes."""
    data, offs = text_column(batch, name)
    size = 1 << bits
    for lo, hi in doc_runs(offs):
        part = data[offs[lo] : offs[hi]]
        cuts = offs[lo : hi + 1] - offs[lo]
        part, cuts = characters(part, cuts) if lower else (part.astype(np.uint32), cuts)
        cells = []
        for n in orders:
            h = np.zeros(max(0, len(part) - n + 1), np.uint32)
            for i in range(n):
                h *= np.uint32(0x01000193)
                h += part[i : i + len(h)] + np.uint32(1)
            h *= np.uint32(0x9E3779B1)
            h >>= np.uint32(32 - bits)
            cells.append(h)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mine = [c[a : b - n + 1] for n, c in zip(orders, cells) if b - a >= n]
            counts = np.bincount(np.concatenate(mine), minlength=size) if mine else np.zeros(size, np.int64)
            at = np.flatnonzero(counts)
            yield at, counts[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))
