"""Unit vectors and class centres."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    d = v.cast("array<double>")
    norm = F.sqrt(dot(d, d))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def class_centres(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label: (label, position, value)."""
    return rows.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("value"))


#: Lots of points, of which every two meet in a task, as long as they are not too large; points of a lot at most.
LOTS, LOT = 16, 1 << 15


def lots_for(n: int, block: int) -> int:
    """How many lots ``n`` points are dealt to: about ``LOTS``, of ``block`` points at least and ``LOT`` at most."""
    return max(1, math.ceil(n / max(block, min(LOT, math.ceil(n / LOTS)))))


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all of ``y``; that of two rows is the same whichever others there are."""
    d = np.zeros((len(x), len(y)))
    if x.shape[1] <= 16:
        for a, b in zip(x.T, y.T):
            gap = a[:, None] - b[None, :]
            gap *= gap
            d += gap
    else:
        gap = np.empty(y.shape)
        for i, row in enumerate(x):
            np.subtract(y, row, out=gap)
            np.einsum("ij,ij->i", gap, gap, out=d[i])
    return np.sqrt(d, out=d)


def sides(x: np.ndarray, measure: str, reach: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Left and right factors of scores that fall as distances rise: the cosine of unit vectors, else minus half the squared distance.

    Of more than 16 dimensions in single precision: scores find the pairs that
    matter, ``pair_distances`` gives their distances. ``reach`` is the greatest length.
    """
    kind = np.float32 if x.shape[1] > 16 and reach < 1e9 else np.float64
    if measure == "cosine":
        return (x.astype(kind),) * 2
    half, one = -0.5 * np.einsum("ij,ij->i", x, x), np.ones(len(x))
    return np.column_stack([x, half, one]).astype(kind), np.column_stack([x, one, half]).astype(kind)


def slack(width: int, measure: str, reach: float = 1.0) -> float:
    """How far a score of ``sides`` may be off, with room for distances rounded to 12 digits."""
    eps = float(np.finfo(np.float32 if width > 16 and reach < 1e9 else np.float64).eps)
    longest = 1.0 if measure == "cosine" else reach**2 + reach**4 / 4 + 1
    return (width + 10) * eps * longest + 1e-11 * (1 + reach)


def score(d: np.ndarray, measure: str) -> np.ndarray:
    """The score of a distance."""
    return 1 - d if measure == "cosine" else -0.5 * d * d


def cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells of a mask that has few; eight cells are looked at in one."""
    flat = mask.ravel()
    if flat.size % 8 or not flat.size:
        return np.nonzero(mask)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[flat[at]], mask.shape[1])


def pair_values(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, measure: str) -> np.ndarray:
    """Cosine or distance of the pairs of rows ``r`` of ``x`` and ``c`` of ``y``."""
    out = np.empty(len(r))
    for lo in range(0, len(r), 1 << 15):
        p, q = x[r[lo : lo + (1 << 15)]], y[c[lo : lo + (1 << 15)]]
        if measure != "cosine":
            p = q = p - q
        out[lo : lo + len(p)] = np.einsum("ij,ij->i", p, q)
    return out if measure == "cosine" else np.sqrt(out)


def pair_distances(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, measure: str) -> np.ndarray:
    """Distances (1 - cosine, or of the vectors as they are) of such pairs, to 12 digits."""
    v = pair_values(x, y, r, c, measure)
    return np.round(np.maximum(1 - v, 0.0) if measure == "cosine" else v, 12)
