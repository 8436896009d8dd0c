"""Plain Jaro similarity (no prefix bonus) as an Arrow UDF."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=200_000)
def jaro_similarity(a: str, b: str) -> float:
    """Jaro similarity; two empty strings are 1, one empty string 0."""
    if a == b:
        return 1.0
    m, n = len(a), len(b)
    if not m or not n:
        return 0.0
    reach = max(0, max(m, n) // 2 - 1)
    free, mine = [True] * n, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, f in zip(b, free) if not f]
    k, t = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    return (k / m + k / n + (k - t) / k) / 3


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity of two string columns; null if either is null."""

    @F.pandas_udf(T.DoubleType())
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_similarity(p, q) for p, q in zip(x, y)], dtype="float64")

    return udf(a, b)
