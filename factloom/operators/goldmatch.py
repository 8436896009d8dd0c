"""The gold act of each name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved_gold(gold: DataFrame, name: str, act: str, *by: str, weight: str | None = None) -> DataFrame:
    """One act for each name: the most frequent, the first in order on ties. Null names and acts are left out. ``weight`` tells how often a row counts."""
    n = gold.filter(F.col(name).isNotNull() & F.col(act).isNotNull()).groupBy(*by, name, act).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    return n.groupBy(*by, name).agg(F.min_by(act, F.struct(-F.col("_n"), F.col(act))).alias(act))
