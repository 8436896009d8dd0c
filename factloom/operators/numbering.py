"""Numbers of rows over a whole table or large groups, without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.evidence import seeded_order
from factloom.storage import written


def numbered(rows: DataFrame, seed: int, key: str, *by: str, name: str = "_k") -> DataFrame:
    """The rows with their place, from 0, in the seeded order of ``key`` within each ``by`` (or the whole table).

    The order begins with the first digits of a hash; rows are numbered within
    each of 4096 such beginnings and the counts of the earlier ones are added.
    Groups of a null ``by`` are left out.
    """
    hashed = rows.withColumn("_h", seeded_order(seed, key)).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 4096 rows in a group
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b")) - F.col("_n")).drop("_n")
    own = Window.partitionBy(*by, "_b").orderBy("_h", key)
    placed = hashed.withColumn("_r", F.row_number().over(own)).join(before, [*by, "_b"])
    return placed.withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).select(*rows.columns, name)


def in_order(rows: DataFrame, *order: str, name: str = "_k") -> DataFrame:
    """The rows with their place, from 0, in the order of some columns (together they tell rows apart).

    Rows are dealt to tasks by ranges of that order and written; each range is
    numbered by itself and the counts of the earlier ranges are added.
    """
    placed = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each task
    before = counts.select("_p", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("_p").orderBy(*order)
    numbers = placed.withColumn("_r", F.row_number().over(own)).join(F.broadcast(before), "_p")
    return numbers.withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).select(*rows.columns, name)


def first_in_order(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows; every task hands on its own first ``n`` only."""
    return rows.orderBy(*order).limit(n)
