"""Dates and quarters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_after(d: Column, today: str) -> Column:
    """Dates after ``today`` were read into the wrong century and move back by 100 years."""
    return F.when(d > F.lit(today).cast("date"), F.add_months(d, -1200)).otherwise(d)


def gold_quarters(dates: Column) -> Column:
    """P10: 'YYYY-QN', 'YYYY-MM' or 'YYYY-MM-DD' entries as a sorted array of distinct quarters.

    Other entries and nulls are dropped; a null array stays null.
    """

    def quarter(x: Column) -> Column:
        month = F.substring(x, 6, 2).try_cast("int")
        by_month = F.concat(F.substring(x, 1, 4), F.lit("-Q"), F.ceil(month / 3).cast("string"))
        dated = x.rlike(r"^\d{4}-\d{2}(-\d{2})?$") & month.between(1, 12)
        return F.when(x.rlike(r"^\d{4}-Q[1-4]$"), x).when(dated, by_month)

    return F.array_sort(F.array_distinct(F.filter(F.transform(dates, quarter), lambda q: q.isNotNull())))
