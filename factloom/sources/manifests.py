"""Manifests of documents to fetch and identifiers in their paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def yearly(spark: SparkSession, first: int, last: int, template: str, body: str) -> DataFrame:
    """A row for each year with its address by a printf template of the year (``%1$d``)."""
    year = F.col("id").cast("int")
    return spark.range(first, last + 1).select(year.alias("year"), F.lit(None).cast("int").alias("part"), F.lit(body).alias("body"), F.format_string(template, year).alias("url"))


def yearly_parts(spark: SparkSession, first: int, last: int, parts: range, template: str, body: str, base: int = 0) -> DataFrame:
    """A row for each year and part; the template takes the year, the part and the volume (year - ``base``)."""
    rows = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(parts.start), F.lit(parts.stop - 1))).alias("part"))
    url = F.format_string(template, "year", "part", (F.col("year") - base).cast("int"))
    return rows.select("year", "part", F.lit(body).alias("body"), url.alias("url"))


def consolidated(manifests: list[DataFrame], first: int, last: int) -> DataFrame:
    """All manifests with years in first..last."""
    return reduce(DataFrame.unionByName, manifests).filter(F.col("year").between(first, last))


def path_year(series: Column, stem: Column) -> Column:
    """Year in a file's stem by the rule of its series; null if the stem breaks it."""
    rules = {
        "yearly": r"^(\d{4})$",
        "bilingual": r"^(\d{4})(?:_bm)?$",
        "plan": r"^rmk\d{2}_(?:plan|mtr)_(\d{4})$",
        "package": r"^[a-z][a-z_]*?_(\d{4})$",
    }
    out = F.lit(None).cast("string")
    for name, rule in rules.items():
        out = F.when(series == name, F.nullif(F.regexp_extract(stem, rule, 1), F.lit(""))).otherwise(out)
    return out.cast("int")
