"""Canonical names, votes and summaries of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import year_in


def canonical_names(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The most frequent name of each group; among ties the longest, then the first in order."""
    n = rows.filter(F.col(name).isNotNull()).groupBy(by, name).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct(F.col(name).alias("name"), F.col("_n").alias("n")), F.struct(-F.col("_n"), -F.length(name), F.col(name)))
    return n.groupBy(by).agg(best.alias("_b")).select(by, F.col("_b.name").alias("canonical"), F.col("_b.n").alias("n_uses"))


def longest_names(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The longest name of each group (first in order on ties) and the number of distinct names."""
    distinct = rows.filter(F.col(name).isNotNull()).select(by, name).distinct()
    return distinct.groupBy(by).agg(F.min_by(name, F.struct(-F.length(name), F.col(name))).alias("canonical"), F.count(F.lit(1)).alias("n_members"))


def group_years(rows: DataFrame, by: str, name: str, doc_year: str) -> DataFrame:
    """Rounded median of the years in the names, else the most frequent (smallest on ties) document year."""
    found = F.bround(F.median(year_in(F.col(name)))).cast("int")
    return rows.groupBy(by).agg(F.coalesce(found, F.mode(F.col(doc_year), True)).alias("group_year"))


def voted(rows: DataFrame, by: str, sample: str, name: str, share: float = 0.5) -> DataFrame:
    """Names found in at least max(1, floor(share * samples)) of the group's samples, each counted once a sample."""
    votes = rows.select(by, sample, name).distinct()
    n = votes.filter(F.col(name).isNotNull()).groupBy(by, name).agg(F.count(F.lit(1)).alias("votes"))
    samples = votes.groupBy(by).agg(F.countDistinct(sample).alias("samples"))
    return n.join(samples, by).filter(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("samples") * share))).select(by, name, "votes", "samples")


def agreed_values(rows: DataFrame, by: list[str], value: str, source: str, order: str, confidence: str) -> DataFrame:
    """Median value, first source in order that is not null (the smallest on ties), and mean confidence."""
    first = F.min_by(F.col(source), F.when(F.col(source).isNotNull(), F.struct(F.col(order), F.col(source))))
    return rows.groupBy(*by).agg(F.median(value).alias("value"), first.alias("source"), F.avg(confidence).alias("confidence"))


def quantiles(rows: DataFrame, *by: str, column: str) -> DataFrame:
    """Exact 0, 25, 50, 75 and 100 % quantiles (interpolated) and the mean."""
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    named = ["lowest", "q25", "middle", "q75", "highest"]
    got = rows.groupBy(*by).agg(q.alias("_q"), F.avg(column).alias("mean"))
    return got.select(*by, *[F.col("_q")[i].alias(x) for i, x in enumerate(named)], "mean")


def z_scores(rows: DataFrame, column: str) -> DataFrame:
    """Distance from the mean of all rows in standard deviations; 0 if there is no spread.

    Mean and deviation are one row, joined to every row; no window over the whole table.
    """
    moments = rows.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.col("_s")).otherwise(F.when(F.col(column).isNotNull(), 0.0))
    return rows.crossJoin(F.broadcast(moments)).withColumn("z", z).drop("_m", "_s")


def outermost(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Key of the least and of the greatest value of each group, smallest key on ties."""
    some = rows.filter(F.col(value).isNotNull())
    return some.groupBy(by).agg(F.min_by(key, F.struct(F.col(value), F.col(key))).alias("least_key"), F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("greatest_key"))


def is_plain_paragraph(text: Column) -> Column:
    """50 to 500 words, over 200 characters, no named act with a year and no broad reform term."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    named = F.lower(text).rlike(r"\b(act|bill|law)\s+(of\s+)?\d{4}")
    return words.between(50, 500) & (F.length(text) > 200) & ~named & ~F.lower(text).rlike("tax reform|revenue act|appropriation")
