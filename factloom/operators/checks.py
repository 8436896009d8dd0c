"""Checks of corpora, chunks and gold tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.metrics import ratio

#: From best to worst.
STATUSES = ("PASS", "WARN", "FAIL")


def graded(value: Column, passes: float, warns: float) -> Column:
    """PASS from ``passes`` on, WARN from ``warns`` on, else FAIL; null values fail."""
    return F.when(value >= passes, "PASS").when(value >= warns, "WARN").otherwise("FAIL")


def chunk_checks(chunks: DataFrame, docs: DataFrame, by: str, n_pages: str, max_tokens: int = 40000, min_chars: int = 100) -> DataFrame:
    """A row for each check of chunks: its name, how many rows break it, of how many, and PASS or FAIL.

    All checks of single chunks are one pass over them; those of documents one more over their summaries.
    """
    single = {
        "no short chunk": F.length("text") <= min_chars,
        "token budget": F.col("approx_tokens") > max_tokens,
        "no chunk without text": F.coalesce(F.trim("text"), F.lit("")) == "",
        "no control characters": F.col("text").rlike(r"[\x01-\x08\x0b\x0c\x0e-\x1f]"),
        "pages in order": F.col("end_page") < F.col("start_page"),
    }
    ends = chunks.groupBy(by).agg(F.min("start_page").alias("_a"), F.max("end_page").alias("_z"), (F.count(F.lit(1)) - F.countDistinct("chunk_id")).alias("_twice"))
    whole = {
        "starts at page 1": F.coalesce(F.col("_a") != 1, F.lit(True)),
        "reaches the last page": F.coalesce(F.col("_z") < F.col(n_pages), F.lit(True)),
        "no repeated chunk id": F.coalesce(F.col("_twice") > 0, F.lit(False)),
    }

    def told(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
        counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(rules.values())])
        items = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{i}").alias("n_broken"), F.col("_n").alias("n_rows")) for i, name in enumerate(rules)])
        return counts.select(F.inline(items))

    with_chunks = docs.filter(F.col(n_pages) > 0).select(by, n_pages).join(ends, by)
    return told(chunks, single).unionByName(told(with_chunks, whole)).withColumn("status", F.when(F.col("n_broken") == 0, "PASS").otherwise("FAIL"))


def worst_status(checks: DataFrame, status: str = "status") -> DataFrame:
    """The worst status of all checks (PASS if there are none) and the number of each."""
    place = reduce(lambda c, s: c.when(F.col(status) == s, STATUSES.index(s)), STATUSES[1:], F.when(F.col(status) == STATUSES[0], 0))
    got = checks.agg(F.coalesce(F.max(place), F.lit(0)).alias("_w"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in STATUSES])
    return got.select(F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("_w") + 1).alias("overall"), *[f"n_{s.lower()}" for s in STATUSES])


def success_rates(rows: DataFrame, by: str, pages: str, ocr: str) -> DataFrame:
    """Documents of each source, the share with pages, and among those the share read by OCR."""
    good = F.coalesce(F.col(pages) > 0, F.lit(False))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(good.cast("double")).alias("success"), ratio(F.count_if(good & F.col(ocr)), F.count_if(good)).alias("ocr_rate"))


def null_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Q06: nulls of each column."""
    got = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return got.unpivot([], list(columns), "column_name", "n_null")


def repeated_rows(rows: DataFrame, *key: str) -> DataFrame:
    """Q06: keys that occur more than once; null equals null."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def name_difference(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Q05: names of one side only, with the side."""
    one = a.select(name).filter(F.col(name).isNotNull()).distinct()
    two = b.select(name).filter(F.col(name).isNotNull()).distinct()
    return one.join(two, name, "left_anti").withColumn("side", F.lit("first")).unionByName(two.join(one, name, "left_anti").withColumn("side", F.lit("second")))


def mixed_labels(rows: DataFrame, by: str, label: str) -> DataFrame:
    """Q03: groups with several labels, joined in order by ' + '."""
    got = rows.groupBy(by).agg(F.array_sort(F.collect_set(label)).alias("_l"))
    return got.filter(F.size("_l") > 1).select(by, F.array_join("_l", " + ").alias("labels"), F.size("_l").alias("n_labels"))


def boundary_rows(rows: DataFrame, by: list[str], year: str, key: str) -> DataFrame:
    """Q08: the earliest and the latest document of each group (smallest key on ties), marked; one document may be both."""
    some = rows.filter(F.col(year).isNotNull()).groupBy(*by).agg(F.min_by(key, F.struct(F.col(year), F.col(key))).alias("_a"), F.min_by(key, F.struct(-F.col(year), F.col(key))).alias("_z"))
    ends = F.array(F.struct(F.lit("earliest").alias("which"), F.col("_a").alias(key)), F.struct(F.lit("latest").alias("which"), F.col("_z").alias(key)))
    return some.select(*by, F.inline(ends))


def page_sample(pages: Column) -> Column:
    """Q08: first, middle (ceil(n / 2)) and last page; null without pages."""
    n = F.size(pages)
    return F.when(n > 0, F.array(F.get(pages, F.lit(0)), F.get(pages, F.ceil(n / 2).cast("int") - 1), F.get(pages, n - 1)))


def disagreement(a: Column, b: Column) -> Column:
    """Q13: both known and different; texts are read as truth values first."""
    def truth(x: Column) -> Column:
        t = F.lower(F.trim(x.cast("string")))
        return F.when(t.isin("true", "t", "yes", "1"), True).when(t.isin("false", "f", "no", "0"), False)

    return F.coalesce(truth(a) != truth(b), F.lit(False))


def latest(rows: DataFrame, by: list[str], order: str, tie: str) -> DataFrame:
    """Q14: the last row of each group; the smallest tie key on ties."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last(), tie)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def percent_of_total(rows: DataFrame, *by: str) -> DataFrame:
    """Q22: rows of each group and their share of all. The total is taken over the groups, not the rows."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
