"""Features of pages, paragraphs and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features(text: Column, keys: tuple[str, ...]) -> dict[str, Column]:
    """Tokens (runs of non-blanks), whole numbers, and 1 if a keyword occurs, ignoring case. Null text gives nulls."""
    return {
        "n_tokens": F.regexp_count(text, F.lit(r"\S+")).cast("long"),
        "n_numbers": F.regexp_count(text, F.lit(r"\b\d+\b")).cast("long"),
        "relevant": F.lower(text).rlike(r"\b(" + "|".join(keys) + r")\b").cast("int"),
    }


def page_features(docs: DataFrame, pages: str, keys: tuple[str, ...], *keep: str) -> DataFrame:
    """A row for each page with its number from 1. Tokens are runs of non-blanks; punctuation is no token of its own."""
    rows = docs.select(*keep, F.posexplode(pages).alias("_pos", "text"))
    return rows.select(*keep, (F.col("_pos") + 1).cast("int").alias("page_number"), "text", *[c.alias(n) for n, c in features(F.col("text"), keys).items()])


def paragraph_features(docs: DataFrame, by: str, text: str, keys: tuple[str, ...], rule: str = r"\n\s*\n") -> DataFrame:
    """A row for each lower-cased paragraph that is not empty; ``is_duplicate`` is 1 if its document repeats it."""
    rows = docs.select(by, F.posexplode(F.split(F.lower(text), rule)).alias("_pos", "paragraph")).filter(F.length("paragraph") > 0)
    n = F.count(F.lit(1)).over(Window.partitionBy(by, "paragraph"))
    made = [c.alias(k) for k, c in features(F.col("paragraph"), keys).items()]
    return rows.select(by, (F.col("_pos") + 1).cast("int").alias("paragraph_number"), "paragraph", *made, (n > 1).cast("int").alias("is_duplicate"))


def relevant_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """P25: paragraphs with a keyword that are not repeated and less than half numbers."""
    return paragraphs.filter((F.col("relevant") == 1) & (F.col("is_duplicate") == 0) & (F.col("n_numbers") < 0.5 * F.col("n_tokens")))


def document_texts(pages: DataFrame, by: str, number: str, text: str) -> DataFrame:
    """Pages of a document joined by spaces in order, and the tokens of the whole."""
    ordered = F.array_sort(F.collect_list(F.struct(number, text)))
    joined = pages.groupBy(by).agg(F.array_join(F.transform(ordered, lambda p: p[text]), " ").alias("text"))
    return joined.withColumn("n_tokens", F.regexp_count("text", F.lit(r"\S+")).cast("long"))


def mentions(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Q15: matches of each named pattern over all rows, and rows with one."""
    counts = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for k, p in patterns.items()])).alias("_x")
    return rows.select(counts).groupBy(F.col("_x.pattern").alias("pattern")).agg(F.sum("_x.n").alias("n_matches"), F.count_if(F.col("_x.n") > 0).alias("n_rows"))


def covered(chunks: DataFrame, docs: DataFrame, by: str, n_pages: str) -> DataFrame:
    """Q21: whether the windows of a document begin at page 1 and reach its last page."""
    ends = chunks.groupBy(by).agg(F.min("start_page").alias("first_page"), F.max("end_page").alias("last_page"))
    return docs.select(by, n_pages).join(ends, by).withColumn("covered", (F.col("first_page") == 1) & (F.col("last_page") >= F.col(n_pages)))
