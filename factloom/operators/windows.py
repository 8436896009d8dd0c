"""Overlapping page windows and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X

#: Fixed value: what stands between the pages of a window.
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"

#: Upper edges and labels of the density bins.
DENSITY_EDGES = (0.001, 0.01, 0.03, 0.05)
DENSITY_LABELS = ("0", "(0,1%]", "(1%,3%]", "(3%,5%]", ">5%")


def page_windows(
    docs: DataFrame,
    pages: str = "pages",
    doc_id: str = "doc_id",
    size: int = 50,
    overlap: int = 10,
    min_chars: int = 100,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Windows of ``size`` pages that share ``overlap`` pages.

    Windows are numbered before those of at most ``min_chars`` characters are
    dropped, so ids may have gaps. Documents without pages give no rows. No
    shuffle: a document becomes its windows where it lies.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    n = F.size(pages)
    start = F.col("_start")
    end = F.least(start + F.lit(size - 1), F.col("_n"))
    out = (
        docs.filter(n >= 1)
        .select(doc_id, *carry, F.col(pages).alias("_pages"), n.alias("_n"), F.posexplode(F.sequence(F.lit(1), n, F.lit(size - overlap))).alias("_pos", "_start"))
        .select(
            doc_id,
            *carry,
            (F.col("_pos") + 1).cast("int").alias("chunk_id"),
            start.cast("int").alias("start_page"),
            end.cast("int").alias("end_page"),
            (end - start + 1).cast("int").alias("n_pages"),
            X.strip_controls(F.array_join(F.slice("_pages", start, F.lit(size)), PAGE_BREAK)).alias("text"),
        )
    )
    return out.filter(F.length("text") > min_chars).withColumn("approx_tokens", X.approx_tokens(F.col("text")))


def chunk_summary(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Chunk count, pages and token statistics of each document."""
    return chunks.groupBy(doc_id).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("n_pages").alias("total_pages"),
        F.sum("approx_tokens").alias("total_tokens"),
        F.avg("approx_tokens").alias("mean_tokens"),
        F.max("approx_tokens").alias("max_tokens"),
    )


def worst_chunks(chunks: DataFrame, max_tokens: int, n: int = 5) -> DataFrame:
    """The ``n`` largest chunks above the token limit."""
    over = chunks.filter(F.col("approx_tokens") > max_tokens).orderBy(F.desc("approx_tokens"), "doc_id", "chunk_id").limit(n)
    return over.select("doc_id", "chunk_id", "n_pages", "approx_tokens")


def keyword_density(text: Column, keys: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Matches of whole keywords, words, and their ratio (0 without words)."""
    hits = F.regexp_count(F.lower(text), F.lit(r"\b(" + "|".join(keys) + r")\b")).cast("long")
    words = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    return hits, words, F.coalesce(F.try_divide(hits, words), F.lit(0.0))


def density_bin(density: Column) -> Column:
    """Label of the bin; the first bin is closed on both sides."""
    out = None
    for edge, label in zip(DENSITY_EDGES, DENSITY_LABELS):
        out = F.when(density <= edge, label) if out is None else out.when(density <= edge, label)
    return out.otherwise(DENSITY_LABELS[-1])
