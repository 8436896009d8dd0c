"""Extensions for streams: page windows of arriving documents and counts of arriving events.

Every function takes a streaming (or plain) DataFrame and returns one; the
caller picks sink, trigger and checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.windows import page_windows


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, files_a_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def arriving_windows(docs: DataFrame, doc_id: str, text: str, size: int = 50, overlap: int = 10, min_chars: int = 100, split: str = "\n") -> DataFrame:
    """W01 over a stream: stateless, each document becomes its windows in the batch it comes with."""
    pages = docs.select(doc_id, F.split(text, split).alias("pages"))
    return page_windows(pages, doc_id=doc_id, size=size, overlap=overlap, min_chars=min_chars)


def first_arrivals(docs: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Documents whose key has not come within the watermark; state older than ``late`` is forgotten."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Events of each kind (and the sum of ``value``) in tumbling windows; rows later than ``late`` are left out of closed windows."""
    sums = [F.sum(value).alias("total")] if value else []
    got = events.withWatermark(time, late).groupBy(F.window(time, width).alias("_w"), by).agg(F.count(F.lit(1)).alias("n"), *sums)
    return got.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), by, "n", *(["total"] if value else []))
