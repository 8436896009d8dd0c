"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    redoing the work above. Every call has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return the memory that a task has freed to the system; workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the C library of Linux has it
        pass


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch (a batch holds 64 MB at most by Spark's setting)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back()

    return df.mapInArrow(each, schema)


def keyed_rows(docs: DataFrame, doc_id: str = "doc_id", key: str = "_key") -> DataFrame:
    """``docs`` with a key of each row: the id where one row alone has it, else (repeated and null ids) a number above all ids.

    Where every id is there once, nothing is written and the keys are the ids.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("_id"))
    again = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR _id IS NULL").select("_id", F.lit(True).alias("_again"))
    if again.isEmpty():
        return docs.withColumn(key, F.col(doc_id).cast("long"))
    top = ids.agg(F.max("_id").alias("m")).first()["m"]
    flagged = docs.join(again.filter("_id IS NOT NULL"), F.col(doc_id).cast("long") == F.col("_id"), "left")
    own = F.when(F.col("_again") | F.col(doc_id).isNull(), F.lit(0 if top is None else top).cast("long") + 1 + F.monotonically_increasing_id())
    return written(flagged.withColumn(key, F.coalesce(own, F.col(doc_id).cast("long"))).select(*docs.columns, key), "keyed")


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch and their offsets; null is empty."""
    col = batch.column(name)
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(col) + col.offset + 1)[col.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_runs(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts together have about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def partitions_for(spark: SparkSession, n: int, per: int) -> int:
    """Enough parts for ``n`` units at ``per`` each, at least one."""
    return max(1, -(-int(n) // per))
