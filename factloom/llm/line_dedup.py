"""Operator 11: line dedup by levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by their 128-bit hash, in
the shared folder. Batches come from the largest ids down. Each batch becomes a
sorted run, is merge-anti-joined with the runs that are there, and what is left
(its first sightings) is added as a run of its own, so runs never share a key;
its other keys only add to their counts. A level holds one run; a second one
and it are merged, bucket by bucket, into a run of the next level. Since the
largest ids come first, the first sighting of a key is the line that stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import keyed_rows, shared_dir, written

KEY = ["h1", "h2"]
#: What is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys with at least this share of all repeated lines number at most its inverse; they are broadcast.
HOT = 4096
#: Distinct keys of a bucket of a run, about.
PER_BUCKET = 4_000_000
#: Spark's own limit of buckets.
MOST_BUCKETS = 100_000
#: Documents with a null id are one document below all others.
LOWEST = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


class LineRuns:
    """Levelled sorted runs: key, documents and lines of its first batch, and its largest document.

    The state on the driver is a list of table names; keys, counts and runs are
    in the shared folder, so the loss of an executor costs the running task only.
    """

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.levels: list[DataFrame | None] = []
        self.repeats: list[DataFrame] = []

    def _stored(self, rows: DataFrame) -> DataFrame:
        """``rows``, each bucket in one task, as a sorted run."""
        name = f"line_run_{uuid.uuid4().hex}"
        put = rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(self.spark)}/{name}")
        put.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """All runs, the largest first; no two share a key."""
        return [run for run in reversed(self.levels) if run is not None]

    def add(self, lines: DataFrame) -> DataFrame:
        """A batch of ``h1, h2, _doc`` (a row for each line, ids below those of earlier batches); returns the run of its first sightings."""
        docs = lines.groupBy(*KEY, "_doc").agg(F.count(F.lit(1)).alias("uses"))
        keys = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.sum("uses").alias("uses"), F.max("_doc").alias("top"))
        own = self._stored(keys.repartition(self.buckets, *KEY))
        older = self.runs()
        if older:
            fresh = own
            for run in older:
                fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
            new = self._stored(fresh)
            self.repeats.append(written(own.join(new.select(*KEY).hint("merge"), KEY, "left_anti").select(*KEY, "docs", "uses"), "line-repeats"))
            own = new
        self._push(own, 0)
        return own

    def _push(self, run: DataFrame, level: int) -> None:
        """Put a run on a level; two runs of a level are merged, bucket by bucket, into one of the next."""
        if level == len(self.levels):
            self.levels.append(None)
        other, self.levels[level] = self.levels[level], run
        if other is not None:
            self.levels[level] = None
            a, b = other.alias("a"), run.alias("b").hint("merge")
            values = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("docs", "uses", "top")]
            self._push(self._stored(a.join(b, KEY, "full").select(*KEY, *values)), level + 1)

    def repeated(self, least: int) -> DataFrame:
        """Keys of at least ``least`` documents: ``h1, h2, top, uses``, the largest document and the number of lines."""
        found = None
        for run in self.runs():
            found = run if found is None else found.unionByName(run)
        if found is None:
            return self.spark.createDataFrame([], "h1 long, h2 long, top long, uses long")
        more = self.spark.createDataFrame([], "h1 long, h2 long, docs long, uses long")
        for r in self.repeats:
            more = more.unionByName(r)
        more = more.groupBy(*KEY).agg(F.sum("docs").alias("_docs"), F.sum("uses").alias("_uses"))
        both = found.join(more, KEY, "left").na.fill(0, ["_docs", "_uses"])
        return both.filter(F.col("docs") + F.col("_docs") >= least).select(*KEY, "top", (F.col("uses") + F.col("_uses")).alias("uses"))


@F.pandas_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())]))
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Texts without the lines at the given places."""
    for texts, places in batches:
        rows = []
        for text, at in zip(texts, places):
            lines = (text or "").split("\n")
            gone = set() if at is None else set(at.tolist())
            kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or ""
            rows.append((len(lines), len(gone), kept))
        yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every text without the repeated lines that a larger document keeps.

    A key (a line stripped, A-Z lower-cased) of at least ``least_chars`` code
    points that at least ``least_docs`` documents hold loses all its lines but
    those of the largest document that holds it. Rows of one id are parts of one
    document: they count once and share its verdict; null ids are one document
    below all others. Null and empty texts are one empty line. Other columns are
    not carried, so none can clash; an empty table gives no rows. A very long
    text is split in one task and its lines are spread from there; only its own
    places of dropped lines come back to it.

    Lines of 128-bit hashes are compared, not texts. A key with a 4096th of all
    repeated lines or more is broadcast (there are 4096 at most), the rest meet
    in a shuffle, so that no key fills one task.
    """
    spark = docs.sparkSession
    keyed = keyed_rows(docs.select("doc_id", "text"))
    whole = keyed.select("doc_id", "_key", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("_doc"))
    shares = [i / batches for i in range(1, batches)]
    cuts = whole.agg(F.percentile_approx("_doc", shares, 1000).alias("c")).first()["c"] if shares else []
    batch = F.lit(0)
    for cut in sorted(set(cuts or [])):
        batch = batch + (F.col("_doc") < cut).cast("int")
    lines = whole.select("_doc", "_key", batch.alias("_batch"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = lines.select("*", line_key(F.col("line")).alias("k")).filter(F.char_length("k") >= least_chars)
    hashed = keys.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(11), "k").alias("h2"), "_doc", "_key", "pos", "_batch")
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    hashed.write.partitionBy("_batch").option("compression", "zstd").parquet(path)
    found = spark.read.schema(hashed.schema).parquet(path)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, min(MOST_BUCKETS, max(width, found.count() // PER_BUCKET)))
    for b in range(len(set(cuts or [])) + 1):
        runs.add(found.filter(F.col("_batch") == b))

    repeated = written(runs.repeated(least_docs), "line-repeated")
    total = repeated.agg(F.sum("uses").alias("s")).first()["s"] or 0
    is_hot = F.col("uses") * HOT >= total
    hot, rest = F.broadcast(repeated.filter(is_hot).select(*KEY, "top")), repeated.filter(~is_hot).select(*KEY, "top")
    met = found.join(hot, KEY).unionByName(found.join(hot, KEY, "left_anti").join(rest, KEY))
    places = met.filter(F.col("_doc") != F.col("top")).groupBy("_key").agg(F.collect_list("pos").alias("_places"))
    judged = whole.join(places, "_key", "left").select("doc_id", _without("text", "_places").alias("_made"))
    return judged.select("doc_id", "_made.text", "_made.n_lines", "_made.n_dropped")
