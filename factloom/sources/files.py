"""Files on disk, their manifests, caches and exports."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.manifests import path_year

#: Columns that every manifest has, with what they hold where a manifest lacks them.
DEFAULTS = {"doc_language": "en", "access_status": "auto", "local_path": None, "notes": None}


def with_defaults(manifest: DataFrame) -> DataFrame:
    """A manifest with its missing columns added; null languages and statuses take the default too."""
    for name, value in DEFAULTS.items():
        if name not in manifest.columns:
            manifest = manifest.withColumn(name, F.lit(value).cast("string"))
        elif value is not None:
            manifest = manifest.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return manifest


def country_urls(manifests: dict[str, DataFrame], country: str | None = None) -> DataFrame:
    """Manifests of the registered countries as one table, or that of one country."""
    if country is not None and country not in manifests:
        raise ValueError(f"no manifest of {country}")
    chosen = {k: v for k, v in manifests.items() if country in (None, k)}
    stamped = [with_defaults(m).withColumn("country", F.lit(k)) for k, m in chosen.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stamped)


def direct_or_landing(direct: Column, landing: Column) -> Column:
    """The address of the file, else of its page."""
    return F.coalesce(F.nullif(direct, F.lit("")), F.nullif(landing, F.lit("")))


def listing(spark: SparkSession, base: str, suffix: str = "pdf") -> DataFrame:
    """Files one level under the series folders of ``base``, without folders that begin with ``_``.

    Only paths and sizes are read, never contents; any store that Spark reads will do.
    """
    found = spark.read.format("binaryFile").load(f"{base}/[!_]*/*.{suffix}").select("path", "length")
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return found.select("path", "length", F.element_at(parts, -2).alias("series"), stem.alias("stem"))


def discovered(files: DataFrame, first: int, last: int, rule: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Files whose year is in first..last, and those whose name has no year by the rule of their series."""
    dated = files.withColumn("year", path_year(F.col("series"), F.col("stem")) if rule is None else rule)
    return dated.filter(F.col("year").between(first, last)), dated.filter(F.col("year").isNull())


def resolved(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``manual_ready`` or ``manual_pending`` by whether ``local_path`` is among the files; rows without a path keep their status."""
    here = files.select(F.col("path").alias("local_path"), F.lit(True).alias("_here")).distinct()
    got = manifest.join(here, "local_path", "left")
    status = F.when(F.col("local_path").isNull(), F.col("access_status")).when(F.col("_here"), "manual_ready").otherwise("manual_pending")
    return got.withColumn("access_status", status).drop("_here").select(*manifest.columns)


def assembled(manifest: DataFrame, extracted: DataFrame) -> DataFrame:
    """Manifest rows with the pages of their files, and files without a row as orphans.

    Both have ``country`` and ``package_id``; ``extracted`` also ``series``,
    ``year``, ``path`` and ``pages``. A row without a file has no pages; a
    pending row with pages becomes ready.
    """
    key = ["country", "package_id"]
    pages = F.coalesce("pages", F.array().cast("array<string>"))
    found = manifest.join(extracted.select(*key, "pages"), key, "left").withColumn("pages", pages).withColumn("n_pages", F.size("pages"))
    ready = F.when((F.col("n_pages") > 0) & (F.col("access_status") == "manual_pending"), "manual_ready").otherwise(F.col("access_status"))
    lost = extracted.filter(F.col("package_id").isNotNull()).join(manifest.select(*key), key, "left_anti").select(
        *key, "year", F.concat(F.lit("ORPHAN: "), "series").alias("body"), F.lit("orphan").alias("access_status"), F.col("path").alias("local_path"), pages.alias("pages")
    )
    return found.withColumn("access_status", ready).unionByName(lost.withColumn("n_pages", F.size("pages")), allowMissingColumns=True)


def to_extract(manifest: DataFrame, cache: DataFrame, url: str = "pdf_url") -> DataFrame:
    """Rows whose address the cache lacks. Cache rows without ``n_pages_ocr`` are stale."""
    fresh = cache.filter(F.col("n_pages_ocr").isNotNull()).select(F.col("url_md5").alias("_key"))
    return manifest.filter(F.col(url).isNotNull()).join(fresh, F.md5(F.col(url)) == F.col("_key"), "left_anti")


def bound(frozen: list[DataFrame], required: list[str], key: str) -> DataFrame:
    """Frozen tables as one; an error if columns are missing or keys repeat. Rows are numbered by key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frozen)
    lacks = sorted(set(required) - set(rows.columns))
    if lacks:
        raise ValueError(f"missing columns: {', '.join(lacks)}")
    twice = rows.groupBy(key).count().filter("count > 1").select(key).limit(5).collect()
    if twice:
        raise ValueError(f"repeated {key}: {', '.join(str(r[0]) for r in twice)}")
    return rows.withColumn("cluster_id", F.row_number().over(Window.orderBy(key)))


def freeze(df: DataFrame, path: str, target: str, revision: str | None = None) -> None:
    """The table as Parquet and one JSON line beside it with name, time and revision."""
    df.write.mode("overwrite").parquet(path)
    note = json.dumps({"target": target, "frozen_at": datetime.now(timezone.utc).isoformat(), "revision": revision})
    df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def export(df: DataFrame, folder: str, labels: dict[str, str]) -> None:
    """CSV and JSON of a table and a dictionary of its columns. Nested columns are JSON text in the CSV."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.write.mode("overwrite").json(f"{folder}/json")
    words = [(c, t, labels.get(c)) for c, t in df.dtypes]
    df.sparkSession.createDataFrame(words, "variable string, type string, label string").write.mode("overwrite").option("header", True).csv(f"{folder}/dictionary")


def call_costs(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each logged call by a table of prices (model, input, output, cache_write, cache_read a million tokens); null for unknown models.

    Prices are one row a model.
    """
    n = {"input": "input_tokens", "output": "output_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens"}
    cost = sum((F.coalesce(F.col(tokens), F.lit(0)) * F.col(price) / 1e6 for price, tokens in n.items()), F.lit(0.0))
    return log.join(prices, "model", "left").withColumn("cost_usd", cost).drop(*n)
