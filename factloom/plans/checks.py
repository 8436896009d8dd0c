"""Queries of checks and of assembled manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import checks
from factloom.plans import register
from factloom.plans.corpus import CHUNKS_SQL, chunks_of, table
from factloom.sources import files

CHECKS_SQL = rf"""{CHUNKS_SQL}, one AS (SELECT count(*) AS n, count(*) FILTER (length(text) <= 100) AS a, count(*) FILTER (approx_tokens > 2000) AS b, count(*) FILTER (trim(text) = '') AS c, count(*) FILTER (regexp_matches(text, '[\x01-\x08\x0b\x0c\x0e-\x1f]')) AS d, count(*) FILTER (end_page < start_page) AS e FROM chunks),
ends AS (SELECT doc_id, min(start_page) AS a, max(end_page) AS z, count(*) - count(DISTINCT chunk_id) AS t FROM chunks GROUP BY 1), two AS (SELECT count(*) AS n, count(*) FILTER (a <> 1) AS f, count(*) FILTER (z < len(p)) AS g, count(*) FILTER (t > 0) AS h FROM pages JOIN ends USING (doc_id)),
told AS (SELECT unnest(['no short chunk', 'token budget', 'no chunk without text', 'no control characters', 'pages in order']) AS name, unnest([a, b, c, d, e]) AS n_broken, n AS n_rows FROM one
 UNION ALL SELECT unnest(['starts at page 1', 'reaches the last page', 'no repeated chunk id']), unnest([f, g, h]), n FROM two)"""


@register("chunk_checks", f"WITH {CHECKS_SQL} SELECT *, CASE WHEN n_broken = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM told")
def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_pages"))
    return checks.chunk_checks(chunks_of(spark, sf_dir), docs, "doc_id", "n_pages", max_tokens=2000)


@register("worst_status", f"WITH {CHECKS_SQL} SELECT CASE WHEN count(*) FILTER (n_broken > 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS overall, count(*) FILTER (n_broken = 0) AS n_pass, 0::BIGINT AS n_warn, count(*) FILTER (n_broken > 0) AS n_fail FROM told")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.worst_status(chunk_checks(spark, sf_dir))


@register("success_rates", """SELECT source, count(*) AS n_docs, round(avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0.0 END), 9) AS success, round(count(*) FILTER (n_chars > 200 AND lang = 'de') / nullif(count(*) FILTER (n_chars > 200), 0), 9) AS ocr_rate,
 CASE WHEN avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0.0 END) >= 0.95 THEN 'PASS' WHEN avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0.0 END) >= 0.85 THEN 'WARN' ELSE 'FAIL' END AS status FROM documents GROUP BY 1""")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("pages"), F.coalesce(F.col("lang") == "de", F.lit(False)).alias("ocr"))
    got = checks.success_rates(rows, "source", "pages", "ocr").withColumn("status", checks.graded(F.col("success"), 0.95, 0.85))
    return got.withColumn("success", F.round("success", 9)).withColumn("ocr_rate", F.round("ocr_rate", 9))


@register("null_counts", """SELECT unnest(['text', 'lang', 'source']) AS column_name, unnest([count(*) FILTER (text IS NULL), count(*) FILTER (lang IS NULL), count(*) FILTER (source IS NULL)]) AS n_null FROM documents""")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.null_counts(table(spark, sf_dir, "documents"), "text", "lang", "source")


@register("repeated_rows", """SELECT p_name, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_rows(table(spark, sf_dir, "part"), "p_name", "p_size")


@register("name_difference", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'first' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'second' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def name_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return checks.name_difference(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "k")


@register("mixed_labels", """SELECT l_orderkey AS orderkey, string_agg(DISTINCT l_returnflag, ' + ' ORDER BY l_returnflag) AS labels, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS n_labels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def mixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.mixed_labels(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "orderkey"), "orderkey", "l_returnflag")


@register("modal_labels", """WITH n AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) SELECT p AS modal, count(*) AS n FROM n WHERE r = 1 GROUP BY 1""")
def modal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.mode("o_orderpriority", True).alias("modal"))
    return modes.groupBy("modal").agg(F.count(F.lit(1)).alias("n"))


@register("boundary_rows", """WITH r AS (SELECT o_orderpriority AS p, o_orderstatus AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY year(o_orderdate), o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY year(o_orderdate) DESC, o_orderkey) AS z FROM orders)
SELECT p, s, 'earliest' AS which, k FROM r WHERE a = 1 UNION ALL SELECT p, s, 'latest', k FROM r WHERE z = 1""")
def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("k"))
    return checks.boundary_rows(rows, ["p", "s"], "y", "k")


@register("page_sample", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(p[1]) AS first_page, length(p[CAST(ceil(len(p) / 2) AS INTEGER)]) AS middle_page, length(p[len(p)]) AS last_page FROM p""")
def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", checks.page_sample(F.split("text", "\n")).alias("s"))
    return rows.select("doc_id", *[F.length(F.col("s")[i]).alias(f"{n}_page") for i, n in enumerate(("first", "middle", "last"))])


@register("disagreements", """SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND (quality = 1) <> (toxic = 1)""")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(checks.disagreement(F.col("quality"), F.col("toxic"))).select("doc_id")


@register("latest_events", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@register("percent_of_total", """SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY 1, 2""")
def percent_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.percent_of_total(table(spark, sf_dir, "documents"), "lang", "source").withColumn("share", F.round("share", 9))


@register("assembled_body", """WITH m AS (SELECT 'c' || c_nationkey AS country, c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'manual_pending' ELSE 'auto' END AS st FROM customer WHERE c_custkey % 3 <> 0), e AS (SELECT 'c' || c_nationkey AS country, c_custkey AS id, c_mktsegment AS series, c_custkey % 4 AS n FROM customer WHERE c_custkey % 5 <> 0)
SELECT country, m.id AS package_id, NULL AS body, coalesce(CAST(n AS INTEGER), 0) AS n_pages, CASE WHEN n > 0 AND st = 'manual_pending' THEN 'manual_ready' ELSE st END AS access_status FROM m LEFT JOIN e USING (country, id)
UNION ALL SELECT country, id, 'ORPHAN: ' || series, CAST(n AS INTEGER), 'orphan' FROM e WHERE id % 3 = 0""")
def assembled_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("country"), F.col("c_custkey").alias("package_id"), F.col("c_mktsegment").alias("series"))
    k = F.col("package_id")
    manifest = c.filter(k % 3 != 0).select("country", "package_id", F.when(k % 2 == 0, "manual_pending").otherwise("auto").alias("access_status"))
    extracted = c.filter(k % 5 != 0).select("country", "package_id", "series", F.lit(2000).alias("year"), F.lit("x").alias("path"), F.array_repeat(F.lit("p"), (k % 4).cast("int")).alias("pages"))
    return files.assembled(manifest, extracted).select("country", "package_id", "body", "n_pages", "access_status")


@register("to_extract", """SELECT page_id FROM pages WHERE url IS NOT NULL AND page_id % 3 <> 0""")
def to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("#", "url", "page_id").alias("pdf_url"))
    cache = p.filter("page_id % 3 <> 1").select(F.md5("pdf_url").alias("url_md5"), F.when(F.col("page_id") % 3 == 0, 1).alias("n_pages_ocr"))
    return files.to_extract(p, cache).select("page_id")
