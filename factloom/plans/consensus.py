"""Queries of canonical names, votes, summaries, dates and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates
from factloom.operators import consensus
from factloom.plans import register
from factloom.plans.corpus import table
from factloom.sources import manifests


@register("canonical_names", """WITH n AS (SELECT user_id, event_type AS name, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(name) DESC, name) AS r FROM n) SELECT user_id, name AS canonical, n AS n_uses FROM r WHERE r = 1""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.canonical_names(table(spark, sf_dir, "events"), "user_id", "event_type")


@register("longest_names", """WITH n AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_name IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM n)
SELECT p_brand, p_name AS canonical, n AS n_members FROM r WHERE r = 1""")
def longest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.longest_names(table(spark, sf_dir, "part"), "p_brand", "p_name")


@register("group_years", """WITH o AS (SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'Act of ' || (year(o_orderdate) + 1) ELSE o_orderpriority END AS name FROM orders),
m AS (SELECT custkey, CAST(round_even(median(CAST(nullif(regexp_extract(name, '\\b((?:19|20)\\d{2})\\b', 1), '') AS INTEGER)), 0) AS INTEGER) AS m FROM o GROUP BY 1),
n AS (SELECT custkey, y, row_number() OVER (PARTITION BY custkey ORDER BY count(*) DESC, y) AS r FROM o GROUP BY 1, 2)
SELECT custkey, coalesce(m, y) AS group_year FROM m JOIN n USING (custkey) WHERE r = 1""")
def group_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Act of "), (year + 1).cast("string"))).otherwise(F.col("o_orderpriority"))
    return consensus.group_years(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), year.alias("y"), name.alias("name")), "custkey", "name", "y")


@register("extraction_vote", """WITH v AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type FROM events), s AS (SELECT user_id, count(DISTINCT d) AS samples FROM v GROUP BY 1),
n AS (SELECT user_id, event_type, count(*) AS votes FROM v WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT user_id, event_type, votes, samples FROM n JOIN s USING (user_id) WHERE votes >= greatest(1, floor(samples * 0.5))""")
def extraction_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_type")
    return consensus.voted(rows, "user_id", "d", "event_type")


@register("numeric_consensus", """SELECT l_orderkey AS orderkey, CAST(quarter(l_shipdate) AS INTEGER) AS q, median(l_quantity) AS value,
 arg_min(l_linestatus, CAST(l_linenumber AS VARCHAR) || l_linestatus) FILTER (l_linenumber % 2 = 0) AS source, round(avg(l_discount), 9) AS confidence FROM lineitem GROUP BY 1, 2""")
def numeric_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.quarter("l_shipdate").alias("q"), "l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("s"), "l_linenumber", "l_discount"
    )
    return consensus.agreed_values(rows, ["orderkey", "q"], "l_quantity", "s", "l_linenumber", "l_discount").withColumn("confidence", F.round("confidence", 9))


@register("column_quantiles", """SELECT l_returnflag AS flag, min(l_quantity) AS lowest, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS middle, quantile_cont(l_quantity, 0.75) AS q75,
 max(l_quantity) AS highest, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""")
def column_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return consensus.quantiles(rows, "flag", column="l_quantity").withColumn("mean", F.round("mean", 6))


@register("z_scores", """SELECT c_custkey AS custkey, round(coalesce((c_acctbal - avg(c_acctbal) OVER ()) / nullif(stddev_samp(c_acctbal) OVER (), 0), 0), 6) AS z FROM customer WHERE c_acctbal IS NOT NULL""")
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").filter("c_acctbal IS NOT NULL").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    return consensus.z_scores(rows, "c_acctbal").select("custkey", F.round("z", 6).alias("z"))


@register("outermost_rows", """WITH r AS (SELECT c_nationkey AS nation, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS z
 FROM customer WHERE c_acctbal IS NOT NULL) SELECT nation, max(k) FILTER (a = 1) AS least_key, max(k) FILTER (z = 1) AS greatest_key FROM r GROUP BY 1""")
def outermost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.outermost(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", "c_custkey", "c_acctbal")


@register("plain_paragraphs", r"""WITH p AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(n AS INTEGER) AS paragraph, length(t) AS n_chars FROM p WHERE len(regexp_extract_all(t, '\S+')) BETWEEN 50 AND 500 AND length(t) > 200
 AND NOT regexp_matches(lower(t), '\b(act|bill|law)\s+(of\s+)?\d{4}') AND NOT regexp_matches(lower(t), 'tax reform|revenue act|appropriation')""")
def plain_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    return rows.filter(consensus.is_plain_paragraph(F.col("t"))).select("doc_id", (F.col("n") + 1).alias("paragraph"), F.length("t").cast("long").alias("n_chars"))


@register("signed_timeline", """WITH s AS (SELECT o_orderpriority AS kind, CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderkey % 3 WHEN 0 THEN 'No change' WHEN 1 THEN 'Increase' ELSE 'Decrease' END AS sign FROM orders)
SELECT kind, year, sign, CASE WHEN sign = 'Decrease' THEN -count(*) ELSE count(*) END AS n FROM s GROUP BY 1, 2, 3""")
def signed_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    sign = F.when(m == 0, "No change").when(m == 1, "Increase").otherwise("Decrease")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("year"), sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("n", F.when(F.col("sign") == "Decrease", -F.col("n")).otherwise(F.col("n")))


@register("future_dates", """SELECT o_orderkey AS orderkey, strftime(CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-06-30' THEN CAST(o_orderdate AS DATE) - INTERVAL 100 YEAR ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS signed FROM orders""")
def future_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = dates.not_after(F.to_date("o_orderdate"), "1996-06-30")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), signed.cast("string").alias("signed"))


@register("gold_quarters", """SELECT o_orderkey AS orderkey, array_to_string(list_sort(list_distinct([year(o_orderdate) || '-Q' || quarter(o_orderdate), year(o_orderdate) || '-Q1'])), ',') AS quarters FROM orders""")
def gold_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.date_format("o_orderdate", "yyyy")
    entries = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM"), F.concat(year, F.lit("-Q1")), F.concat(year, F.lit("-13")), F.lit("n/a"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.array_join(dates.gold_quarters(entries), ",").alias("quarters"))


@register("manifest_rows", """WITH m AS (SELECT CAST(y AS INTEGER) AS year, CAST(NULL AS INTEGER) AS part, 'report' AS body, printf('report/%d.pdf', y) AS url FROM range(1990, 2011) t(y)
 UNION ALL SELECT CAST(y AS INTEGER), CAST(p AS INTEGER), 'bulletin', printf('bulletin/v%dn%d-%d.pdf', y - 1940, p, y) FROM range(1985, 2001) t(y), range(1, 5) u(p)) SELECT * FROM m WHERE year BETWEEN 1992 AND 2005""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = manifests.yearly(spark, 1990, 2010, "report/%1$d.pdf", "report")
    b = manifests.yearly_parts(spark, 1985, 2000, range(1, 5), "bulletin/v%3$dn%2$d-%1$d.pdf", "bulletin", base=1940)
    return manifests.consolidated([a, b], 1992, 2005)


@register("path_years", r"""WITH f AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, ['yearly', 'bilingual', 'plan', 'package'][o_orderkey % 4 + 1] AS series FROM orders),
s AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'x' ELSE '' END || CASE series WHEN 'yearly' THEN CAST(y AS VARCHAR) WHEN 'bilingual' THEN y || '_bm' WHEN 'plan' THEN 'rmk08_mtr_' || y ELSE 'relief_' || y END AS stem FROM f)
SELECT k AS orderkey, series, stem, CASE WHEN k % 5 <> 0 OR series = 'package' THEN y END AS year FROM s""")
def path_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, series = F.year("o_orderdate").cast("string"), F.col("series")
    rows = table(spark, sf_dir, "orders").withColumn("series", F.element_at(F.array(*[F.lit(x) for x in ("yearly", "bilingual", "plan", "package")]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    stem = F.when(series == "yearly", y).when(series == "bilingual", F.concat(y, F.lit("_bm"))).when(series == "plan", F.concat(F.lit("rmk08_mtr_"), y)).otherwise(F.concat(F.lit("relief_"), y))
    rows = rows.withColumn("stem", F.concat(F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""), stem))
    return rows.select(F.col("o_orderkey").alias("orderkey"), "series", "stem", manifests.path_year(series, F.col("stem")).alias("year"))
