"""Report-shaped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.plans import register
from factloom.plans.corpus import table


@register("decade_rollup", """SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, printf('%ds', CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER)) AS label, count(*) AS n_orders,
 round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS pct_final FROM orders GROUP BY 1, 2""")
def decade_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decade = (F.floor(F.year("o_orderdate") / 10) * 10).cast("int")
    pct = F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)), 6)
    return table(spark, sf_dir, "orders").groupBy(decade.alias("decade")).agg(F.count(F.lit(1)).alias("n_orders"), pct.alias("pct_final")).select("decade", F.format_string("%ds", "decade").alias("label"), "n_orders", "pct_final")


@register("api_cost_rollup", """SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS cost, round(count(*) FILTER (event_id % 3 = 0) / nullif(count(*), 0), 9) AS hit_rate FROM events GROUP BY 1""")
def api_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(n.alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.try_divide(F.count_if(F.col("event_id") % 3 == 0), n), 9).alias("hit_rate"))


@register("status_matrix", """SELECT event_type, count(*) FILTER (dayofweek(ts) IN (0, 6)) AS weekend, count(*) FILTER (dayofweek(ts) NOT IN (0, 6)) AS weekday FROM events GROUP BY 1""")
def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday")
    return table(spark, sf_dir, "events").withColumn("kind", kind).groupBy("event_type").pivot("kind", ["weekend", "weekday"]).count().na.fill(0)


@register("flag_tally", """WITH f AS (SELECT l.quality = 1 AS quality, l.toxic = 1 AS toxic FROM documents LEFT JOIN labels l USING (doc_id))
SELECT 'quality' AS flag, count(*) FILTER (quality) AS n_true, count(*) FILTER (NOT quality) AS n_false, count(*) FILTER (quality IS NULL) AS n_null FROM f
UNION ALL SELECT 'toxic', count(*) FILTER (toxic), count(*) FILTER (NOT toxic), count(*) FILTER (toxic IS NULL) FROM f""")
def flag_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), (F.col(f) == 1).alias("v")) for f in ("quality", "toxic")])).alias("x")
    v = F.col("x.v")
    return rows.select(flags).groupBy(F.col("x.flag").alias("flag")).agg(F.count_if(v).alias("n_true"), F.count_if(~v).alias("n_false"), F.count_if(v.isNull()).alias("n_null"))


@register("top_forms", """WITH n AS (SELECT p_brand AS brand, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY brand ORDER BY n DESC, name) AS INTEGER) AS r FROM n) SELECT brand, name, n, r AS place FROM r WHERE r <= 5""")
def top_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("brand").orderBy(F.desc("n"), "name"))).filter("place <= 5")


@register("funnel", """SELECT 'documents' AS step, count(*) AS n FROM documents UNION ALL SELECT 'labelled', count(*) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'good', count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    counts = rows.agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    return counts.unpivot([], ["documents", "labelled", "good"], "step", "n")


@register("scope_tally", """SELECT lang, source, count(*) AS n_docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_pages, count(l.doc_id) AS n_labelled, count(*) FILTER (quality = 1) AS n_good
FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def scope_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.size(F.split("text", "\n")).alias("p"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("p").alias("n_pages"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"))


@register("pair_language_slice", """WITH k AS (SELECT source FROM documents WHERE lang IN ('en', 'de') GROUP BY 1 HAVING count(DISTINCT lang) = 2)
SELECT doc_id, source, lang FROM documents WHERE lang IN ('en', 'de') AND source IN (SELECT source FROM k)""")
def pair_language_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de")).select("doc_id", "source", "lang")
    return d.join(d.groupBy("source").agg(F.countDistinct("lang").alias("n")).filter("n = 2"), "source", "left_semi")


@register("coverage_grid", """WITH d AS (SELECT unnest(range(0, 24)) AS h), t AS (SELECT DISTINCT event_type AS e FROM events), n AS (SELECT event_type AS e, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
SELECT t.e AS event_type, CAST(d.h AS INTEGER) AS hour, coalesce(n.n, 0) AS n_events, n.n IS NULL AS missing FROM d CROSS JOIN t LEFT JOIN n ON n.e = t.e AND n.h = d.h""")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(n, ["event_type", "hour"], "left").select("event_type", "hour", F.coalesce("n", F.lit(0)).alias("n_events"), F.col("n").isNull().alias("missing"))


@register("mode_year", """WITH n AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, y) AS r FROM n) SELECT k AS custkey, y AS modal_year FROM r WHERE r = 1""")
def mode_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.mode(F.year("o_orderdate"), True).alias("modal_year"))


@register("type_coverage", """SELECT source, min(y) AS first_year, max(y) AS last_year, printf('%d-%d', min(y), max(y)) AS span, count(*) AS n_docs, sum(p)::BIGINT AS n_pages FROM (SELECT source, CAST(1990 + doc_id % 20 AS INTEGER) AS y, len(string_split(text, chr(10))) AS p FROM documents) GROUP BY 1""")
def type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", (1990 + F.col("doc_id") % 20).cast("int").alias("y"), F.size(F.split("text", "\n")).alias("p"))
    a, z = F.min("y"), F.max("y")
    return rows.groupBy("source").agg(a.alias("first_year"), z.alias("last_year"), F.format_string("%d-%d", a, z).alias("span"), F.count(F.lit(1)).alias("n_docs"), F.sum("p").alias("n_pages"))


@register("quarter_lists", """WITH q AS (SELECT o_custkey AS custkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, o_orderstatus AS s, o_orderkey AS k FROM orders), f AS (SELECT custkey, s, min(k) AS k FROM q GROUP BY 1, 2)
SELECT custkey, n AS n_quarters, statuses FROM (SELECT custkey, count(DISTINCT q) AS n FROM q GROUP BY 1) JOIN (SELECT custkey, string_agg(s, ',' ORDER BY k) AS statuses FROM f GROUP BY 1) USING (custkey)""")
def quarter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string")).alias("q"), "o_orderkey", "o_orderstatus")
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]))
    return rows.groupBy("custkey").agg(F.countDistinct("q").alias("n_quarters"), F.array_join(seen, ",").alias("statuses"))


@register("curve_with_origin", """WITH d AS (SELECT n_regionkey AS region, s_suppkey AS k, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0),
c AS (SELECT region, row_number() OVER w AS place, sum(v) OVER w / sum(v) OVER (PARTITION BY region) AS s FROM d WINDOW w AS (PARTITION BY region ORDER BY v DESC, k ROWS UNBOUNDED PRECEDING))
SELECT region, CAST(place AS INTEGER) AS place, round(s, 6) AS cum_share FROM c UNION ALL SELECT DISTINCT region, 0, 0.0 FROM d""")
def curve_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), "s_suppkey", "s_acctbal")
    w = W.partitionBy("region").orderBy(F.desc("s_acctbal"), "s_suppkey")
    share = F.sum("s_acctbal").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("s_acctbal").over(W.partitionBy("region"))
    curve = d.select("region", F.row_number().over(w).alias("place"), F.round(share, 6).alias("cum_share"))
    return curve.unionByName(d.select("region").distinct().select("region", F.lit(0).alias("place"), F.lit(0.0).alias("cum_share")))


@register("matching_gains", """WITH c AS (SELECT p_brand AS b, count(*) AS n FROM part WHERE contains(p_name, 'e') GROUP BY 1), d AS (SELECT p_brand AS b, count(*) AS n FROM part WHERE contains(lower(p_name), 'e') OR p_size > 40 GROUP BY 1), k AS (SELECT DISTINCT p_brand AS b FROM part)
SELECT b AS brand, coalesce(c.n, 0) AS before, coalesce(d.n, 0) AS after, coalesce(d.n, 0) - coalesce(c.n, 0) AS gained FROM k LEFT JOIN c USING (b) LEFT JOIN d USING (b)""")
def matching_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, wide = F.contains("p_name", F.lit("e")), F.contains(F.lower("p_name"), F.lit("e")) | (F.col("p_size") > 40)
    got = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(plain).alias("before"), F.count_if(wide).alias("after"))
    return got.withColumn("gained", F.col("after") - F.col("before"))
