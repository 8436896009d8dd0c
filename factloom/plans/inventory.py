"""Queries of evidence joins, ordered groups and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import evidence
from factloom.plans import register
from factloom.plans.corpus import table


@register("nested_first_quarter", """SELECT o_custkey AS custkey, arg_min(o_totalprice, o_orderkey) AS first_price, count(*) AS n_orders,
 array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ',') AS order_keys FROM orders GROUP BY 1""")
def nested_first_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    got = evidence.first_and_nested(rows, "o_custkey", ["o_orderkey"], ["o_totalprice", "o_orderkey"])
    keys = F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",")
    return got.select(F.col("o_custkey").alias("custkey"), F.col("first_o_totalprice").alias("first_price"), F.col("n_items").cast("long").alias("n_orders"), keys.alias("order_keys"))


@register("forward_fill", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM e""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return evidence.fill_down(rows, "user_id", ["event_id"], "v")


@register("yoy_drop", """WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(n) OVER (PARTITION BY p ORDER BY y) AS b FROM y)
SELECT p AS priority, CAST(y AS INTEGER) AS year, n AS n_orders, round((n - b) / nullif(b, 0), 9) AS change, coalesce((n - b) / nullif(b, 0) < -0.5, false) AS sudden_drop FROM l""")
def yoy_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_orders"))
    before = F.lag("n_orders").over(W.partitionBy("priority").orderBy("year"))
    change = F.try_divide(F.col("n_orders") - before, before)
    return n.withColumn("_c", change).select("priority", "year", "n_orders", F.round("_c", 9).alias("change"), F.coalesce(F.col("_c") < -0.5, F.lit(False)).alias("sudden_drop"))


@register("cumulative_share", """WITH r AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
e AS (SELECT *, q > 100 AS e, CASE WHEN q > 100 THEN q END AS relevance FROM r),
c AS (SELECT *, CASE WHEN e THEN sum(relevance) OVER (PARTITION BY nation ORDER BY relevance DESC NULLS LAST, supplier ROWS UNBOUNDED PRECEDING) / sum(relevance) OVER (PARTITION BY nation) END AS s FROM e)
SELECT nation, supplier, relevance, round(s, 9) AS cum_share, CASE WHEN e THEN s <= 0.8 ELSE false END AS chosen FROM c""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.sum("l_quantity").cast("long").alias("q"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))
    got = evidence.mark_chosen(sums.join(suppliers, "supplier"), "nation", F.col("q"), F.col("q") > 100, "supplier")
    return got.select("nation", "supplier", "relevance", F.round("cum_share", 9).alias("cum_share"), "chosen")


@register("evidence_have_missing", """SELECT d.source, count(l.doc_id) AS have, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def evidence_have_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    have, missing = evidence.with_and_without(docs, labels, ["doc_id"])
    rows = have.select("source", F.lit(1).alias("h")).unionByName(missing.join(docs, "doc_id").select("source", F.lit(0).alias("h")))
    return rows.groupBy("source").agg(F.sum("h").alias("have"), F.sum(1 - F.col("h")).alias("missing"))


@register("deliverable_left", """SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NULL AS unjudged FROM documents d LEFT JOIN labels l USING (doc_id)""")
def deliverable_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("_has", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").withColumn("unjudged", F.col("_has").isNull()).drop("_has")


@register("measures_fanout", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULLIF(r, 0) AS INTEGER) AS measure_rank
FROM (SELECT event_id, props, unnest(CASE WHEN event_id % 4 = 0 THEN [0] ELSE range(1, event_id % 4 + 1) END) AS r FROM events)""")
def measures_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 4).cast("int")
    items = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.array_repeat(F.lit(1), n))
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), items.alias("measures"))
    return evidence.fan_out(rows, "measures", "event_id", "k").drop("measure")


@register("country_gate", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'click' ELSE 'OTHER' END AS measure_country FROM events WHERE event_type = 'click' OR value > 50""")
def country_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter((F.col("event_type") == "click") | (F.col("value") > 50))
    return rows.select("event_id", evidence.country_of(F.col("event_type"), "click").alias("measure_country"))


@register("range_join_recall", """SELECT c_custkey AS custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
 AND year(o_orderdate) BETWEEN 1992 + c_custkey % 5 AND 1994 + c_custkey % 5 GROUP BY 1""")
def range_join_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), (1992 + F.col("c_custkey") % 5).alias("y"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("oy"))
    on = (F.col("custkey") == F.col("o_custkey")) & F.col("oy").between(F.col("y"), F.col("y") + 2)
    return c.join(o, on, "left").groupBy("custkey").agg(F.count("o_orderkey").alias("n_orders"))


@register("balance_full_join", """WITH a AS (SELECT source AS k, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT source AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT coalesce(a.k, b.k) AS source, coalesce(a.n, 0) AS n_even, coalesce(b.n, 0) AS n_labelled FROM a FULL JOIN b ON a.k = b.k""")
def balance_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    a = d.groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("n_even")).filter("n_even > 0")
    b = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_labelled"))
    return a.join(b, "source", "full").select("source", F.coalesce("n_even", F.lit(0)).alias("n_even"), F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"))
