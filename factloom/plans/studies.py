"""Queries of series, folds and cluster grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import density, projection, proxies, vectors
from factloom.plans import register
from factloom.plans.corpus import table
from factloom.plans.entities import NAMES, part_names
from factloom.streaming import windows as streams


@register("midpoint_quarters", """SELECT o_orderkey AS orderkey, CAST(year(d) * 4 + quarter(d) - 1 + CASE WHEN d > make_date(year(d), quarter(d) * 3 - 1, 15) THEN 1 ELSE 0 END AS INTEGER) AS q FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def midpoint_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), proxies.midpoint_quarter(F.to_date("o_orderdate")).alias("q"))


@register("signed_proxy", """WITH a AS (SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q, CASE o_orderkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS s FROM orders),
g AS (SELECT q, sum(s) AS s, count(*) AS n FROM a GROUP BY 1), e AS (SELECT CAST(unnest(range(min(q), max(q) + 1)) AS INTEGER) AS q FROM g)
SELECT e.q, (e.q // 4) || '-Q' || (e.q % 4 + 1) AS label, CAST(sign(coalesce(s, 0)) AS INTEGER) AS z, coalesce(n, 0) AS n_acts FROM e LEFT JOIN g USING (q)""")
def signed_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    acts = table(spark, sf_dir, "orders").select((F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q"), F.when(m == 0, -1).when(m == 1, 1).otherwise(0).alias("s"))
    return proxies.signed_proxy(acts, "q", "s")


@register("magnitude_errors", """SELECT l_returnflag AS flag, round(avg(abs(l_tax - l_discount) / nullif(abs(l_discount), 0)), 9) AS mape, round(avg(CASE WHEN sign(l_tax) = sign(l_discount) THEN 1.0 ELSE 0.0 END), 9) AS sign_accuracy FROM lineitem GROUP BY 1""")
def magnitude_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = proxies.magnitude_errors(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_tax", "l_discount", "flag")
    return got.select("flag", F.round("mape", 9).alias("mape"), F.round("sign_accuracy", 9).alias("sign_accuracy"))


@register("left_out_folds")
def left_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return proxies.left_out_folds(docs.filter("quality = 1"), docs.filter("quality = 0"), "source", "doc_id")


@register("density_grid")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_grid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [2, 3, 5], [None, 2], year="label")


@register("reduced_grid")
def reduced_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two, five and ten principal axes, three sizes and two windows: eighteen variants."""
    return projection.reduced_grid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [2, 5, 10], [2, 3, 5], [None, 2], year="label")


@register("principal_variance", """WITH u AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS e FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL))),
x AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM u)
SELECT (SELECT count(*) FROM u) AS n, round(sum(v), 6) AS total_variance, TRUE AS falling FROM (SELECT var_samp(x) AS v FROM x GROUP BY pos)""")
def principal_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances along all principal axes add up to those along the coordinates."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select(vectors.unit(F.col("embedding")).alias("x"))
    spread = projection.principal_axes(rows, "x", 1)[2].tolist()
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(round(sum(spread), 6)).alias("total_variance"), F.lit(sorted(spread, reverse=True) == spread).alias("falling"))


@register("name_grid", f"""WITH RECURSIVE {NAMES}, y AS (SELECT name, min(year) AS year FROM n GROUP BY 1), g AS (SELECT * FROM (VALUES ('jw_t0.15_unblocked', 0.85, NULL), ('jw_t0.15_yw2', 0.85, 2), ('jw_t0.10_unblocked', 0.9, NULL), ('jw_t0.10_yw2', 0.9, 2)) AS g(variant_id, t, w)),
e AS (SELECT variant_id, a.name AS a, b.name AS b FROM g, y a JOIN y b ON a.name <> b.name WHERE jaro_similarity(a.name, b.name) >= t AND (w IS NULL OR abs(a.year - b.year) <= w)),
r AS (SELECT variant_id, name AS v, name AS u FROM g, y UNION SELECT r.variant_id, r.v, e.b FROM r JOIN e ON e.a = r.u AND e.variant_id = r.variant_id)
SELECT variant_id, v AS measure_name, min(u) AS label FROM r GROUP BY 1, 2""")
def name_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.name_grid(part_names(spark, sf_dir), [0.85, 0.9], [None, 2])


@register("name_grid_all")
def name_grid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of C03, ten variants; below 0.85 DuckDB's Jaro differs, so ``name_grid`` has SQL for four of them."""
    return density.name_grid(part_names(spark, sf_dir), [0.9, 0.85, 0.8, 0.75, 0.7], [None, 2])


@register("windowed_counts", """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", value="value")
    return got.withColumn("total", F.round("total", 6))
