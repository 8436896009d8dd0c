"""Queries of recodes, formats and gold matches of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import recodes
from factloom.operators import metrics
from factloom.operators.goldmatch import resolved_gold
from factloom.plans import register
from factloom.plans.corpus import table


@register("recoded_gold", """SELECT o_orderkey AS orderkey, ['SPENDING_DRIVEN', 'COUNTERCYCLICAL', 'DEFICIT_DRIVEN', 'LONG_RUN', NULL][o_orderkey % 5 + 1] AS motivation, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS exogenous,
 CASE WHEN o_totalprice > 200000 THEN '+' WHEN o_totalprice < 100000 THEN '-' ELSE '0' END AS sign FROM orders""")
def recoded_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in (*recodes.MOTIVATIONS, "else")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    price = F.col("o_totalprice")
    flag = F.when(F.col("o_orderstatus") == "F", "Exogenous").when(F.col("o_orderstatus") == "O", "Endogenous")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), recodes.looked_up(said, recodes.MOTIVATIONS).alias("motivation"), recodes.exogenous(flag).alias("exogenous"),
        recodes.sign_of(F.when(price > 200000, 1.5).when(price < 100000, -1.5).otherwise(0.0)).alias("sign"),
    )


@register("source_types", """SELECT r_name || '-' || n_name AS name, CASE WHEN regexp_matches(lower(r_name || '-' || n_name), 'erp|economic.report') THEN 'ERP' WHEN regexp_matches(lower(r_name || '-' || n_name), 'treasury|annual.report') THEN 'Treasury'
 WHEN regexp_matches(lower(r_name || '-' || n_name), 'budget') THEN 'Budget' ELSE 'Other' END AS source_type FROM (SELECT ['ERP_', 'us_Economic_Report', 'Annual-Report', 'x_BUDGET', 'z'][n_nationkey % 5 + 1] AS r_name, n_name FROM nation)""")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(x) for x in ("ERP_", "us_Economic_Report", "Annual-Report", "x_BUDGET", "z")]), F.col("n_nationkey") % 5 + 1)
    name = F.concat(head, F.lit("-"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select(name.alias("name"), recodes.source_type(name).alias("source_type"))


@register("interval_cells", """SELECT l_returnflag AS flag, printf('%.3f [%.3f, %.3f]', round(avg(l_tax), 5), min(l_tax), max(l_tax)) AS cell, CASE WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN count(*) || ' : 0' ELSE printf('%.2f', count(*) / count(*) FILTER (l_linestatus = 'O')) END AS ratio FROM lineitem GROUP BY 1""")
def interval_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg("l_tax"), 5).alias("v"), F.min("l_tax").alias("a"), F.max("l_tax").alias("z"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("m"))
    return got.select("flag", recodes.interval_cell(F.col("v"), F.col("a"), F.col("z")).alias("cell"), recodes.ratio_cell(F.col("n"), F.col("m")).alias("ratio"))


@register("edge_case_scores", r"""SELECT doc_id, CAST(3.0 * len(regexp_extract_all(t, '\bpropose[ds]?\b')) + 3.0 * len(regexp_extract_all(t, '\brecommend[s|ed|ation|ations]?\b')) + 2.0 * len(regexp_extract_all(t, '\bshould\b')) + 2.0 * len(regexp_extract_all(t, '\b(act|legislation)\s+of\s+\d{4}\b'))
 + 2.0 * len(regexp_extract_all(t, '\bsince\s+(the|\d{4})\b')) + 2.0 * len(regexp_extract_all(t, '\bprevious(ly)?\b')) + 1.5 * len(regexp_extract_all(t, '\benacted\s+(in|to)\b')) AS DOUBLE) AS score FROM (SELECT doc_id, lower(text) || CASE doc_id % 3 WHEN 0 THEN ' proposed act of 1962' WHEN 1 THEN ' enacted in' ELSE '' END AS t FROM documents WHERE text IS NOT NULL)""")
def edge_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, " proposed act of 1962").when(F.col("doc_id") % 3 == 1, " enacted in").otherwise("")
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", recodes.edge_case_score(F.concat("text", tail)).alias("score"))


@register("clusters_vs_gold", """WITH f AS (SELECT p_name AS name, p_brand AS act, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT name, act, row_number() OVER (PARTITION BY name ORDER BY n DESC, act) AS r FROM f),
p AS (SELECT DISTINCT name, act AS g, left(name, 3) AS p FROM r WHERE r = 1), t AS (SELECT p, g, count(*) AS n FROM p GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS tp, sum(n) AS n FROM t),
b AS (SELECT sum(n * (n - 1) / 2) AS p, sum(m) AS pure FROM (SELECT sum(n) AS n, max(n) AS m FROM t GROUP BY p)), c AS (SELECT sum(n * (n - 1) / 2) AS g FROM (SELECT sum(n) AS n FROM t GROUP BY g))
SELECT CAST(tp AS BIGINT) AS tp_pairs, CAST(p - tp AS BIGINT) AS over_merge, CAST(g - tp AS BIGINT) AS under_merge, round(pure / n, 9) AS purity FROM a, b, c""")
def clusters_vs_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("act"))
    clusters = part.select("name", F.substring("name", 1, 3).alias("cluster")).distinct()
    both = resolved_gold(part, "name", "act").join(clusters, "name")
    return metrics.partition_metrics(both, "cluster", "act").select("tp_pairs", "over_merge", "under_merge", F.round("purity", 9).alias("purity"))
