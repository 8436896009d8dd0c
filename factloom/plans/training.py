"""Queries of training sets, few-shot examples, ladders and rescued pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import ladders, shaping, training
from factloom.plans import register
from factloom.plans.corpus import table


def _split(key: str, total: int):
    k = F.col(key) % total
    return F.when(k < total // 2, "train").when(k == total // 2, "val").otherwise("test")


@register("detection_set", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN 'train' WHEN doc_id % 7 = 3 THEN 'val' ELSE 'test' END AS split FROM documents WHERE doc_id % 5 = 0),
s AS (SELECT count(*) FILTER (split = 'train') / count(*) AS t, count(*) FILTER (split = 'val') / count(*) AS v FROM p),
n AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, 1 AS is_fiscal_act, split FROM p UNION ALL SELECT doc_id, 0, CASE WHEN k < round_even(n * t, 0) THEN 'train' WHEN k < round_even(n * t, 0) + round_even(n * v, 0) THEN 'val' ELSE 'test' END FROM n, s""")
def detection_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    yes = docs.filter("doc_id % 5 = 0").select(name.alias("passages_text"), F.col("source").alias("act_name"), _split("doc_id", 7).alias("split"), F.lit(1990).alias("year"), F.col("lang").alias("motivation_category"))
    no = docs.filter("doc_id % 5 <> 0").select("doc_id", name.alias("text"), F.lit(1990).alias("year"), "source", F.col("lang").alias("body"))
    return training.detection_set(yes, no, "doc_id").select(F.col("text").cast("long").alias("doc_id"), "is_fiscal_act", "split")


@register("detection_examples", """WITH x AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS act, CASE p_partkey % 7 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 0 END AS e, md5('20251206:' || p_partkey) AS h FROM part WHERE p_partkey % 4 < 2),
e AS (SELECT k FROM x WHERE NOT act AND e > 0 ORDER BY e DESC, h, k LIMIT 7), y AS (SELECT k FROM x WHERE act ORDER BY h, k LIMIT 10), r AS (SELECT k FROM x WHERE NOT act AND k NOT IN (SELECT k FROM e) ORDER BY h, k LIMIT 3)
SELECT k AS partkey, 'positive' AS kind, 0.95::DOUBLE AS confidence FROM y UNION ALL SELECT k, 'edge', 0.9::DOUBLE FROM e UNION ALL SELECT k, 'plain', 0.9::DOUBLE FROM r""")
def detection_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    more = F.when(k % 7 == 0, " we propose and recommend").when(k % 7 == 1, " it should").otherwise("")
    rows = table(spark, sf_dir, "part").select(
        k.alias("partkey"), F.concat(k.cast("string"), more).alias("text"), (k % 3 == 0).cast("int").alias("is_fiscal_act"), F.col("p_name").alias("act_name"), _split("p_partkey", 4).alias("split")
    )
    got = training.detection_examples(rows, "partkey")
    return got.select("partkey", "kind", F.get_json_object("output", "$.confidence").cast("double").alias("confidence"))


@register("economic_contexts", """SELECT o_orderkey AS orderkey, CASE WHEN year(o_orderdate) IN (1993, 1996) THEN 'RECESSION YEAR: slump of ' || year(o_orderdate) ELSE 'Economic expansion - no recession' END AS economic_context FROM orders""")
def economic_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    slumps = spark.createDataFrame([(1993, "slump of 1993"), (1996, "slump of 1996"), (1996, "the same, later")], "year int, context string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.year("o_orderdate").alias("year"))
    return training.economic_context(rows, slumps).select("orderkey", "economic_context")


@register("motivation_examples", """WITH x AS (SELECT o_orderkey AS k, 'Act ' || o_orderkey AS act, o_orderpriority AS m, o_orderkey % 4 < 2 AS train, md5('20251206:' || o_orderkey) AS h, year(o_orderdate) AS y FROM orders),
q AS (SELECT 1 AS required, min(k) AS k FROM x WHERE contains(act, '7') UNION ALL SELECT 2, min(k) FROM x WHERE contains(act, '12')),
c AS (SELECT m, count(*) AS n FROM q JOIN x ON x.k = q.k GROUP BY 1),
p AS (SELECT x.k, x.m, row_number() OVER (PARTITION BY x.m ORDER BY h, x.k) AS r, coalesce(c.n, 0) AS n FROM x LEFT JOIN c ON c.m = x.m WHERE train AND NOT contains(act, '7') AND NOT contains(act, '12'))
SELECT k AS orderkey, required, motivation, CASE WHEN y = 1995 THEN 'RECESSION YEAR: slump' ELSE 'Economic expansion - no recession' END AS context, CASE WHEN required = 1 THEN 'known' ELSE 'plain' END AS why
FROM (SELECT x.k, q.required, x.m AS motivation, x.y FROM q JOIN x ON x.k = q.k UNION ALL SELECT p.k, NULL, p.m, x.y FROM p JOIN x ON x.k = p.k WHERE r <= 5 - n)""")
def motivation_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("orderkey"), F.concat(F.lit("Act "), k.cast("string")).alias("act_name"), F.col("o_comment").alias("passages_text") if "o_comment" in table(spark, sf_dir, "orders").columns else F.col("o_orderstatus").alias("passages_text"),
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("motivation"), (k % 2 == 0).alias("exogenous"), _split("o_orderkey", 4).alias("split"),
    )
    slump = spark.createDataFrame([(1995, "slump")], "year int, context string")
    got = training.motivation_examples(rows, "orderkey", 5, ["7", "12"], slump, {"7": "It is known."})
    context = F.regexp_extract("input", r"ECONOMIC CONTEXT: (.*)\n", 1)
    known = F.get_json_object("output", "$.reasoning") == "It is known."
    return got.select("orderkey", "required", "motivation", context.alias("context"), F.when(known, "known").otherwise("plain").alias("why"))


@register("extraction_examples")
def extraction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts from ``part``, documents with their lines as pages; the pages drawn are hashed, so there is no SQL."""
    acts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("act_name"), (F.col("p_size") + 1950).alias("year"), F.col("p_type").alias("passages_text"), F.col("p_brand").alias("motivation_category"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50 + 1950).cast("int").alias("year"), F.split(F.coalesce("text", F.lit("")), "\n").alias("pages"))
    return training.extraction_examples(acts, docs, "p_partkey", "doc_id")


LADDER = """m AS (SELECT o_orderpriority AS variant_id, ['pairwise_precision', 'pairwise_recall', 'pairwise_f1', 'ari', 'purity', 'other'][month(o_orderdate) % 6 + 1] AS metric, avg(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderkey % 100 / 100 END) AS v, count(*) AS n FROM orders GROUP BY 1, 2),
c AS (SELECT variant_id, metric, CASE WHEN v IS NULL THEN '—' ELSE printf('%.3f [%.3f, %.3f]', v, v - 0.125, v + 0.125) END AS cell FROM m)"""


@register("cluster_ladder", f"""WITH {LADDER} SELECT variant_id, max(cell) FILTER (metric = 'pairwise_precision') AS Precision, max(cell) FILTER (metric = 'pairwise_recall') AS Recall, max(cell) FILTER (metric = 'pairwise_f1') AS F1, max(cell) FILTER (metric = 'ari') AS ARI, max(cell) FILTER (metric = 'purity') AS Purity,
 CASE variant_id WHEN '1-URGENT' THEN '3 : 0' ELSE '1.50' END AS "Over:Under", 7 AS "n clusters" FROM c GROUP BY 1""")
def cluster_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (*ladders.CLUSTER_COLUMNS, "other")])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant_id"), F.get(names, F.month("o_orderdate") % 6).alias("metric"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey") % 100 / 100).alias("x"))
    long = o.groupBy("variant_id", "metric").agg(F.avg("x").alias("value")).withColumns({
        "eval_tier": F.lit("tier1"), "ci_lo": F.col("value") - 0.125, "ci_hi": F.col("value") + 0.125, "over_merge_count": F.lit(3),
        "under_merge_count": F.when(F.col("variant_id") == "1-URGENT", 0).otherwise(2), "n_predicted_clusters": F.lit(7),
    })
    return ladders.cluster_ladder(long.unionByName(long.withColumn("eval_tier", F.lit("all"))))


@register("rescued_pages", """SELECT page_id, length(regexp_replace(regexp_replace(replace(replace(t, 'Digitized for FRASER', ''), 'Federal Reserve Bank', ''), '^\\s+', ''), '\\s+$', '')) < 100 AND page_id % 3 > 0 AS rescue FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE ' Digitized for FRASER' || url || repeat(' ', 200) END AS t FROM pages)""")
def rescued_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat(F.lit(" Digitized for FRASER"), F.col("url"), F.repeat(F.lit(" "), F.lit(200))))
    return table(spark, sf_dir, "pages").select("page_id", shaping.needs_rescue(text, (F.col("page_id") % 3).cast("int")).alias("rescue"))


@register("nation_regions", """SELECT n_nationkey AS nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("k"))
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    return shaping.joined_once(left, right, ["k"]).select(F.col("n_nationkey").alias("nationkey"), F.col("r_name").alias("region"))
