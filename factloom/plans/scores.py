"""Queries of metrics, votes and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evidence, metrics, resampling
from factloom.plans import register
from factloom.plans.corpus import table

JOINED = "j AS (SELECT l.doc_id, l.quality, l.toxic, d.text, d.lang, d.source, contains(d.text, '!!') AS marks, length(d.text) AS n FROM labels l JOIN documents d USING (doc_id))"


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.withColumn("marks", F.contains("text", F.lit("!!"))).withColumn("n", F.length("text"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


@register("binary_metrics", f"""WITH {JOINED}, c AS (SELECT lang, count(*) FILTER (NOT marks AND quality = 1) AS tp, count(*) FILTER (NOT marks AND quality <> 1) AS fp,
 count(*) FILTER (marks AND quality = 1) AS fn, count(*) FILTER (marks AND quality <> 1) AS tn FROM j GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tp / nullif(tp + fp, 0), 9) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1,
 round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy, round(tn / nullif(tn + fp, 0), 9) AS specificity FROM c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir).select("lang", (~F.col("marks")).alias("p"), (F.col("quality") == 1).alias("y"))
    return rounded(metrics.binary_metrics(rows, "p", "y", "lang"), "recall", "precision", "f1", "accuracy", "specificity")


GUESS = "CASE WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' el ') THEN 'es' WHEN contains(text, ' le ') THEN 'fr' ELSE 'en' END"


@register("multiclass_metrics", f"""WITH p AS (SELECT {GUESS} AS p, lang AS y FROM documents), l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS level),
c AS (SELECT level, count(*) FILTER (p = level AND y = level) AS tp, count(*) FILTER (p = level) AS called, count(*) FILTER (y = level) AS support FROM l, p GROUP BY level)
SELECT level, round(tp / nullif(called, 0), 9) AS precision, round(tp / nullif(support, 0), 9) AS recall, round(2 * tp / nullif(called + support, 0), 9) AS f1, support FROM c""")
def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    guess = F.when(F.contains(t, F.lit(" der ")), "de").when(F.contains(t, F.lit(" el ")), "es").when(F.contains(t, F.lit(" le ")), "fr").otherwise("en")
    rows = table(spark, sf_dir, "documents").select(guess.alias("p"), F.col("lang").alias("y"))
    return rounded(metrics.class_metrics(rows, "p", "y", ["de", "en", "es", "fr"]), "precision", "recall", "f1")


@register("calibration_bins", f"""WITH {JOINED}, b AS (SELECT nullif(CAST(ceil(least(n, 5000) / 5000 * 10) AS INTEGER), 0) AS bin, CAST(quality AS DOUBLE) AS q FROM j)
SELECT bin, count(*) AS n, round(avg(q), 9) AS accuracy FROM b GROUP BY bin""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir).select((F.least("n", F.lit(5000)) / 5000).alias("c"), F.col("quality").alias("ok"))
    return rounded(metrics.calibration_bins(rows, "c", "ok"), "accuracy")


@register("fleiss_kappa", """WITH r AS (SELECT doc_id, unnest([CAST(contains(text, '!!') AS INTEGER), CAST(contains(text, '|') AS INTEGER), CAST(contains(text, '$') AS INTEGER)]) AS c FROM documents),
n AS (SELECT doc_id, c, count(*) AS n FROM r GROUP BY 1, 2), s AS (SELECT doc_id, sum(n * (n - 1)) / 6 AS a FROM n GROUP BY 1),
o AS (SELECT avg(a) AS p, count(*) AS k FROM s), e AS (SELECT sum(power(m / (3 * k), 2)) AS e FROM (SELECT c, sum(n) AS m FROM n GROUP BY c), o)
SELECT k AS n_subjects, round(p, 9) AS observed, round(e, 9) AS expected, round(CASE WHEN e = 1 THEN 1.0 ELSE (p - e) / (1 - e) END, 9) AS kappa FROM o, e""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    raters = F.array(*[F.contains("text", F.lit(x)).cast("int") for x in ("!!", "|", "$")])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(raters).alias("c"))
    return rounded(metrics.fleiss_kappa(rows, "doc_id", "c"), "observed", "expected", "kappa")


@register("quarter_sets", """WITH s AS (SELECT l_orderkey AS k, list(DISTINCT year(l_shipdate) || '-Q' || quarter(l_shipdate)) AS b FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, [year(o_orderdate) || '-Q' || quarter(o_orderdate)] AS a FROM orders),
x AS (SELECT o.k, a, b, len(list_intersect(a, b)) AS m FROM o JOIN s ON s.k = o.k)
SELECT k AS orderkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS ordinal, len(b) AS n_shipped, round(m / (len(a) + len(b) - m), 9) AS jaccard FROM x JOIN orders ON o_orderkey = k""")
def quarter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.collect_set(metrics.quarter_of(F.col("l_shipdate"))).alias("b"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), metrics.quarter_of(F.col("o_orderdate")).alias("q"))
    a = F.array("q")
    return orders.join(shipped, "orderkey").select(
        "orderkey", metrics.quarter_number(F.col("q")).alias("ordinal"), F.size("b").cast("long").alias("n_shipped"), F.round(metrics.quarter_jaccard(a, F.col("b")), 9).alias("jaccard")
    )


@register("majority_vote", """WITH n AS (SELECT conv_id, role, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY conv_id) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS r FROM n)
SELECT conv_id, role AS majority, round(a, 9) AS agreement FROM r WHERE r = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.majority(table(spark, sf_dir, "conversations"), ["conv_id"], "role"), "agreement")


@register("stratified_split", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('1:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r <= ceil(n * 6 / 10) THEN 'train' WHEN r <= ceil(n * 6 / 10) + ceil(n * 2 / 10) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.train_val_test(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@register("capped_sample", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= 5""")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@register("bootstrap_quality")
def bootstrap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.mean_interval(table(spark, sf_dir, "labels"), "doc_id", "quality", 200)
