"""Queries over names, clusters and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import fuzzy, metrics, neighbours, vectors
from factloom.plans import register
from factloom.plans.corpus import table


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("year"))


NAMES = "n AS (SELECT p_name AS name, min(p_size) AS year FROM part GROUP BY p_name)"
PERTURBED = "c AS (SELECT reverse(substr(reverse(name), 2)) AS candidate, year + 1 AS cyear FROM n)"


def perturbed(names: DataFrame) -> DataFrame:
    return names.select(F.expr("substring(name, 1, length(name) - 1)").alias("candidate"), (F.col("year") + 1).alias("cyear"))


@register("fuzzy_align", f"""WITH {NAMES}, {PERTURBED},
s AS (SELECT name, candidate, jaro_similarity(name, candidate) AS sim FROM n, c),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, candidate) AS r FROM s)
SELECT name, candidate, round(sim, 9) AS similarity FROM r WHERE r = 1 AND sim >= 0.85""")
def fuzzy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    return fuzzy.best_matches(names, perturbed(names)).select("name", "candidate", F.round("similarity", 9).alias("similarity"))


@register("match_with_bonus", f"""WITH {NAMES}, {PERTURBED},
s AS (SELECT name, candidate, jaro_similarity(name, candidate) AS sim, CASE WHEN abs(year - cyear) <= 1 THEN 0.05 ELSE 0.0 END AS bonus FROM n, c),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(sim + bonus, 9) DESC, candidate) AS r FROM s)
SELECT name, candidate, round(sim, 9) AS similarity, CASE WHEN sim >= 0.95 THEN 'exact' ELSE 'fuzzy' END AS kind FROM r WHERE r = 1 AND sim >= 0.85""")
def match_with_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    got = fuzzy.best_matches(names, perturbed(names), bonus_years=("year", "cyear"))
    return got.select("name", "candidate", F.round("similarity", 9).alias("similarity"), F.when(F.col("similarity") >= 0.95, "exact").otherwise("fuzzy").alias("kind"))


@register("name_pairs_near", f"""WITH {NAMES}
SELECT x.name AS a, y.name AS b, round(jaro_similarity(x.name, y.name), 9) AS similarity FROM n x JOIN n y ON x.name < y.name AND abs(x.year - y.year) <= 2
WHERE jaro_similarity(x.name, y.name) >= 0.85""")
def name_pairs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.similar_pairs(part_names(spark, sf_dir), 0.85, year="year", window=2).select("a", "b", F.round("similarity", 9).alias("similarity"))


@register("name_pairs_band")
def name_pairs_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down to 0.8, where DuckDB's rounded Jaro differs; ``name_pairs_near`` has SQL from 0.85 on."""
    return fuzzy.similar_pairs(part_names(spark, sf_dir), 0.8, year="year", window=2).select("a", "b", F.round("similarity", 9).alias("similarity"))


CLUSTERS = f"""{NAMES},
e AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name <> y.name AND jaro_similarity(x.name, y.name) >= 0.85),
r AS (SELECT name AS v, name AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
l AS (SELECT v, min(u) AS label FROM r GROUP BY v),
k AS (SELECT v, dense_rank() OVER (ORDER BY label) AS cluster_id FROM l)"""


@register("name_clusters", f"""WITH RECURSIVE {CLUSTERS}
SELECT v AS measure_name, CAST(cluster_id AS INTEGER) AS cluster_id, first_value(v) OVER (PARTITION BY cluster_id ORDER BY length(v) DESC, v) AS canonical_name, count(*) OVER (PARTITION BY cluster_id) AS n_members FROM k""")
def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.name_clusters(part_names(spark, sf_dir))


@register("merge_rate", f"""WITH RECURSIVE {CLUSTERS}, m AS (SELECT count(*) AS n, count(DISTINCT cluster_id) AS k FROM k)
SELECT n AS n_names, k AS n_clusters, CASE WHEN (n - k) / n < 0.01 THEN 'error' WHEN (n - k) / n < 0.05 THEN 'warn' ELSE 'pass' END AS status FROM m""")
def merge_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fuzzy.name_clusters(part_names(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_names"), F.countDistinct("cluster_id").alias("n_clusters"))
    rate = F.try_divide(F.col("n_names") - F.col("n_clusters"), F.col("n_names"))
    return got.withColumn("status", F.when(rate < 0.01, "error").when(rate < 0.05, "warn").otherwise("pass"))


BIGGEST = "list_position(embedding, list_max(embedding))"


@register("partition_metrics", f"""WITH p AS (SELECT label AS g, {BIGGEST} AS p FROM embeddings),
t AS (SELECT p, g, count(*) AS n FROM p GROUP BY 1, 2),
a AS (SELECT sum(n * (n - 1) / 2) AS tp, sum(n) AS n FROM t),
b AS (SELECT sum(n * (n - 1) / 2) AS p, sum(m) AS pure FROM (SELECT sum(n) AS n, max(n) AS m FROM t GROUP BY p)),
c AS (SELECT sum(n * (n - 1) / 2) AS g FROM (SELECT sum(n) AS n FROM t GROUP BY g))
SELECT CAST(tp AS BIGINT) AS tp_pairs, CAST(p - tp AS BIGINT) AS over_merge, CAST(g - tp AS BIGINT) AS under_merge, round(tp / p, 9) AS precision, round(tp / g, 9) AS recall,
       round(2 * tp / (p + g), 9) AS f1, round((tp - p * g / (n * (n - 1) / 2)) / ((p + g) / 2 - p * g / (n * (n - 1) / 2)), 9) AS ari, round(pure / n, 9) AS purity FROM a, b, c""")
def partition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.array_position("embedding", F.array_max("embedding")).alias("p"), F.col("label").alias("g"))
    out = metrics.partition_metrics(rows, "p", "g")
    return out.select(*[c if c in ("tp_pairs", "over_merge", "under_merge") else F.round(c, 9).alias(c) for c in out.columns])


@register("vector_separation", """WITH x AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS v FROM x GROUP BY 1, 2)
SELECT a.label AS label_a, b.label AS label_b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS cosine FROM c a JOIN c b ON a.pos = b.pos AND a.label < b.label GROUP BY 1, 2""")
def vector_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    c = vectors.class_centres(rows, "label", "embedding")
    a, b = (c.select(F.col("label").alias(f"label_{k}"), "pos", F.col("value").alias(k)) for k in "ab")
    both = a.join(b, "pos").filter("label_a < label_b").groupBy("label_a", "label_b")
    return both.agg(F.round(F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2)), 6).alias("cosine"))


SCOPED = """n AS (SELECT DISTINCT p_brand AS g, p_name AS name FROM part),
e AS (SELECT x.g, x.name AS a, y.name AS b FROM n x JOIN n y ON x.g = y.g AND x.name <> y.name AND jaro_similarity(x.name, y.name) >= 0.85),
r AS (SELECT g, name AS v, name AS u FROM n UNION SELECT r.g, r.v, e.b FROM r JOIN e ON e.g = r.g AND e.a = r.u),
l AS (SELECT g, v, min(u) AS label FROM r GROUP BY 1, 2), k AS (SELECT g, v, dense_rank() OVER (PARTITION BY g ORDER BY label) AS c FROM l)"""


@register("scoped_clusters", f"""WITH RECURSIVE {SCOPED}
SELECT g AS scope_group, v AS measure_name, CAST(c AS INTEGER) AS cluster_id, first_value(v) OVER (PARTITION BY g, c ORDER BY length(v) DESC, v) AS canonical_name, count(*) OVER (PARTITION BY g, c) AS n_members FROM k""")
def scoped_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.scoped_clusters(table(spark, sf_dir, "part"), "p_brand", "p_name")


def _probe_sql(measure: str, name: str, order: str, sign: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS k, CAST(label AS VARCHAR) AS l, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
p AS (SELECT a.k, a.l, b.k AS ok, b.l AS ol, round({measure}(a.e, b.e), 12) AS c FROM e a JOIN e b ON a.k <> b.k),
f AS (SELECT k, l, first(ol ORDER BY c {order}, ok) AS ol FROM p GROUP BY 1, 2), s AS (SELECT l FROM e GROUP BY 1 HAVING count(*) >= 2),
m AS (SELECT median(c) FILTER (l = ol) AS w, median(c) FILTER (l <> ol) AS b FROM p WHERE k < ok)
SELECT (SELECT round(avg(CAST(l = ol AS DOUBLE)), 9) FROM f WHERE l IN (SELECT l FROM s)) AS top1_nn_same_act_rate, round(w, 9) AS median_within_act_{name}, round(b, 9) AS median_between_act_{name}, round({sign} (w - b), 9) AS separation,
 (SELECT count(*) FROM e) AS n_eval_names, (SELECT count(DISTINCT l) FROM e) AS n_eval_acts FROM m"""


def _probe(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    got = neighbours.neighbour_probe(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", measure)
    return got.select(*[c if c.startswith("n_") else F.round(c, 9).alias(c) for c in got.columns])


@register("cosine_probe", _probe_sql("list_cosine_similarity", "cosine", "DESC", "+"))
def cosine_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir, "cosine")


@register("distance_probe", _probe_sql("list_distance", "distance", "ASC", "-"))
def distance_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir, "euclidean")
