"""Queries of composed evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluation, resampling
from factloom.plans import register
from factloom.plans.corpus import table
from factloom.plans.scores import GUESS, JOINED, joined, rounded


@register("multiclass_totals", f"""WITH p AS (SELECT {GUESS} AS p, lang AS y FROM documents), l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS level),
c AS (SELECT level, count(*) FILTER (p = level AND y = level) AS tp, count(*) FILTER (p = level AND y IS NOT NULL) AS called, count(*) FILTER (y = level AND p IS NOT NULL) AS known, count(*) FILTER (y = level) AS support FROM l, p GROUP BY level),
f AS (SELECT support, CASE WHEN tp > 0 THEN 2 * (tp / called) * (tp / known) / (tp / called + tp / known) END AS f1 FROM c)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT count(*) FILTER (p = y) / count(*) FROM p), 9) AS accuracy, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(avg(f1), 9) AS macro_f1 FROM f""")
def multiclass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    guess = F.when(F.contains(t, F.lit(" der ")), "de").when(F.contains(t, F.lit(" el ")), "es").when(F.contains(t, F.lit(" le ")), "fr").otherwise("en")
    rows = table(spark, sf_dir, "documents").select(guess.alias("p"), F.col("lang").alias("y"))
    return rounded(evaluation.multiclass_totals(rows, "p", "y", ["de", "en", "es", "fr"]), "accuracy", "weighted_f1", "macro_f1")


@register("chunk_evaluation", f"""WITH {JOINED},
r AS (SELECT CASE WHEN n % 7 = 0 THEN NULL WHEN marks THEN 'NOT_FISCAL_MEASURE' ELSE 'FISCAL_MEASURE' END AS p, CASE WHEN quality = 1 THEN 'FISCAL_MEASURE' ELSE 'NOT_FISCAL_MEASURE' END AS y,
 CASE WHEN n % 3 = 0 THEN NULL ELSE n % 3 END AS tier, CASE WHEN n % 5 = 0 THEN NULL ELSE n % 5 END AS k FROM j),
f AS (SELECT * FROM r WHERE k IS NULL OR k = 1),
v AS (SELECT p = 'FISCAL_MEASURE' AS p, y = 'FISCAL_MEASURE' AS y, tier FROM f WHERE p IS NOT NULL),
c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn,
 avg(CAST(p AS DOUBLE)) FILTER (tier = 1) AS t1, avg(CAST(p AS DOUBLE)) FILTER (tier = 2) AS t2, count(*) AS n_valid FROM v)
SELECT (SELECT count(*) FROM f) AS n_total, round(t1, 9) AS tier1_recall, round(t2, 9) AS tier2_recall, n_valid, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tp / nullif(tp + fp, 0), 9) AS precision,
 round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy, round(tn / nullif(tn + fp, 0), 9) AS specificity FROM c""")
def chunk_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = joined(spark, sf_dir).select(
        F.when(n % 7 == 0, None).when(F.col("marks"), "NOT_FISCAL_MEASURE").otherwise("FISCAL_MEASURE").alias("p"),
        F.when(F.col("quality") == 1, "FISCAL_MEASURE").otherwise("NOT_FISCAL_MEASURE").alias("y"),
        F.when(n % 3 != 0, n % 3).alias("tier"), F.when(n % 5 != 0, n % 5).alias("measure_rank"),
    )
    found = evaluation.evaluate_chunks(rows, "p", "y", "FISCAL_MEASURE")
    return rounded(found, "recall", "precision", "f1", "accuracy", "specificity", "tier1_recall", "tier2_recall")


DETECTED = f"WITH {JOINED}, d AS (SELECT coalesce(NOT marks AND least(n, 5000) / 5000 >= 0.5, false) AS p, quality = 1 AS y, least(n, 5000) / 5000 AS c FROM j)"


@register("detector_metrics", f"""{DETECTED}, c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM d)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tp / nullif(tp + fp, 0), 9) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1,
 round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy, round(tn / nullif(tn + fp, 0), 9) AS specificity FROM c""")
def detector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_detected(spark, sf_dir)[0], "recall", "precision", "f1", "accuracy", "specificity")


@register("detector_calibration", f"{DETECTED} SELECT nullif(CAST(ceil(c * 10) AS INTEGER), 0) AS bin, count(*) AS n, round(avg(CAST(p = y AS DOUBLE)), 9) AS accuracy FROM d GROUP BY 1")
def detector_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_detected(spark, sf_dir)[1], "accuracy")


def _detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = joined(spark, sf_dir).select((~F.col("marks")).alias("says"), (F.least("n", F.lit(5000)) / 5000).alias("c"), (F.col("quality") == 1).alias("y"))
    return evaluation.evaluate_detector(rows, "says", "c", "y")


ACTS = f"WITH {JOINED}, a AS (SELECT CASE WHEN n % 7 = 0 THEN NULL ELSE NOT marks END AS p, quality = 1 AS y, ['+', '-', '0', 'UNCLEAR'][n % 4 + 1] AS ps, ['+', '-'][doc_id % 2 + 1] AS ts, n FROM j)"


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.element_at(F.array(*[F.lit(x) for x in ("+", "-", "0", "UNCLEAR")]), (F.col("n") % 4 + 1).cast("int"))
    called = F.when(F.col("n") % 7 != 0, ~F.col("marks"))
    return joined(spark, sf_dir).select("doc_id", "n", called.alias("p"), (F.col("quality") == 1).alias("y"), sign.alias("ps"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("ts"))


@register("act_evaluation", f"""{ACTS}, c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (p = y) AS ok, count(*) FILTER (p IS NOT NULL AND y IS NOT NULL) AS n,
 count(*) FILTER (y) AS t, count(*) FILTER (y AND ps = ts AND ps <> 'UNCLEAR') AS s, count(*) FILTER (y AND p AND ps = ts AND ps <> 'UNCLEAR') AS sp FROM a)
SELECT unnest(['exo_precision', 'exo_recall', 'exo_f1', 'exo_accuracy', 'sign_acc_on_true_exo', 'signed_exo_precision']) AS metric,
 unnest([round(tp / nullif(tp + fp, 0), 9), round(tp / nullif(tp + fn, 0), 9), round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), round(ok / nullif(n, 0), 9), round(s / nullif(t, 0), 9), round(sp / nullif(t, 0), 9)]) AS value FROM c""")
def act_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point values of ``act_intervals``: the intervals are resampled by hashes that SQL does not have."""
    return rounded(act_intervals(spark, sf_dir), "value").select("metric", "value")


@register("act_intervals")
def act_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.rate_intervals(_acts(spark, sf_dir), "doc_id", resampling.act_rates("p", "y", "ps", "ts"))


@register("act_quality_flags", f"{ACTS} SELECT count(*) AS n_total, CAST(sum(n % 3) AS BIGINT) AS n_failures, count(*) FILTER (p IS NULL) AS n_na_exo, count(*) FILTER (ps IS NULL) AS n_na_pred_sign, count(*) FILTER (n % 4 = 3) AS n_na_pred_label FROM a")
def act_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _acts(spark, sf_dir).withColumn("failures", F.col("n") % 3).withColumn("label", F.when(F.col("n") % 4 != 3, "x"))
    return resampling.quality_flags(rows, "p", "ps", "label", "failures")


@register("gold_intervals")
def gold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return resampling.cluster_intervals(parts, parts, "p_name", "p_brand", "p_type", "p_partkey")


@register("gate_intervals")
def gate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("v"), (F.col("o_custkey") % 40).alias("c"), F.month("o_orderdate").alias("a"),
        (F.col("o_totalprice") > 250000).alias("p"), (F.col("o_totalprice") > 200000).alias("np"), (F.col("o_orderkey") % 2 == 0).alias("y"),
    )
    acts = spark.range(1, 13).select(F.col("id").cast("int").alias("a"))
    return resampling.gate_intervals(m, m, acts, "v", "c", "a", "p", "np", "y")


#: Chunks of orders with a label, a true label, a tier, a rank, an act and a measure's name.
CHUNKS = """k AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_totalprice > 150000 THEN 'P' ELSE 'N' END AS p, CASE WHEN o_orderstatus = 'F' THEN 'P' ELSE 'N' END AS y, nullif(o_orderkey % 3, 0) AS tier, nullif(o_orderkey % 5, 0) AS measure_rank,
 'Act ' || (o_custkey % 50) AS act, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS chunk, CASE o_orderkey % 4 WHEN 0 THEN 'act 1' WHEN 1 THEN 'The ACT ' || (o_custkey % 50) || ' of Spring' WHEN 2 THEN NULL ELSE 'other' END AS measure FROM orders),
f AS (SELECT * FROM k WHERE (measure_rank IS NULL OR measure_rank = 1) AND p IS NOT NULL)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, own = F.col("o_orderkey"), (F.col("o_custkey") % 50).cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("key"), F.when(k % 7 == 0, None).when(F.col("o_totalprice") > 150000, "P").otherwise("N").alias("p"), F.when(F.col("o_orderstatus") == "F", "P").otherwise("N").alias("y"),
        F.nullif(k % 3, F.lit(0)).alias("tier"), F.nullif(k % 5, F.lit(0)).alias("measure_rank"), F.concat(F.lit("Act "), own).alias("act"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("chunk"),
        F.when(k % 4 == 0, "act 1").when(k % 4 == 1, F.concat(F.lit("The ACT "), own, F.lit(" of Spring"))).when(k % 4 == 3, "other").alias("measure"),
    )


@register("chunk_points", f"""WITH {CHUNKS}, c AS (SELECT count(*) FILTER (p = 'P' AND y = 'P') AS tp, count(*) FILTER (p = 'P' AND y = 'N') AS fp, count(*) FILTER (p = 'N' AND y = 'P') AS fn, count(*) FILTER (p = 'N' AND y = 'N') AS tn,
 avg(CAST(p = 'P' AS DOUBLE)) FILTER (tier = 1) AS t1, avg(CAST(p = 'P' AS DOUBLE)) FILTER (tier = 2) AS t2 FROM f)
SELECT unnest(['recall', 'precision', 'f1', 'accuracy', 'specificity', 'tier1_recall', 'tier2_recall']) AS metric,
 unnest([round(tp / (tp + fn), 9), round(tp / (tp + fp), 9), round(2 * tp / (2 * tp + fp + fn), 9), round((tp + tn) / (tp + fp + fn + tn), 9), round(tn / (tn + fp), 9), round(t1, 9), round(t2, 9)]) AS value FROM c""")
def chunk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point values of ``chunk_intervals``, by the same call."""
    return rounded(evaluation.chunk_intervals(chunks(spark, sf_dir), "p", "y", "P", "key", replicates=1), "value").select("metric", "value")


@register("chunk_intervals")
def chunk_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chunk_intervals(chunks(spark, sf_dir), "p", "y", "P", "key")


@register("chunk_errors", f"WITH {CHUNKS} SELECT key, act, year, tier, y, p FROM f WHERE p <> y")
def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chunk_errors(chunks(spark, sf_dir), "p", "y").select("key", "act", "year", "tier", "y", "p")


@register("act_chunk_recall", f"""WITH {CHUNKS} SELECT act, year, count(*) AS n_chunks, count(*) FILTER (tier = 1) AS n_tier1, count(*) FILTER (tier = 2) AS n_tier2, count(*) FILTER (p = y) AS n_correct, round(count(*) FILTER (p = y) / count(*), 9) AS recall FROM f WHERE y = 'P' GROUP BY 1, 2""")
def act_chunk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.act_chunk_recall(chunks(spark, sf_dir), "p", "y", "P", "act", "year"), "recall")


@register("measured_act_recall", f"""WITH {CHUNKS}, c AS (SELECT act, chunk, coalesce(bool_or(contains(lower(act), lower(measure)) OR contains(lower(measure), lower(act))), FALSE) AS named FROM k WHERE tier = 1 AND y = 'P' GROUP BY 1, 2)
SELECT act, count(*) AS n_chunks, count(*) FILTER (named) AS n_recalled, round(count(*) FILTER (named) / count(*), 9) AS recall FROM c GROUP BY 1""")
def measured_act_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.measured_act_recall(chunks(spark, sf_dir), "y", "P", "act", ["chunk"], "measure"), "recall")


@register("extraction_metrics", """WITH x AS (SELECT trim(regexp_replace(regexp_replace(lower(p_name), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS n, p_size FROM part),
e AS (SELECT n FROM x WHERE p_size < 25), k AS (SELECT n FROM x WHERE p_size >= 25),
h AS (SELECT a.n AS en, b.n AS kn FROM (SELECT DISTINCT n FROM e) a, (SELECT DISTINCT n FROM k) b WHERE a.n = b.n OR jaro_similarity(a.n, b.n) >= 0.85),
c AS (SELECT (SELECT count(*) FROM e WHERE n IN (SELECT en FROM h)) AS tp, (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM k WHERE n NOT IN (SELECT kn FROM h)) AS fn, (SELECT count(*) FROM k) AS nk)
SELECT tp AS true_positives, ne - tp AS false_positives, ne AS n_extracted, fn AS false_negatives, nk AS n_known, round(tp / ne, 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / ne) * (tp / (tp + fn)) / (tp / ne + tp / (tp + fn)), 9) AS f1_score FROM c""")
def extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    got = evaluation.matched_extraction(parts.filter("p_size < 25"), parts.filter("p_size >= 25"), "p_name")
    return rounded(evaluation.extraction_metrics(*got), "precision", "recall", "f1_score")


MOTIVATIONS = ["Spending-driven", "Countercyclical", "Deficit-driven", "Long-run"]
LEFT_OUT = f"""m AS (SELECT {MOTIVATIONS}[o_orderkey % 4 + 1] AS p, {MOTIVATIONS}[CASE WHEN o_custkey % 3 = 0 THEN o_orderkey ELSE o_custkey END % 4 + 1] AS y FROM orders WHERE o_orderkey % 11 > 0), b AS (SELECT *, p IN ('Deficit-driven', 'Long-run') AS e, y IN ('Deficit-driven', 'Long-run') AS t FROM m)"""


def _left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in MOTIVATIONS])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p, y = (F.get(names, (x % 4).cast("int")) for x in (k, F.when(c % 3 == 0, k).otherwise(c)))
    rows = table(spark, sf_dir, "orders").select(k.alias("key"), F.when(k % 11 > 0, p).alias("p"), y.alias("y"))
    return rows.select("*", F.col("p").isin("Deficit-driven", "Long-run").alias("e"), F.col("y").isin("Deficit-driven", "Long-run").alias("t"))


@register("left_out_points", f"""WITH {LEFT_OUT}, c AS (SELECT x.c, count(*) FILTER (p = x.c AND y = x.c) AS tp, count(*) FILTER (p = x.c) AS called, count(*) FILTER (y = x.c) AS known FROM b, (SELECT unnest({MOTIVATIONS}) AS c) x GROUP BY 1),
s AS (SELECT avg(CAST(p = y AS DOUBLE)) AS a, avg(CAST(e = t AS DOUBLE)) AS ea, count(*) FILTER (e AND t) / count(*) FILTER (e) AS ep, count(*) FILTER (e AND t) / count(*) FILTER (t) AS er, (SELECT avg(CASE WHEN tp > 0 THEN 2.0 * tp / (called + known) END) FROM c) AS f FROM b)
SELECT unnest(['accuracy', 'exogenous_accuracy', 'exogenous_precision', 'exogenous_recall', 'macro_f1']) AS metric, unnest([round(a, 9), round(ea, 9), round(ep, 9), round(er, 9), round(f, 9)]) AS value FROM s""")
def left_out_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point values of ``left_out_intervals``, by the same call."""
    got = evaluation.left_out_evaluation(_left_out(spark, sf_dir), "key", "p", "y", "e", "t", MOTIVATIONS, replicates=1)
    return rounded(got, "value").select("metric", "value")


@register("left_out_intervals")
def left_out_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.left_out_evaluation(_left_out(spark, sf_dir), "key", "p", "y", "e", "t", MOTIVATIONS, replicates=200)
