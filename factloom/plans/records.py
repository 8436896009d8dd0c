"""Queries of act summaries in texts and of logs of iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import act_text
from factloom.plans import register
from factloom.plans.corpus import table
from factloom.sources import iteration_logs

#: Two blocks above every document: the second has its quarters in a column, and its narrative is the document's text.
SUMMARY = (
    "Contents\nDate: 1/1/01\nII. ACT-BY-ACT SUMMARY\nFirst Act {id}\n\n33\n\nSigned: {m}/7/8{d}\nChange in Liabilities:\n198{d}Q1 +${m}.5 billion (Exogenous; Long-run)\n"
    "a note of the editor\n198{d}Q3\n-$2,000 billion\n(Endogenous; Spending-driven)\nPresent Value:\n198{d}Q1 –$1 billion\n\nThe author of the report said 2/3/87 that “a quotation of some length, no. {m}” and \"short\".\n40\n"
    "Second Act\nEffective: in due course\nChange in Liabilities (excluding retroactive changes):\n1990Q1\n1990Q2\nPresent Value: 1991Q1\n+$1 billion\n+$2 billion\n+$3 billion\n(Exogenous; Deficit-driven)\n"
)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, rest = [], SUMMARY
    values = {"{id}": F.col("doc_id").cast("string"), "{m}": (F.col("doc_id") % 12 + 1).cast("string"), "{d}": (F.col("doc_id") % 10).cast("string")}
    while rest:
        at = min((rest.find(k), k) for k in values if k in rest) if any(k in rest for k in values) else (len(rest), "")
        parts.append(F.lit(rest[: at[0]]))
        if at[1]:
            parts.append(values[at[1]])
        rest = rest[at[0] + len(at[1]) :]
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), '["“”]', "")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts, plain).alias("text"))


@register("act_summaries", """SELECT doc_id, 1 AS block, 'First Act ' || doc_id AS act_name, '198' || doc_id % 10 || '-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-07' AS date_signed, 'Long-run' AS category, 3 AS n_changes, 1 AS n_labels FROM documents
UNION ALL SELECT doc_id, 2, 'Second Act', 'in due course', 'Deficit-driven', 3, 0 FROM documents""")
def act_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = act_text.read_acts(summaries(spark, sf_dir), "doc_id", "text")
    return acts.select("doc_id", F.col("block").cast("int").alias("block"), "act_name", "date_signed", "category", F.size("changes").alias("n_changes"), F.size("labels").alias("n_labels"))


@register("act_changes", """WITH d AS (SELECT doc_id, doc_id % 12 + 1 AS m, '198' || doc_id % 10 AS y FROM documents)
SELECT doc_id, 1 AS block, 1 AS place, 'standard' AS section, y || '-01' AS quarter, m + 0.5::DOUBLE AS amount, 'Long-run' AS category FROM d
UNION ALL SELECT doc_id, 1, 2, 'standard', y || '-03', -2000.0::DOUBLE, 'Spending-driven' FROM d UNION ALL SELECT doc_id, 1, 3, 'present_value', y || '-01', -1.0::DOUBLE, NULL FROM d
UNION ALL SELECT doc_id, 2, 1, 'standard', '1990-01', 1.0::DOUBLE, 'Deficit-driven' FROM d UNION ALL SELECT doc_id, 2, 2, 'standard', '1990-02', 2.0::DOUBLE, NULL FROM d UNION ALL SELECT doc_id, 2, 3, 'present_value', '1991-01', 3.0::DOUBLE, NULL FROM d""")
def act_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = act_text.act_changes(act_text.read_acts(summaries(spark, sf_dir), "doc_id", "text"), "doc_id")
    return got.select("doc_id", F.col("block").cast("int").alias("block"), "place", "section", "quarter", "amount", "category")


@register("act_labels", """SELECT doc_id, 'a quotation of some length, no. ' || (doc_id % 12 + 1) AS quote, 'The author of the report' AS source, '2/3/87' AS date, 'Exogenous' AS exogeneity FROM documents""")
def act_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = act_text.act_labels(act_text.read_acts(summaries(spark, sf_dir), "doc_id", "text"), "doc_id")
    return got.select("doc_id", "quote", "source", "date", "exogeneity")


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry of a log for each order: its stage by the key, its values by price and priority."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    number = k.cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('{"stage":"s1","iteration":'), number, F.lit(',"date":"2020-01-02","results":{"overall_pass":true,"metrics":[{"test":"I","value":'), p.cast("string"), F.lit(',"pass":true},{"test":"IV","value":"n/a","fleiss_kappa":0.5,"skipped":true}]}}')))
        .when(k % 4 == 1, F.concat(F.lit('{"stage":"s2","iteration":'), number, F.lit(',"model":"m","results":{"metrics":[{"metric":"f1","value":'), p.cast("string"), F.lit(',"ci_lower":0.1},{"note":"none"}],"secondary_metrics":[{"metric":"recall","value":1}],"per_class_f1":{"A":0.5,"B":"x"},"confusion_matrix":{"tp":3,"fp":1,"fn":0,"tn":2}}}')))
        .when(k % 4 == 2, F.concat(F.lit('{"stage":"s3","iteration":'), number, F.lit(',"results":{"metrics":[{"test":"V_exclusion_criteria","combos":{"normal":'), p.cast("string"), F.lit('},"overall_consistency":0.75},{"test":"VI_generic_labels","original_f1":0.5,"overall_consistency":1},{"test":"other","change_rate":1}],"ablation":[{"condition":"full","accuracy":0.9,"weighted_f1":0.8,"f1":0.7},{"note":"n"}]}}')))
        .otherwise(F.concat(F.lit('{"stage":"s2","iteration":'), number, F.lit(',"results":{"metrics":{"note":"extraction only"}}}')))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("codebook"), text.alias("entry"))


def _log_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return iteration_logs.iteration_tables(log_rows(spark, sf_dir))[name]


@register("log_meta", """SELECT o_orderpriority AS codebook, CAST(o_orderkey AS INTEGER) AS iteration, ['s1', 's2', 's3', 's2'][o_orderkey % 4 + 1] AS stage, CASE WHEN o_orderkey % 4 = 0 THEN DATE '2020-01-02' END AS date, CASE WHEN o_orderkey % 4 = 0 THEN TRUE END AS overall_pass, CASE WHEN o_orderkey % 4 = 1 THEN 'm' END AS model FROM orders""")
def log_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_table(spark, sf_dir, "meta").select("codebook", "iteration", "stage", "date", "overall_pass", "model")


@register("log_first_stage", """SELECT o_orderpriority AS codebook, CAST(o_orderkey AS INTEGER) AS iteration, 1 AS place, 'I' AS test, round(CAST(o_totalprice AS DOUBLE), 6) AS value, TRUE AS pass, FALSE AS skipped, NULL::DOUBLE AS fleiss_kappa FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderpriority, CAST(o_orderkey AS INTEGER), 2, 'IV', NULL, NULL, TRUE, 0.5::DOUBLE FROM orders WHERE o_orderkey % 4 = 0""")
def log_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_table(spark, sf_dir, "s1").select("codebook", "iteration", "place", "test", F.round("value", 6).alias("value"), "pass", "skipped", "fleiss_kappa")


@register("log_second_stage", """SELECT o_orderpriority AS codebook, CAST(o_orderkey AS INTEGER) AS iteration, 1 AS place, 'f1' AS metric, round(CAST(o_totalprice AS DOUBLE), 6) AS value, 0.1::DOUBLE AS ci_lower FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderpriority, CAST(o_orderkey AS INTEGER), 3, 'recall', 1.0::DOUBLE, NULL FROM orders WHERE o_orderkey % 4 = 1""")
def log_second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_table(spark, sf_dir, "s2").select("codebook", "iteration", "place", "metric", F.round("value", 6).alias("value"), "ci_lower")


@register("log_classes", """SELECT o_orderpriority AS codebook, CAST(o_orderkey AS INTEGER) AS iteration, 'A' AS class, 0.5::DOUBLE AS f1 FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderpriority, CAST(o_orderkey AS INTEGER), 'B', NULL FROM orders WHERE o_orderkey % 4 = 1""")
def log_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_table(spark, sf_dir, "s2_per_class").select("codebook", "iteration", "class", "f1")


@register("log_third_stage", """SELECT o_orderpriority AS codebook, CAST(o_orderkey AS INTEGER) AS iteration, 'V_exclusion_criteria' AS test, 'combo_normal' AS field, round(CAST(o_totalprice AS DOUBLE), 6) AS value FROM orders WHERE o_orderkey % 4 = 2
UNION ALL SELECT o_orderpriority, CAST(o_orderkey AS INTEGER), 'V_exclusion_criteria', 'overall_consistency', 0.75::DOUBLE FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT o_orderpriority, CAST(o_orderkey AS INTEGER), 'VI_generic_labels', 'original_f1', 0.5::DOUBLE FROM orders WHERE o_orderkey % 4 = 2""")
def log_third_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_table(spark, sf_dir, "s3").select("codebook", "iteration", "test", "field", F.round("value", 6).alias("value"))
