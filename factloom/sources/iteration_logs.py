"""Logs of a codebook's iterations as nine tables.

An entry is one JSON object of a stage; what its results hold depends on the
stage and has changed over time. Entries are parsed once, as variants, and each
table is a projection of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import written

#: Fields of an entry, of a metric of the first and second stage, of the tests of the third, of an ablation.
META = ("codebook_version", "date", "git_commit", "model", "provider", "stage", "condition", "changes", "interpretation", "decision")
FIRST_STAGE = {"test": "string", "value": "double", "threshold": "double", "pass": "boolean", "skipped": "boolean", "change_rate_reversed": "double", "change_rate_shuffled": "double", "fleiss_kappa": "double", "kappa_interpretation": "string"}
SECOND_STAGE = {"metric": "string", "value": "double", "ci_lower": "double", "ci_upper": "double", "target": "double", "pass": "boolean"}
PER_CLASS = {"class": "string", "precision": "double", "recall": "double", "f1": "double", "support": "int"}
TEST_FIELDS = {
    "V_exclusion_criteria": ("overall_consistency", "all_combos_correct_rate", "filtered_all_combos_correct_rate"),
    "VI_generic_labels": ("original_accuracy", "generic_accuracy", "accuracy_difference", "change_rate", "original_f1", "generic_f1", "f1_difference", "original_weighted_f1", "generic_weighted_f1"),
    "VII_swapped_labels": ("follows_definitions_rate", "follows_names_rate", "swapped_accuracy", "swapped_f1", "swapped_weighted_f1"),
}
ABLATION = {"condition": "string", "note": "string", "accuracy": "double", "f1": "double", "weighted_f1": "double", "accuracy_drop": "double", "f1_drop": "double", "weighted_f1_drop": "double", "recall": "double", "precision": "double", "tier1_recall": "double", "tier2_recall": "double"}
MANUAL = {"category": "string", "count": "int", "pct": "double"}
CORRECTED = ("accuracy", "precision", "recall", "tier1_recall", "tier2_recall", "specificity")
CELLS = ("tp", "fp", "fn", "tn")

Tables = dict[str, DataFrame]


def log_entries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``codebook`` and ``entry`` (JSON) of the logs, one file a codebook: JSON, or YAML if a reader of it is installed. Logs are small files, read on the driver."""
    rows = []
    for codebook, path in paths.items():
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            log = json.loads(text)
        else:
            import yaml

            log = yaml.safe_load(text)
        if not isinstance(log, dict) or log.get("iterations") is None:
            raise ValueError(f"no 'iterations' in {path}")
        rows += [(codebook, json.dumps(e, default=str)) for e in log["iterations"]]
    return spark.createDataFrame(rows, "codebook string, entry string")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_v", f"$.{path}", kind)


def _number(text: Column, kind: str) -> Column:
    """A field by itself: what is no number (or truth value) is null, whatever stands beside it."""
    return text if kind == "string" else text.try_cast("double").cast("int") if kind == "int" else text.try_cast(kind)


def _listed(path: str, fields: dict[str, str]) -> Column:
    """A list of objects, fields as text; null if there is none, or something else than a list."""
    return _get(path, f"array<struct<{', '.join(f'`{f}`:string' for f in fields)}>>")


def _exploded(rows: DataFrame, path: str, fields: dict[str, str], *keep: str) -> DataFrame:
    each = rows.select(*keep, F.posexplode(_listed(path, fields)).alias("place", "_m"))
    return each.select(*keep, (F.col("place") + 1).alias("place"), *[_number(F.col("_m")[f], kind).alias(f) for f, kind in fields.items()])


def iteration_tables(entries: DataFrame) -> Tables:
    """Nine tables of ``codebook`` and ``entry``: meta, s1, s2, s2_per_class, s2_confusion, s3, s3_ablation, s3_manual, s3_manual_bias_corrected.

    An entry that is no JSON object gives no rows. Lists of metrics that are
    only a note, and notes among them, are left out. ``place`` is the place in
    the entry's own list, from 1.
    """
    parsed = entries.select("codebook", F.try_parse_json("entry").alias("_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    iteration = _number(_get("iteration"), "int").alias("iteration")
    rows = written(parsed.select("codebook", iteration, _get("model").alias("model"), _get("stage").alias("stage"), _get("condition").alias("condition"), F.to_json("_v").alias("_j")), "entries")
    rows = rows.withColumn("_v", F.parse_json("_j"))
    key = ("codebook", "iteration", "model")
    first, second, third, manual = (rows.filter(F.col("stage") == s) for s in ("s1", "s2", "s3", "s3_manual_analysis"))

    fields = [_get(f).try_cast("date").alias(f) if f == "date" else _get(f).alias(f) for f in META]
    meta = rows.select("codebook", "iteration", *fields, _number(_get("results.overall_pass"), "boolean").alias("overall_pass"))
    s1 = _exploded(first, "results.metrics", FIRST_STAGE, *key).withColumn("skipped", F.coalesce("skipped", F.lit(False)))

    # the second list of metrics counts on after the first, of an entry that has the first
    counted = second.filter(_listed("results.metrics", SECOND_STAGE).isNotNull())
    main = _exploded(counted, "results.metrics", SECOND_STAGE, *key, "condition")
    more = _exploded(counted.withColumn("_first", F.size(_listed("results.metrics", SECOND_STAGE))), "results.secondary_metrics", SECOND_STAGE, *key, "condition", "_first")
    more = more.withColumn("place", F.col("place") + F.col("_first")).drop("_first")
    s2 = main.unionByName(more).filter("metric IS NOT NULL OR value IS NOT NULL")
    classes = _exploded(counted, "results.per_class", PER_CLASS, "codebook", "iteration").drop("place")
    plain = counted.filter(F.coalesce(F.size(_listed("results.per_class", PER_CLASS)), F.lit(0)) <= 0)
    named = plain.select("codebook", "iteration", F.explode(_get("results.per_class_f1", "map<string,string>")).alias("class", "f1"))
    named = named.select("codebook", "iteration", "class", F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), F.col("f1").try_cast("double").alias("f1"), F.lit(None).cast("int").alias("support"))
    confusion = counted.select("codebook", "iteration", *[_number(_get(f"results.confusion_matrix.{c}"), "int").alias(c) for c in CELLS]).filter("tp IS NOT NULL")

    scalars = sorted({f for listed in TEST_FIELDS.values() for f in listed})
    tests = third.select(*key, F.explode(_get("results.metrics", f"array<struct<test:string, combos:map<string,string>, {', '.join(f'{f}:string' for f in scalars)}>>")).alias("_m"))
    wanted = F.lit(False)
    for test, listed in TEST_FIELDS.items():
        wanted = wanted | ((F.col("test") == test) & F.col("field").isin(*listed))
    values = tests.select(*key, F.col("_m.test").alias("test"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("_m")[f].alias("_x")) for f in scalars])).alias("_f")).select(*key, "test", "_f.*")
    combos = tests.filter(F.col("_m.test") == "V_exclusion_criteria").select(*key, F.col("_m.test").alias("test"), F.explode("_m.combos").alias("_k", "_x")).select(*key, "test", F.concat(F.lit("combo_"), "_k").alias("field"), "_x")
    s3 = values.filter(wanted & F.col("_x").isNotNull()).unionByName(combos).select(*key, "test", "field", F.col("_x").try_cast("double").alias("value"))
    s3 = s3.filter((F.col("test") != "V_exclusion_criteria") | F.startswith("field", F.lit("combo_")) | F.col("value").isNotNull())
    # an entry's ablation counts only beside its metrics
    ablation = _exploded(third.filter(F.schema_of_variant(F.try_variant_get("_v", "$.results.metrics", "variant")).isNotNull()), "results.ablation", ABLATION, *key)
    ablation = ablation.filter("note IS NULL OR accuracy IS NOT NULL").select(
        *key, "condition", "accuracy", F.coalesce("weighted_f1", "f1").alias("f1"), "accuracy_drop", F.coalesce("weighted_f1_drop", "f1_drop").alias("f1_drop"), "recall", "precision", "tier1_recall", "tier2_recall"
    )
    categories = _exploded(manual, "results.category_distribution", MANUAL, *key).drop("place")
    at = "results.bias_corrected_metrics"
    corrected = manual.filter(F.try_variant_get("_v", f"$.{at}", "variant").isNotNull()).select(
        *key, _number(_get(f"{at}.effective_n"), "int").alias("effective_n"), *[_number(_get(f"{at}.confusion_matrix.{c}"), "int").alias(c) for c in CELLS], *[_number(_get(f"{at}.{f}"), "double").alias(f) for f in CORRECTED]
    )
    return {
        "meta": meta, "s1": s1, "s2": s2, "s2_per_class": classes.unionByName(named), "s2_confusion": confusion, "s3": s3, "s3_ablation": ablation,
        "s3_manual": categories, "s3_manual_bias_corrected": corrected,
    }
