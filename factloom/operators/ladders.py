"""Report ladders: metrics as formatted columns, a row for each variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.recodes import interval_cell, ratio_cell

#: Metrics of a ladder and the heads of their columns.
CLUSTER_COLUMNS = {"pairwise_precision": "Precision", "pairwise_recall": "Recall", "pairwise_f1": "F1", "ari": "ARI", "purity": "Purity"}
GATE_COLUMNS = {"coverage": "Coverage", "spurious_rate": "Spurious", "fragmentation_index": "Fragmentation", "year_alignment": "Year alignment"}


def _wide(rows: DataFrame, keys: list[str], counts: list[str], columns: dict[str, str]) -> DataFrame:
    """A row for each key with the cell of each metric; a metric that a key lacks is null, one without a value a dash."""
    cell = interval_cell(F.col("value"), F.col("ci_lo"), F.col("ci_hi"))
    cells = [F.max(F.when(F.col("metric") == m, cell)).alias(head) for m, head in columns.items()]
    return rows.filter(F.col("metric").isin(*columns)).groupBy(*keys, *counts).agg(*cells)


def cluster_ladder(metrics_long: DataFrame, tier: str = "tier1", keys: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """Clusters against gold of one tier, with the ratio of pairs merged too much and too little."""
    rows = metrics_long.filter(F.col("eval_tier") == tier)
    wide = _wide(rows, list(keys), ["over_merge_count", "under_merge_count", "n_predicted_clusters"], CLUSTER_COLUMNS)
    return wide.select(*keys, *CLUSTER_COLUMNS.values(), ratio_cell(F.col("over_merge_count"), F.col("under_merge_count")).alias("Over:Under"), F.col("n_predicted_clusters").alias("n clusters"))


def gate_ladder(metrics_long: DataFrame, gate: str, keys: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """Clusters against known acts through one gate, ``keyword`` or ``jw``."""
    if gate not in ("keyword", "jw"):
        raise ValueError(f"no gate {gate!r}")
    wide = _wide(metrics_long.filter(F.col("gate") == gate), list(keys), ["n_clusters", "n_clusters_matched", "n_rr_acts_matched"], GATE_COLUMNS)
    return wide.select(*keys, *GATE_COLUMNS.values(), F.col("n_clusters").alias("n clusters"), F.col("n_clusters_matched").alias("Clusters matched"), F.col("n_rr_acts_matched").alias("RR acts matched"))
