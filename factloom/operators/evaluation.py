"""Composed evaluations (M06, M07, M12): metrics of classified chunks by tier and threshold, totals over classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_name
from factloom.operators import fuzzy, metrics, resampling
from factloom.operators.matching import contains_either


def multiclass_totals(rows: DataFrame, predicted: str, actual: str, levels: list[str]) -> DataFrame:
    """Accuracy over all rows (null is wrong), F1 weighted by support, and mean F1 of the levels that have one."""
    totals = rows.agg(F.count_if(F.col(predicted) == F.col(actual)).alias("_right"), F.count(F.lit(1)).alias("n"))
    per = metrics.class_metrics(rows, predicted, actual, levels)
    f1s = per.agg(metrics.ratio(F.coalesce(F.sum(F.col("f1") * F.col("support")), F.lit(0.0)), F.sum("support")).alias("weighted_f1"), F.avg("f1").alias("macro_f1"))
    # one row each
    return totals.crossJoin(f1s).select("n", metrics.ratio(F.col("_right"), F.col("n")).alias("accuracy"), "weighted_f1", "macro_f1")


def evaluate_chunks(results: DataFrame, predicted: str, actual: str, positive: str, tier: str = "tier", rank: str = "measure_rank") -> DataFrame:
    """Binary metrics of chunk labels and the recall of each tier.

    Of a chunk's measures the first counts, and rows without a rank; rows
    without a prediction are counted and left out of the metrics.
    """
    first = results.filter(F.col(rank).isNull() | (F.col(rank) == 1))
    valid = first.filter(F.col(predicted).isNotNull())
    rows = valid.select(F.lit(0).alias("_all"), (F.col(predicted) == positive).alias("p"), (F.col(actual) == positive).alias("y"), F.col(tier).alias("tier"))
    point = metrics.binary_metrics(rows, "p", "y", "_all")
    tiers = rows.agg(*[F.avg(F.when(F.col("tier") == t, F.col("p").cast("double"))).alias(f"tier{t}_recall") for t in (1, 2)], F.count(F.lit(1)).alias("n_valid"))
    total = first.agg(F.count(F.lit(1)).alias("n_total"))
    # one row each
    return total.crossJoin(tiers).crossJoin(point.drop("_all"))


def evaluate_detector(rows: DataFrame, says: str, confidence: str, actual: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Metrics of a detector that is believed from a confidence on, and its calibration by bins of confidence."""
    called = F.coalesce(F.col(says) & (F.col(confidence) >= threshold), F.lit(False))
    judged = rows.select(F.lit(0).alias("_all"), called.alias("p"), F.col(actual).alias("y"), F.col(confidence).alias("c"))
    point = metrics.binary_metrics(judged, "p", "y", "_all").drop("_all")
    return point, metrics.calibration_bins(judged.select("c", (F.col("p") == F.col("y")).alias("ok")), "c", "ok")


def first_measures(results: DataFrame, predicted: str, rank: str = "measure_rank") -> DataFrame:
    """The rows that count: first measures and rows without a rank, with a prediction."""
    return results.filter((F.col(rank).isNull() | (F.col(rank) == 1)) & F.col(predicted).isNotNull())


def chunk_rates(predicted: Column, actual: Column, tier: Column, positive: str) -> resampling.Rates:
    """The rates of chunk labels as sums over sums, for ``resampling.rate_intervals``."""
    one = resampling.one
    p, y = predicted == positive, actual == positive
    return {
        "recall": (one(p & y), one(y)), "precision": (one(p & y), one(p)), "f1": (2 * one(p & y), one(p) + one(y)), "accuracy": (one(p == y), F.lit(1.0)),
        "specificity": (one(~p & ~y), one(~y)), "tier1_recall": (one(p & (tier == 1)), one(tier == 1)), "tier2_recall": (one(p & (tier == 2)), one(tier == 2)),
    }


def chunk_intervals(results: DataFrame, predicted: str, actual: str, positive: str, key: str, tier: str = "tier", rank: str = "measure_rank", **how) -> DataFrame:
    """Metric, value, low, high of each rate of chunk labels, by resampled chunks. ``key`` numbers the rows."""
    rows = first_measures(results, predicted, rank)
    return resampling.rate_intervals(rows, key, chunk_rates(F.col(predicted), F.col(actual), F.col(tier), positive), **how)


def chunk_errors(results: DataFrame, predicted: str, actual: str, rank: str = "measure_rank") -> DataFrame:
    """The rows that count and are wrong, as they are. A null true label is no error that can be told."""
    return first_measures(results, predicted, rank).filter(F.col(predicted) != F.col(actual))


def act_chunk_recall(results: DataFrame, predicted: str, actual: str, positive: str, act: str, year: str, tier: str = "tier", rank: str = "measure_rank") -> DataFrame:
    """M06, by act: its truly positive chunks, how many of each tier, how many are called so, and their share."""
    own = first_measures(results, predicted, rank).filter(F.col(actual) == positive)
    right = F.count_if(F.col(predicted) == F.col(actual))
    counts = own.groupBy(act, year).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col(tier) == 1).alias("n_tier1"), F.count_if(F.col(tier) == 2).alias("n_tier2"), right.alias("n_correct"))
    return counts.withColumn("recall", metrics.ratio(F.col("n_correct"), F.col("n_chunks")))


def measured_act_recall(results: DataFrame, actual: str, positive: str, act: str, chunk: list[str], measure: str, tier: str = "tier") -> DataFrame:
    """M06, by act: the chunks of the first tier, and how many of them name the act among all their measures.

    A measure names the act if one of both names holds the other, ignoring
    case; all ranks count; a chunk without named measures names none.
    """
    own = results.filter((F.col(tier) == 1) & (F.col(actual) == positive))
    named = F.coalesce(F.max(contains_either(F.col(act), F.col(measure))), F.lit(False))
    chunks = own.groupBy(act, *chunk).agg(named.alias("_named"))
    counts = chunks.groupBy(act).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("_named")).alias("n_recalled"))
    return counts.withColumn("recall", metrics.ratio(F.col("n_recalled"), F.col("n_chunks")))


def matched_extraction(extracted: DataFrame, known: DataFrame, name: str, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``found``: whether a name of the other side is equal or similar, after P05.

    Every row is judged by itself: one known act may make several extracted
    ones right. Null names are not found.
    """
    a, b = (t.withColumn("_plain", normalize_name(F.col(name))) for t in (extracted, known))
    pairs = fuzzy.similar_across(a.select("_plain"), b.select("_plain"), least, "_plain", "_plain").select("_a", "_b")

    def marked(rows: DataFrame, side: str) -> DataFrame:
        hit = pairs.select(F.col(side).alias("_hit")).distinct()
        return rows.join(hit, F.col("_plain") == F.col("_hit"), "left").withColumn("found", F.col("_hit").isNotNull()).drop("_plain", "_hit")

    return marked(a, "_a"), marked(b, "_b")


def extraction_metrics(extracted: DataFrame, known: DataFrame) -> DataFrame:
    """Counts and rates of tables marked by ``matched_extraction``, one row; a rate over nothing is null."""
    right = extracted.agg(F.count_if("found").alias("true_positives"), F.count_if(~F.col("found")).alias("false_positives"), F.count(F.lit(1)).alias("n_extracted"))
    missed = known.agg(F.count_if(~F.col("found")).alias("false_negatives"), F.count(F.lit(1)).alias("n_known"))
    tp = F.col("true_positives")
    both = right.crossJoin(missed)  # one row each
    both = both.select("*", metrics.ratio(tp, tp + F.col("false_positives")).alias("precision"), metrics.ratio(tp, tp + F.col("false_negatives")).alias("recall"))
    return both.withColumn("f1_score", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def left_out_rates(predicted: str, actual: str, said: str, exogenous: str) -> resampling.Rates:
    """Accuracies of motivations and of exogeneity of left-out acts, and the latter's precision and recall."""
    one = resampling.one
    p, y = F.col(said), F.col(exogenous)
    return {
        "accuracy": (one(F.col(predicted) == F.col(actual)), one(F.col(actual).isNotNull())), "exogenous_accuracy": (one(p == y), one(p.isNotNull() & y.isNotNull())),
        "exogenous_precision": (one(p & y), one(p & y) + one(p & ~y)), "exogenous_recall": (one(p & y), one(p & y) + one(~p & y)),
    }


def left_out_evaluation(results: DataFrame, key: str, predicted: str, actual: str, said: str, exogenous: str, levels: list[str], replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Metric, value, low, high of left-out predictions, the mean F1 of the classes among them.

    Rows without a prediction are left out. A class without a precision, a
    recall or a hit has no F1, and none is in the mean.
    """
    rows = results.filter(F.col(predicted).isNotNull())
    rates = resampling.rate_intervals(rows, key, left_out_rates(predicted, actual, said, exogenous), replicates=replicates, seed=seed, level=level)

    def macro(cells: DataFrame, *by: str) -> DataFrame:
        each = cells.select(*by, "_p", "_y", "_w", F.explode(F.array(*[F.lit(x) for x in levels])).alias("_c"))
        hit, called, known = ((F.sum(F.when(on, F.col("_w")).otherwise(0))) for on in ((F.col("_p") == F.col("_c")) & (F.col("_y") == F.col("_c")), (F.col("_p") == F.col("_c")) & F.col("_y").isin(*levels), (F.col("_y") == F.col("_c")) & F.col("_p").isin(*levels)))
        sums = each.groupBy(*by, "_c").agg(hit.alias("_hit"), called.alias("_called"), known.alias("_known"))
        f1 = F.when(F.col("_hit") > 0, F.try_divide(2.0 * F.col("_hit"), F.col("_called") + F.col("_known")))
        return sums.groupBy(*by).agg(F.avg(f1).alias("value")) if by else sums.agg(F.avg(f1).alias("value"))

    # a class that is no level counts as none
    known = [F.when(F.col(c).isin(*levels), F.col(c)).alias(n) for c, n in ((predicted, "_p"), (actual, "_y"))]
    plain = rows.select(*known)
    point = macro(plain.groupBy("_p", "_y").agg(F.count(F.lit(1)).alias("_w")))
    draws = resampling.drawn_counts(plain, ["_p", "_y"], replicates, seed)
    ends = macro(draws, "_rep").filter("value IS NOT NULL").agg(F.percentile("value", F.lit((1 - level) / 2)).alias("low"), F.percentile("value", F.lit((1 + level) / 2)).alias("high"))
    return rates.unionByName(point.crossJoin(ends).select(F.lit("macro_f1").alias("metric"), "value", "low", "high"))  # one row each
