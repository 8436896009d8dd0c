"""Classification, clustering and agreement metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def binary_metrics(rows: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    """Counts and rates of two boolean columns; null on zero denominators."""
    p, y = F.col(predicted), F.col(actual)
    counts = rows.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tn, tn + fp).alias("specificity"),
    )


def partition_metrics(rows: DataFrame, predicted: str, gold: str, *by: str) -> DataFrame:
    """Pair counts, pairwise rates, adjusted Rand index and purity from the contingency table, for each ``by`` if given."""
    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    table = rows.groupBy(*by, predicted, gold).agg(F.count(F.lit(1)).alias("n"))
    both = table.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("tp"), F.sum("n").alias("n"))
    p = table.groupBy(*by, predicted).agg(F.sum("n").alias("n"), F.max("n").alias("m")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("p"), F.sum("m").alias("pure"))
    g = table.groupBy(*by, gold).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("g"))
    met = both.join(p, [*by]).join(g, [*by]) if by else both.crossJoin(p).crossJoin(g)  # one row each without ``by``
    tp, n = F.col("tp"), F.col("n")
    expected = ratio(F.col("p") * F.col("g"), pairs(n))
    return met.select(
        *by, tp.cast("long").alias("tp_pairs"), (F.col("p") - tp).cast("long").alias("over_merge"), (F.col("g") - tp).cast("long").alias("under_merge"),
        ratio(tp, F.col("p")).alias("precision"), ratio(tp, F.col("g")).alias("recall"), ratio(2 * tp, F.col("p") + F.col("g")).alias("f1"),
        ratio(tp - expected, (F.col("p") + F.col("g")) / 2 - expected).alias("ari"), ratio(F.col("pure"), n).alias("purity"),
    )


def class_metrics(rows: DataFrame, predicted: str, actual: str, levels: list[str]) -> DataFrame:
    """One-vs-rest rates and support of each level.

    A rate leaves out the rows with null on its other side; support counts all
    of the level. F1 is null where nothing of the level is found.
    """
    per = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    p, y = F.col("_p") == F.col("level"), F.col("_y") == F.col("level")
    counts = rows.select(F.col(predicted).alias("_p"), F.col(actual).alias("_y"), per).groupBy("level").agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & F.col("_y").isNotNull()).alias("called"), F.count_if(y & F.col("_p").isNotNull()).alias("known"), F.count_if(y).alias("support")
    )
    tp = F.col("tp")
    rates = counts.select("level", "support", ratio(tp, F.col("called")).alias("precision"), ratio(tp, F.col("known")).alias("recall"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rates.select("level", "precision", "recall", f1.alias("f1"), "support")


def calibration_bins(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Ten right-closed bins; a confidence of 0 has no bin."""
    bin_ = F.nullif(F.ceil(F.col(confidence) * 10).cast("int"), F.lit(0))
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def fleiss_kappa(ratings: DataFrame, subject: str, category: str) -> DataFrame:
    """Kappa of long ratings over subjects rated equally often; 1 if chance agreement is 1."""
    cells = ratings.groupBy(subject, category).agg(F.count(F.lit(1)).alias("n"))
    raters = Window.partitionBy(subject)
    cells = cells.withColumn("k", F.sum("n").over(raters))
    subjects = cells.groupBy(subject).agg(ratio(F.sum(F.col("n") * (F.col("n") - 1)), F.first("k") * (F.first("k") - 1)).alias("agree"), F.first("k").alias("k"))
    observed = subjects.agg(F.avg("agree").alias("p"), F.sum("k").alias("total"), F.count(F.lit(1)).alias("n_subjects"))
    share = cells.groupBy(category).agg(F.sum("n").alias("_given")).crossJoin(F.broadcast(observed)).agg(
        F.sum((F.col("_given") / F.col("total")) ** 2).alias("e"), F.first("p").alias("p"), F.first("n_subjects").alias("n_subjects")
    )
    kappa = F.when(F.col("e") == 1, F.lit(1.0)).otherwise(F.try_divide(F.col("p") - F.col("e"), 1 - F.col("e")))
    return share.select("n_subjects", F.col("p").alias("observed"), F.col("e").alias("expected"), kappa.alias("kappa"))


def quarter_of(d: Column) -> Column:
    """P10: a date as 'YYYY-QN'."""
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def quarter_number(q: Column) -> Column:
    """P11: 'YYYY-QN' as year * 4 + N - 1; null if malformed."""
    fine = q.rlike(r"^\d{4}-Q[1-4]$")
    return F.when(fine, F.substring(q, 1, 4).cast("int") * 4 + F.substring(q, 7, 1).cast("int") - 1)


def quarter_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays; 1 if both are empty, null if one is."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(None)).otherwise(both / union)


def majority(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Most frequent label (first in order on ties) and its share of the non-null ones."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    w, r = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("_n"), label)
    got = n.withColumn("agreement", F.col("_n") / F.sum("_n").over(w)).withColumn("_r", F.row_number().over(r))
    return got.filter("_r = 1").select(*by, F.col(label).alias("majority"), "agreement")
