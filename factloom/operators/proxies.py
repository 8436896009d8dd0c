"""Quarters and signed series of shocks (X01-X03), and folds that leave one act out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.evidence import seeded_order
from factloom.operators.metrics import ratio


def midpoint_quarter(d: Column) -> Column:
    """Year * 4 + quarter - 1 of a date; dates after the 15th of the quarter's second month belong to the next."""
    middle = F.make_date(F.year(d), F.quarter(d) * 3 - 1, F.lit(15))
    return F.year(d) * 4 + F.quarter(d) - 1 + F.when(d > middle, 1).otherwise(0)


def quarter_label(q: Column) -> Column:
    """'YYYY-QN' of year * 4 + N - 1."""
    return F.concat(F.floor(q / 4).cast("string"), F.lit("-Q"), (F.pmod(q, F.lit(4)) + 1).cast("string"))


def signed_proxy(acts: DataFrame, quarter: str, sign: str) -> DataFrame:
    """The sign of the summed signs in every quarter from the first to the last act, 0 where none is.

    ``quarter`` is a number, ``sign`` -1, 0, 1 or null (no part).
    """
    some = acts.filter(F.col(quarter).isNotNull() & F.col(sign).isNotNull())
    sums = some.groupBy(F.col(quarter).alias("q")).agg(F.sum(sign).alias("_s"), F.count(F.lit(1)).alias("n_acts"))
    every = sums.agg(F.min("q").alias("_a"), F.max("q").alias("_z")).filter("_a IS NOT NULL").select(F.explode(F.sequence("_a", "_z")).alias("q"))
    z = F.signum(F.coalesce("_s", F.lit(0))).cast("int")
    return every.join(sums, "q", "left").select("q", quarter_label(F.col("q")).alias("label"), z.alias("z"), F.coalesce("n_acts", F.lit(0)).alias("n_acts"))


def magnitude_errors(rows: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    """Mean absolute percentage error and share of right signs; rows null on either side or of actual 0 have no error."""
    p, y = F.col(predicted), F.col(actual)
    return rows.groupBy(*by).agg(F.avg(ratio(F.abs(p - y), F.abs(y))).alias("mape"), F.avg((F.signum(p) == F.signum(y)).cast("double")).alias("sign_accuracy"))


def left_out_folds(positives: DataFrame, negatives: DataFrame, act: str, key: str, n_negatives: int = 10, n_shots: int = 5, seed: int = 1) -> DataFrame:
    """For each act a fold of its own chunks (test), ``n_negatives`` sampled negatives, and ``n_shots`` chunks of other acts (shot).

    Acts are a gold table. The sampled orders are hashes of fold and key, so
    folds differ and reruns agree. Negatives are first cut to the
    ``n_negatives`` * folds first in one hashed order, then dealt to the folds
    in turn, so that no fold repeats another's.
    """
    folds = positives.select(act).distinct()
    test = positives.select(F.col(act).alias("fold"), act, key, F.lit("test").alias("role"))
    order = seeded_order(seed, key)
    n_folds = folds.count()
    dealt = negatives.select(key, order.alias("_o")).distinct().orderBy("_o", key).limit(n_negatives * n_folds)
    numbered_folds = folds.select(F.col(act).alias("fold")).withColumn("_f", F.row_number().over(Window.orderBy("fold")) - 1)
    numbered = dealt.withColumn("_f", (F.row_number().over(Window.orderBy("_o", key)) - 1) % F.lit(max(n_folds, 1)))
    sampled = numbered.join(numbered_folds, "_f").select("fold", F.lit(None).cast(positives.schema[act].dataType).alias(act), key, F.lit("negative").alias("role"))
    one_each = positives.groupBy(act).agg(F.min_by(key, F.struct(order, F.col(key))).alias(key))
    near = one_each.withColumn("_f", F.row_number().over(Window.orderBy(act)) - 1)
    steps = F.explode(F.sequence(F.lit(1), F.lit(max(1, min(n_shots, n_folds - 1))))).alias("_step")
    wanted = numbered_folds.select("fold", "_f", steps).withColumn("_f", (F.col("_f") + F.col("_step")) % F.lit(max(n_folds, 1)))
    shots = wanted.join(near, "_f").filter(F.col("fold") != F.col(act)).select("fold", act, key, F.lit("shot").alias("role"))
    return test.unionByName(sampled).unionByName(shots)
