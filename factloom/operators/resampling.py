"""Percentile intervals by resampling gold rows (B01, and the intervals of M03, M04, M06 and M09)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import goldmatch, metrics
from factloom.operators.metrics import ratio
from factloom.operators.numbering import numbered
from factloom.storage import written

Rates = dict[str, tuple[Column, Column]]

#: Cumulative probabilities of a Poisson number of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: Groups whose sums a task holds at a time.
GROUPS = 64
#: Draws that are numbered in one row, and distinct values whose draws a task makes at a time.
RUN, CELLS = 1 << 16, 4096


def one(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it does not or is null."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def drawn(rows: DataFrame, key: str, replicates: int, seed: int, *by: str) -> DataFrame:
    """The rows that each replicate draws, with ``_rep`` and ``_w``, how often it draws them.

    A replicate draws as many rows as its group has, with replacement; which
    ones is hashed from seed, replicate and draw, so reruns agree. ``key``
    tells the rows of a group apart. Groups of a null ``by`` draw nothing.
    """
    placed = numbered(rows, seed, key, *by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    reps = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep")).repartition("_rep")
    # in runs, so that no row holds the numbers of all draws
    runs = reps.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_i"))
    own = F.sequence(F.col("_i") * RUN + 1, F.least((F.col("_i") + 1) * RUN, F.col("_n")))
    draws = runs.select(*by, "_n", "_rep", F.explode(own).alias("_d"))
    place = F.pmod(F.xxhash64(F.lit(seed), "_rep", "_d"), F.col("_n")).alias("_k")
    counts = draws.select(*by, "_rep", place).groupBy(*by, "_rep", "_k").agg(F.count(F.lit(1)).alias("_w"))
    return counts.join(placed, [*by, "_k"]).drop("_k")


def drawn_counts(rows: DataFrame, values: list[str], replicates: int, seed: int) -> DataFrame:
    """How often, ``_w``, each replicate draws a row with these values when it draws as many rows as there are, with replacement.

    Such counts are one multinomial draw over the distinct values, so no row is
    drawn by itself. The values are dealt to buckets: a replicate draws how
    many of its rows fall in each bucket, and in a bucket's task how many of
    those fall on each value. Draws are seeded by replicate and bucket, so
    reruns agree.
    """
    cells = written(rows.groupBy(*values).agg(F.count(F.lit(1)).alias("_n")), "cells")
    buckets = max(1, math.ceil(cells.count() / CELLS))
    # null fields too, so that every combination of values has its own text
    text = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    placed = cells.withColumn("_h", F.sha2(text, 256)).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets)
    for r in placed.groupBy("_b").agg(F.sum("_n").alias("n")).collect():  # a number for each bucket
        sizes[r["_b"]] = r["n"]
    out = T.StructType([*[f for f in cells.schema.fields if f.name != "_n"], T.StructField("_w", T.ArrayType(T.LongType()))])

    def draw(t: pa.Table) -> pa.Table:
        t = t.sort_by("_h")
        bucket, n, total = t.column("_b")[0].as_py(), t.column("_n").to_numpy(), int(sizes.sum())
        w = np.empty((len(n), replicates), np.int64)
        for rep in range(replicates):
            mine = np.random.default_rng([seed, rep]).multinomial(total, sizes / total)[bucket]
            w[:, rep] = np.random.default_rng([seed, rep, bucket]).multinomial(mine, n / n.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, replicates), pa.int32()), pa.array(w.ravel()))
        return t.select(values).append_column("_w", pa.chunked_array([lists]))

    drawn_ = placed.groupBy("_b").applyInArrow(draw, out)
    return drawn_.select(*values, F.posexplode("_w").alias("_rep", "_w")).filter("_w > 0").withColumn("_rep", F.col("_rep") + 1)


def _interval(values: DataFrame, level: float, *by: str) -> DataFrame:
    ends = [F.percentile("value", F.lit(p)).alias(c) for c, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2))]
    return values.filter("value IS NOT NULL").groupBy(*by, "metric").agg(*ends)


def _long(wide: DataFrame, values: dict[str, Column], *keep: str) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]
    return wide.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: bits that differ anywhere differ everywhere."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """How often each replicate draws each row: Poisson numbers of mean 1, by row and replicate, from the rows' hashes."""
    reps = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    u = (_mixed(hashes.view(np.uint64)[:, None] ^ reps[None, :]) >> np.uint64(11)).astype(float) * 2.0**-53
    return np.searchsorted(POISSON, u, side="right").astype(np.float32)


def weighted_sums(rows: DataFrame, key: str, values: list[str], once: list[bool], replicates: int, seed: int, *by: str) -> DataFrame:
    """For each replicate, ``_rep`` from 1, and ``by`` the sum of each value over the rows that it draws, as often as it draws them (of a value with ``once``, once).

    The weights of a row are one array, hashed from seed and ``key``, so reruns
    agree. Tasks sum their rows and hand on ``replicates`` sums for each group.
    """
    kinds = [f for f in rows.schema.fields if f.name in by]
    out = T.StructType([*kinds, T.StructField("_rep", T.IntegerType()), *[T.StructField(v, T.DoubleType()) for v in values]])
    hashed = rows.select(*by, F.xxhash64(F.lit(seed), key).alias("_h"), *[F.col(v).cast("double").alias(v) for v in values])
    single = np.array(once, bool)

    def flushed(sums: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for group, total in sums.items():
            frame = pd.DataFrame(total, columns=values)
            frame.insert(0, "_rep", np.arange(1, replicates + 1, dtype=np.int32))
            for i, (field, value) in enumerate(zip(kinds, group)):
                frame.insert(i, field.name, pd.Series([value] * replicates, dtype=object))
            yield frame

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        names = [f.name for f in kinds]
        for frame in frames:
            if names:
                parts = [(k if isinstance(k, tuple) else (k,), p) for k, p in frame.groupby(names, sort=False, dropna=True)]
            else:
                parts = [((), frame)]
            for group, part in parts:
                total = sums.setdefault(group, np.zeros((replicates, len(values))))
                for lo in range(0, len(part), 512):
                    x = np.nan_to_num(part[values].iloc[lo : lo + 512].to_numpy(dtype=float))
                    w = weights(part["_h"].iloc[lo : lo + 512].to_numpy(), replicates)
                    total[:, ~single] += w.T @ x[:, ~single]
                    total[:, single] += (w > 0).T.astype(np.float32) @ x[:, single]
            if len(sums) > GROUPS:
                yield from flushed(sums)
                sums = {}
        yield from flushed(sums)

    return hashed.mapInPandas(add, out).groupBy(*by, "_rep").agg(*[F.sum(v).alias(v) for v in values])


def rate_intervals(rows: DataFrame, key: str, rates: Rates, *by: str, once: frozenset[str] = frozenset(), replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Each rate, a sum over a sum, with its percentile interval over resampled rows.

    ``rates`` names numerator and denominator of a row. In the rates named in
    ``once`` a drawn row counts once, however often it is drawn. A rate over
    nothing is null, and replicates without one are left out of its interval.
    Groups of a null ``by`` have no interval. ``key`` tells the rows apart.
    """
    sides = [(m, f"_{side}{i}", c) for i, (m, pair) in enumerate(rates.items()) for side, c in zip("ab", pair)]
    cells = rows.select(*by, F.col(key).alias("_key"), *[c.cast("double").alias(n) for _, n, c in sides])
    values = {m: ratio(F.col(f"_a{i}"), F.col(f"_b{i}")) for i, m in enumerate(rates)}
    point = _long(cells.groupBy(*by).agg(*[F.sum(n).alias(n) for _, n, _ in sides]), values, *by)
    each = weighted_sums(cells, "_key", [n for _, n, _ in sides], [m in once for m, *_ in sides], replicates, seed, *by)
    return point.join(_interval(_long(each, values, *by, "_rep"), level, *by), [*by, "metric"], "left")


def mean_interval(rows: DataFrame, key: str, value: str, replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """``estimate``, the mean of a value, with ``low`` and ``high``; nulls are left out."""
    known = F.col(value).isNotNull().cast("double")
    got = rate_intervals(rows, key, {"mean": (F.coalesce(F.col(value).cast("double"), F.lit(0.0)), known)}, replicates=replicates, seed=seed, level=level)
    return got.select(F.col("value").alias("estimate"), "low", "high")


def act_rates(called: str, exogenous: str, sign: str, true_sign: str) -> Rates:
    """The rates of classified acts: exogenous or not, and the signs of the truly exogenous.

    Acts without a call or a true value take no part in the first four; a null
    or UNCLEAR sign is wrong.
    """
    p, y = F.col(called), F.col(exogenous)
    valid = p.isNotNull() & y.isNotNull()
    hit = one(p & y)
    right = (F.col(sign) != "UNCLEAR") & (F.col(sign) == F.col(true_sign))
    return {
        "exo_precision": (hit, one(valid & p)), "exo_recall": (hit, one(valid & y)),
        "exo_f1": (2 * hit, one(valid & p) + one(valid & y)), "exo_accuracy": (one(p == y), one(valid)),
        "sign_acc_on_true_exo": (one(right & y), one(y)), "signed_exo_precision": (one(right & p & y), one(y)),
    }


def quality_flags(rows: DataFrame, called: str, sign: str, label: str, failures: str) -> DataFrame:
    """How many acts there are, how many lack a call, a sign or a label, and the failures of their evidence."""
    missing = [F.count_if(F.col(c).isNull()).alias(n) for n, c in (("n_na_exo", called), ("n_na_pred_sign", sign), ("n_na_pred_label", label))]
    return rows.agg(F.count(F.lit(1)).alias("n_total"), F.coalesce(F.sum(failures), F.lit(0)).alias("n_failures"), *missing)


def cluster_intervals(predicted: DataFrame, gold: DataFrame, name: str, cluster: str, act: str, key: str, replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Partition metrics of clusters against gold, with intervals over resampled gold rows.

    Each replicate settles anew which act an ambiguous name has. Names that
    are not in both take no part. ``key`` tells the gold rows apart; each row
    counts once, so their numbers by name and act are all that is drawn.
    """
    clusters = predicted.select(name, cluster).distinct()

    def measured(rows: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
        met = goldmatch.resolved_gold(rows, name, act, *by, weight=weight).join(clusters, name)
        wide = metrics.partition_metrics(met, cluster, act, *by)
        return _long(wide, {m: F.col(m) for m in ("precision", "recall", "f1", "ari", "purity")}, *by)

    copies = drawn_counts(gold, [name, act], replicates, seed)
    each = measured(copies, "_rep", weight="_w")
    return measured(gold).join(_interval(each, level), ["metric"], "left")


def gate_intervals(matches: DataFrame, clusters: DataFrame, acts: DataFrame, variant: str, cluster: str, act: str, passes: str, name_passes: str, year_match: str, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """The rates of a gate by variant, with intervals over resampled acts, that of spurious clusters over resampled clusters.

    Coverage counts an act as often as it is drawn, fragmentation and the
    agreement of years once. Acts and variants are gold lists.
    """
    hit = matches.filter(F.col(passes)).select(variant, act, cluster).distinct()
    pairs = hit.groupBy(variant, act).agg(F.count(F.lit(1)).alias("_pairs"))
    years = matches.filter(F.col(name_passes)).groupBy(variant, act).agg(F.count_if(F.col(year_match)).alias("_same"), F.count(year_match).alias("_dated"))
    listed = clusters.select(variant).distinct().crossJoin(F.broadcast(acts.select(act).distinct()))
    rows = listed.join(pairs, [variant, act], "left").join(years, [variant, act], "left").na.fill(0, ["_pairs", "_same", "_dated"])
    found = one(F.col("_pairs") > 0)
    by_act = {"coverage": (found, F.lit(1.0)), "fragmentation": (F.col("_pairs"), found), "year_alignment": (F.col("_same"), F.col("_dated"))}
    matched = hit.select(variant, cluster).distinct().withColumn("_hit", F.lit(True))
    members = clusters.select(variant, cluster).distinct().join(matched, [variant, cluster], "left")
    own = rate_intervals(rows, act, by_act, variant, once=frozenset({"fragmentation", "year_alignment"}), replicates=replicates, seed=seed)
    return own.unionByName(rate_intervals(members, cluster, {"spurious_rate": (one(F.col("_hit").isNull()), F.lit(1.0))}, variant, replicates=replicates, seed=seed + 1))
