"""Fuzzy alignment and single-linkage clusters of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.distance import jaro
from factloom.operators import letters
from factloom.operators.numbering import in_order
from factloom.storage import written


def similar_across(left: DataFrame, right: DataFrame, least: float, a: str, b: str) -> DataFrame:
    """``_a``, ``_b``, ``similarity``: distinct names of two tables with a similarity of ``least``, equal names among them."""
    one, two = (t.select(F.col(c).alias("_x"), F.lit(here).alias("_one"), F.lit(not here).alias("_two")) for t, c, here in ((left, a, True), (right, b, False)))
    index = written(letters.indexed(one.unionByName(two), "_x", "_one", "_two"), "letters")
    pairs = letters.candidates(index.filter("_one"), index.filter("_two"), least).toDF("_a", "_b")
    return pairs.withColumn("similarity", jaro(F.col("_a"), F.col("_b"))).filter(F.col("similarity") >= least)


def best_matches(names: DataFrame, candidates: DataFrame, least: float = 0.85, name: str = "name", candidate: str = "candidate", bonus_years: tuple[str, str] | None = None) -> DataFrame:
    """The most similar candidate of each name, if it reaches ``least``.

    Ties go to the smaller candidate. ``bonus_years`` names year columns of
    both sides: candidates within a year get 0.05 in the choice, not in the
    comparison with ``least``. Only pairs with enough letters in common are
    compared; they are found by an equality join.
    """
    pairs = similar_across(names, candidates, least - (0.05 if bonus_years else 0.0), name, candidate)
    scored = names.join(pairs, F.col(name) == F.col("_a")).join(candidates, F.col("_b") == F.col(candidate)).drop("_a", "_b")
    rank = F.col("similarity")
    if bonus_years:
        near = F.abs(F.col(bonus_years[0]) - F.col(bonus_years[1])) <= 1
        rank = rank + F.when(near, 0.05).otherwise(0.0)
    w = Window.partitionBy(name).orderBy(rank.desc(), F.col(candidate))
    return scored.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") == 1) & (F.col("similarity") >= least)).drop("_r")


def similar_pairs(names: DataFrame, least: float, name: str = "name", year: str | None = None, window: int | None = None, group: str | None = None) -> DataFrame:
    """Pairs (a < b) of distinct names with similarity >= ``least``; years within ``window``, groups alike, neither null.

    Names are compared once, whatever years and groups they have; only those
    with enough letters in common, which an equality join finds.
    """
    index = written(letters.indexed(names, name), "letters")
    pairs = letters.candidates(index, index, least, ordered=True).withColumn("similarity", jaro(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least)
    if not year and not group:
        return pairs
    extra = [*([F.col(year).alias("y")] if year else []), *([F.col(group).alias("g")] if group else [])]
    rows = names.select(F.col(name).alias("n"), *extra).distinct()
    a = rows.select(F.col("n").alias("_na"), *[F.col(c).alias(f"{c}a") for c in rows.columns[1:]])
    b = rows.select(F.col("n").alias("_nb"), *[F.col(c).alias(f"{c}b") for c in rows.columns[1:]])
    met = pairs.join(a, F.col("a") == F.col("_na"))
    on = F.col("b") == F.col("_nb")
    if group:
        on = on & (F.col("ga") == F.col("gb"))
    met = met.join(b, on)
    if year and window is not None:
        met = met.filter(F.abs(F.col("ya") - F.col("yb")) <= window)
    return met.select("a", *[c for c in ("ya", "ga") if c in met.columns], "b", *[c for c in ("yb", "gb") if c in met.columns], "similarity")


def connected(vertices: DataFrame, pairs: DataFrame, vertex: str = "name") -> DataFrame:
    """Smallest reachable vertex of each vertex, by label spreading with jumps; labels only fall, so it ends."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(vertices.select(F.col(vertex).alias("v")).distinct().withColumn("label", F.col("v")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("_n"))
        new = labels.join(near, F.col("v") == F.col("a"), "left").select("v", "label", F.least("label", "_n").alias("_m"))
        far = new.join(labels.select(F.col("v").alias("_v"), F.col("label").alias("_f")), F.col("_m") == F.col("_v"))
        step = written(far.select("v", F.least("_m", "_f").alias("label"), (F.least("_m", "_f") < F.col("label")).alias("_moved")), "labels")
        labels = step.select("v", "label")
        if step.filter("_moved").isEmpty():
            return labels


def name_clusters(names: DataFrame, least: float = 0.85, name: str = "name", year: str | None = None, window: int | None = None) -> DataFrame:
    """Cluster id (by the first name in order), canonical name (longest, then first) and size."""
    labels = connected(names, similar_pairs(names, least, name, year, window), name)
    ids = in_order(labels.select("label").distinct(), "label", name="_id")
    members = labels.join(ids, "label").withColumn("cluster_id", (F.col("_id") + 1).cast("int")).drop("_id")
    w = Window.partitionBy("cluster_id").orderBy(F.length("v").desc(), "v")
    sized = Window.partitionBy("cluster_id")
    return members.select(F.col("v").alias("measure_name"), "cluster_id", F.first("v").over(w).alias("canonical_name"), F.count(F.lit(1)).over(sized).alias("n_members"))


def scoped_clusters(pool: DataFrame, scope: str | None, name: str = "name", least: float = 0.85) -> DataFrame:
    """Name clusters within each group of a scope (a column, such as the document or language; None is one joint group).

    Cluster ids count from 1 in each group. Null names and groups are left out.
    """
    group = F.col(scope).cast("string") if scope else F.lit("joint")
    names = pool.select(group.alias("scope_group"), F.col(name).alias("_name")).filter("scope_group IS NOT NULL AND _name IS NOT NULL").distinct()

    def tagged(g: str, n: str):
        # the group's length parts it from the name, whatever either holds
        return F.concat(F.length(g).cast("string"), F.lit(":"), F.col(g), F.col(n))

    pairs = similar_pairs(names, least, "_name", group="scope_group").select(tagged("ga", "a").alias("a"), tagged("ga", "b").alias("b"))
    vertices = names.withColumn("_v", tagged("scope_group", "_name"))
    labels = connected(vertices, pairs, "_v")
    found = vertices.join(labels, F.col("_v") == F.col("v"))
    own = Window.partitionBy("scope_group")
    members = found.select("scope_group", "_name", F.dense_rank().over(own.orderBy("label")).alias("cluster_id"))
    w = Window.partitionBy("scope_group", "cluster_id")
    canonical = F.first("_name").over(w.orderBy(F.length("_name").desc(), "_name"))
    return members.select("scope_group", F.col("_name").alias("measure_name"), "cluster_id", canonical.alias("canonical_name"), F.count(F.lit(1)).over(w).alias("n_members"))
