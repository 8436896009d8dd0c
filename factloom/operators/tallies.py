"""Pools of names, tallies of clusters and acts, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import year_in
from factloom.operators.metrics import ratio
from factloom.operators.numbering import in_order
from factloom.operators.shaping import language_of_id


def name_pool(rows: DataFrame, name: str, *keep: str) -> DataFrame:
    """Distinct rows of the kept columns with the number of times their name occurs in all rows. Null names are left out."""
    some = rows.filter(F.col(name).isNotNull()).groupBy(name, *keep).agg(F.count(F.lit(1)).alias("_n"))
    total = some.groupBy(name).agg(F.sum("_n").alias("n_occurrences"))
    return some.drop("_n").join(total, name)


def gold_pairs(rows: DataFrame, name: str, act: str) -> DataFrame:
    """A10: distinct pairs of name and act; ``ambiguous`` if the name has several acts."""
    pairs = rows.filter(F.col(name).isNotNull() & F.col(act).isNotNull()).select(name, act).distinct()
    return pairs.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy(name)) > 1)


def act_list(rows: DataFrame, act: str, signed: str) -> DataFrame:
    """Each act once with the year of its first date and an id by name."""
    once = rows.filter(F.col(act).isNotNull()).groupBy(act).agg(F.year(F.min(signed)).alias("year"))
    return in_order(once, act).select(act, "year", (F.col("_k") + 1).cast("int").alias("act_id"))


def act_evidence(rows: DataFrame, by: str, order: str, arrays: list[str], valid: str) -> DataFrame:
    """Arrays of evidence joined in order for each act, its chunks and those that failed. Null arrays count as empty."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.coalesce(F.col(a), F.array()).alias(a) for a in arrays])))
    got = rows.groupBy(by).agg(ordered.alias("_all"), F.count(F.lit(1)).alias("n_chunks"), F.count_if(~F.coalesce(F.col(valid), F.lit(False))).alias("n_failures"))
    return got.select(by, *[F.flatten(F.col(f"_all.{a}")).alias(a) for a in arrays], "n_chunks", "n_failures")


def act_inputs(members: DataFrame, cluster: str, canonical: str, doc_year: str) -> DataFrame:
    """A18: 'name [cID]' of each cluster and its year: that in the name, else the most frequent document year (smallest on ties)."""
    got = members.groupBy(cluster, canonical).agg(F.mode(doc_year, True).alias("doc_year_modal"), F.count(F.lit(1)).alias("n_chunks"))
    return got.select(
        cluster, F.format_string("%s [c%s]", F.col(canonical), F.col(cluster).cast("string")).alias("act_name"),
        F.coalesce(year_in(F.col(canonical)), F.col("doc_year_modal")).alias("year"), "doc_year_modal", "n_chunks",
    )


def recall_by_act(rows: DataFrame, act: str, tier: str, correct: str) -> DataFrame:
    """Chunks of each act, by tier, and the share classified rightly; null counts as wrong."""
    right = F.count_if(F.coalesce(F.col(correct), F.lit(False)))
    n = F.count(F.lit(1))
    return rows.groupBy(act).agg(n.alias("n_chunks"), F.count_if(F.col(tier) == 1).alias("n_tier1"), F.count_if(F.col(tier) == 2).alias("n_tier2"), right.alias("n_correct"), ratio(right, n).alias("recall"))


def compression(rows: DataFrame, by: str, measure: str, act: str) -> DataFrame:
    """Distinct measures of a document for each distinct act (at least one)."""
    got = rows.groupBy(by).agg(F.countDistinct(measure).alias("n_measures"), F.countDistinct(act).alias("n_acts"))
    return got.withColumn("compression", ratio(F.col("n_measures"), F.greatest("n_acts", F.lit(1))))


def marginals(rows: DataFrame, exogenous: str, label: str) -> DataFrame:
    """Acts of each label, those exogenous and those not; null is neither."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(exogenous)).alias("n_exogenous"), F.count_if(~F.col(exogenous)).alias("n_endogenous"))


def cluster_summary(members: DataFrame, cluster: str, name: str) -> DataFrame:
    """Clusters, names, mean and greatest size and clusters of one name."""
    sizes = members.groupBy(cluster).agg(F.countDistinct(name).alias("_n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("_n").alias("n_names"), F.avg("_n").alias("mean_members"), F.count_if(F.col("_n") == 1).alias("n_singletons"), F.max("_n").alias("largest"))


def language_merge(members: DataFrame, cluster: str, lang: str, first: str, second: str) -> DataFrame:
    """Clusters with names of both languages, of one only, and the rate of the mixed ones."""
    seen = members.groupBy(cluster).agg(F.bool_or(F.col(lang) == first).alias("_a"), F.bool_or(F.col(lang) == second).alias("_b"))
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    got = seen.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(a & b).alias("mixed"), F.count_if(a & ~b).alias(f"{first}_only"), F.count_if(b & ~a).alias(f"{second}_only"))
    return got.withColumn("mixed_rate", ratio(F.col("mixed"), F.col("n_clusters")))


def timing_precision(rows: DataFrame, gap: Column, *by: str) -> DataFrame:
    """Median gap in years and shares within 2 and 5."""
    return rows.withColumn("_g", gap).groupBy(*by).agg(F.median("_g").alias("median_gap"), F.avg((F.abs("_g") <= 2).cast("double")).alias("within_2"), F.avg((F.abs("_g") <= 5).cast("double")).alias("within_5"))


def yearly_rates(chunks: DataFrame, hits: DataFrame, key: list[str], year: str) -> DataFrame:
    """Distinct chunks and hits of each year and their ratio; years without chunks have no row."""
    n = chunks.select(*key, year).distinct().groupBy(year).agg(F.count(F.lit(1)).alias("n_chunks"))
    h = hits.select(*key, year).distinct().groupBy(year).agg(F.count(F.lit(1)).alias("n_hits"))
    hits_of = F.coalesce("n_hits", F.lit(0))
    return n.join(h, year, "left").select(year, "n_chunks", hits_of.alias("n_hits"), (hits_of / F.greatest("n_chunks", F.lit(1))).alias("rate"))


def compare_tracks(one: DataFrame, two: DataFrame, metric: str, value: str) -> DataFrame:
    """Gaps of two runs by metric and one verdict from the worst gap: PROCEED to -0.05, INVESTIGATE to -0.10, else BLOCK.

    The metrics are a handful of rows, so the worst gap is a window over them.
    """
    both = one.select(metric, F.col(value).alias("track1")).join(two.select(metric, F.col(value).alias("track2")), metric)
    gaps = both.withColumn("gap_absolute", F.col("track2") - F.col("track1")).withColumn("gap_percent", 100 * ratio(F.col("track2") - F.col("track1"), F.col("track1")))
    worst = F.min("gap_absolute").over(Window.partitionBy())
    return gaps.withColumn("verdict", F.when(worst >= -0.05, "PROCEED").when(worst >= -0.10, "INVESTIGATE").otherwise("BLOCK"))


def overlisting(rows: DataFrame, items: str, positive: Column) -> DataFrame:
    """Sizes of the arrays of positive rows: mean, median, 90 %, greatest, and rows of 3 or more. A null array has size 0."""
    n = rows.filter(positive).select(F.greatest(F.size(items), F.lit(0)).alias("_n"))
    return n.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("_n").alias("mean"), F.median("_n").alias("p50"), F.percentile("_n", F.lit(0.9)).alias("p90"), F.max("_n").alias("greatest"), F.count_if(F.col("_n") >= 3).alias("n_tail"))


def shuffle_stability(runs: DataFrame, group: str, act: str, base: str, shuffled: str, reference: str) -> DataFrame:
    """How often the answers to shuffled evidence repeat the first answer.

    An act's stability is that share over its shuffles, a group's the median
    over its acts. The gap is a group's median minus that of ``reference``,
    and the verdict follows from it and both medians.
    """
    acts = runs.groupBy(group, act).agg(F.avg(F.col(base).eqNullSafe(F.col(shuffled)).cast("double")).alias("_s"))
    medians = acts.groupBy(group).agg(F.count(F.lit(1)).alias("n_acts"), F.median("_s").alias("stability"))
    ref = medians.filter(F.col(group) == reference).agg(F.max("stability").alias("_ref"))
    got = medians.crossJoin(F.broadcast(ref)).withColumn("gap", F.col("stability") - F.col("_ref"))
    low, ref_low = F.col("stability") < 0.8, F.col("_ref") < 0.8
    verdict = (
        F.when(F.col("gap").isNull(), "incomplete").when(F.col("gap") < -0.10, "fail (overfit)").when(low & ref_low, "structural_issue")
        .when(~low & ~ref_low, "pass").otherwise("marginal")
    )
    return got.withColumn("verdict", verdict).drop("_ref")


def order_agreement(clusters: DataFrame, variant: str, name: str, cluster: str) -> DataFrame:
    """Adjusted Rand index of every two variants over the names both have: number of pairs, mean, least and greatest.

    Works on contingency counts; names are joined once for each pair of variants.
    """
    c = clusters.select(variant, name, cluster).distinct()
    a = c.select(F.col(variant).alias("_va"), name, F.col(cluster).alias("_a"))
    b = c.select(F.col(variant).alias("_vb"), name, F.col(cluster).alias("_b"))
    pair = ["_va", "_vb"]

    def pairs(n: Column) -> Column:
        return F.sum(n * (n - 1) / 2)

    cells = a.join(b, name).filter("_va < _vb").groupBy(*pair, "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy(*pair).agg(pairs(F.col("n")).alias("index"), F.sum("n").alias("total"))
    rows = cells.groupBy(*pair, "_a").agg(F.sum("n").alias("n")).groupBy(*pair).agg(pairs(F.col("n")).alias("sum_a"))
    cols = cells.groupBy(*pair, "_b").agg(F.sum("n").alias("n")).groupBy(*pair).agg(pairs(F.col("n")).alias("sum_b"))
    got = whole.join(rows, pair).join(cols, pair)
    expected = F.try_divide(F.col("sum_a") * F.col("sum_b"), F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("sum_a") + F.col("sum_b")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise(F.try_divide(F.col("index") - expected, most - expected))
    return got.select(ari.alias("ari")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"), F.max("ari").alias("max_ari"))


def gate_metrics(matches: DataFrame, clusters: DataFrame, acts: DataFrame, variant: str, cluster: str, act: str, passes: str, name_passes: str, year_match: str) -> DataFrame:
    """Coverage of acts, rate of spurious clusters, clusters for each matched act, and agreement of years, by variant."""
    total = clusters.select(variant, cluster).distinct().groupBy(variant).agg(F.count(F.lit(1)).alias("n_clusters"))
    hit = matches.filter(F.col(passes)).select(variant, cluster, act).distinct()
    found = hit.groupBy(variant).agg(F.countDistinct(act).alias("_acts"), F.countDistinct(cluster).alias("_clusters"), F.count(F.lit(1)).alias("_pairs"))
    years = matches.filter(F.col(name_passes)).groupBy(variant).agg(F.avg(F.col(year_match).cast("double")).alias("year_alignment"))
    known = acts.agg(F.countDistinct(act).alias("n_acts"))
    got = total.join(found, variant, "left").join(years, variant, "left").crossJoin(F.broadcast(known)).na.fill(0, ["_acts", "_clusters", "_pairs"])
    return got.select(
        variant, "n_clusters", F.col("_acts").alias("n_acts_matched"), ratio(F.col("_acts"), F.col("n_acts")).alias("coverage"),
        ratio(F.col("n_clusters") - F.col("_clusters"), F.col("n_clusters")).alias("spurious_rate"), ratio(F.col("_pairs"), F.col("_acts")).alias("fragmentation"), "year_alignment",
    )


def cluster_frequency(members: DataFrame, matches: DataFrame, cluster: str, chunk: list[str], distance: str, keyword: str, fuzzy: str) -> DataFrame:
    """Q11: distinct chunks of each cluster, its least distance to a reference, and the gates that any of its matches passes."""
    n = members.groupBy(cluster).agg(F.countDistinct(*chunk).alias("n_chunks"))
    d = matches.groupBy(cluster).agg(F.min(distance).alias("least_distance"), F.bool_or(keyword).alias("_k"), F.bool_or(fuzzy).alias("_j"))
    k, j = F.coalesce("_k", F.lit(False)), F.coalesce("_j", F.lit(False))
    kind = F.when(k & j, "both (keyword + JW)").when(k, "keyword only").when(j, "jw only").otherwise("unmatched")
    return n.join(d, cluster, "left").select(cluster, "n_chunks", "least_distance", kind.alias("match_cat"))


def frequency_tradeoff(rows: DataFrame, key: str, size: str, matched: str) -> DataFrame:
    """Errors of every cut by frequency.

    For each size: items of at least that size that are not matched, and items
    of at most that size that are. Items are first counted by size, so the two
    running sums go over the distinct sizes.
    """
    hit = F.coalesce(F.col(matched), F.lit(False))
    sizes = rows.groupBy(size).agg(F.count(key).alias("n_items"), F.count_if(hit).alias("_hit"))
    down = Window.orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select(size, "n_items", F.sum(F.col("n_items") - F.col("_hit")).over(down).alias("false_positives"), F.sum("_hit").over(up).alias("false_negatives"))


def document_compression(members: DataFrame, group: str, measure: str, cluster: str) -> DataFrame:
    """Names, clusters and names a cluster of the documents of each year and language; cluster ids are told apart within a language and year, as their documents are."""
    year = F.regexp_extract(group, r"\d{4}", 0)
    keyed = members.select(F.nullif(year, F.lit("")).cast("int").alias("year"), language_of_id(F.col(group)).alias("doc_language"), measure, cluster)
    counts = keyed.groupBy("year", "doc_language").agg(F.countDistinct(measure).alias("n_measures"), F.countDistinct(cluster).alias("n_acts"))
    return counts.withColumn("compression", F.col("n_measures") / F.greatest("n_acts", F.lit(1)))


def consistency_tallies(members: DataFrame, inventory: DataFrame, joint: DataFrame, pool: DataFrame) -> dict[str, DataFrame]:
    """Compression by document, counts, labels and years of acts by side, and clusters that join both languages.

    Null exogeneity is in neither count; acts without a year are in no year.
    Names that the pool does not know have no language.
    """
    exo = F.col("pred_exogenous")
    sides = inventory.groupBy("side")
    known = joint.select("cluster_id", "measure_name").distinct().join(pool.select("measure_name", "doc_language").distinct(), "measure_name", "left")
    return {
        "per_doc": document_compression(members, "scope_group", "measure_name", "cluster_id"),
        "counts": sides.agg(F.count(F.lit(1)).alias("n_acts"), F.count_if(exo).alias("n_exogenous"), F.count_if(~exo).alias("n_endogenous")),
        "labels": inventory.groupBy("side", "pred_label").agg(F.count(F.lit(1)).alias("n")),
        "act_years": inventory.filter("act_name_year IS NOT NULL").groupBy("side", "act_name_year").agg(F.count(F.lit(1)).alias("n")),
        "joint": language_merge(known, "cluster_id", "doc_language", "en", "bm"),
    }
