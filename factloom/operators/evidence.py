"""Measures, evidence, inventories and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fan_out(rows: DataFrame, measures: str, *keep: str) -> DataFrame:
    """A row for each entry with its rank from 1; an empty or null array gives one row with null rank."""
    return rows.select(*keep, F.posexplode_outer(measures).alias("_pos", "measure")).select(*keep, "measure", (F.col("_pos") + 1).cast("int").alias("measure_rank"))


def country_of(country: Column, iso: str) -> Column:
    """The country itself or OTHER; null becomes OTHER."""
    return F.when(country == iso, country).otherwise(F.lit("OTHER"))


def passes_gate(label: Column, rank: Column, motivation: Column, country: Column) -> Column:
    """Fiscal, first, with motivation, and not of another country (null stays)."""
    return (label == "FISCAL_MEASURE") & (rank == 1) & motivation.eqNullSafe(True) & ~country.eqNullSafe("OTHER")


def first_and_nested(rows: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """The first row's values in order (nulls last) and all rows as an ordered array."""
    whole = F.struct(*[F.struct(F.col(c).isNull().alias("_null"), F.col(c).alias("v")).alias(c) for c in order], *[F.col(v).alias(f"_{v}") for v in values])
    nested = rows.groupBy(by).agg(F.array_sort(F.collect_list(whole)).alias("_all"))
    item = lambda x: F.struct(*[x[f"_{v}"].alias(v) for v in values])
    return nested.select(by, *[F.col("_all")[0][f"_{v}"].alias(f"first_{v}") for v in values], F.transform("_all", item).alias("items"), F.size("_all").alias("n_items"))


def fill_down(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Nulls take the last value before them in the group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def mark_chosen(inventory: DataFrame, by: str, relevance: Column, eligible: Column, tie: str, share: float = 0.8) -> DataFrame:
    """The most relevant eligible acts up to a cumulative share of the group's relevance."""
    rows = inventory.withColumn("_e", eligible).withColumn("relevance", F.when(F.col("_e"), relevance))
    w = Window.partitionBy(by)
    down = w.orderBy(F.col("relevance").desc_nulls_last(), tie).rowsBetween(Window.unboundedPreceding, 0)
    part = F.try_divide(F.sum("relevance").over(down), F.sum("relevance").over(w))
    rows = rows.withColumn("cum_share", F.when(F.col("_e"), part))
    return rows.withColumn("chosen", F.when(F.col("_e"), F.col("cum_share") <= share).when(F.col("_e").isNull(), F.lit(None)).otherwise(False)).drop("_e")


def with_and_without(members: DataFrame, evidence: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members that have evidence, joined with it, and the distinct keys of those that don't."""
    return members.join(evidence, key), members.join(evidence.select(*key), key, "left_anti").select(*key).distinct()


def seeded_order(seed: int, *key: str) -> Column:
    """An order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]))


def sample_per_group(rows: DataFrame, by: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows of each group."""
    w = Window.partitionBy(by).orderBy(seeded_order(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def train_val_test(rows: DataFrame, by: str, key: str, seed: int = 1) -> DataFrame:
    """ceil(.6n), ceil(.2n) and the rest of each stratum, in seeded order."""
    w = Window.partitionBy(by).orderBy(seeded_order(seed, key), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    train, val = F.ceil(F.col("_n") * 6 / 10), F.ceil(F.col("_n") * 2 / 10)
    split = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")
    return rows.withColumn("_n", n).withColumn("_r", F.row_number().over(w)).withColumn("split", split).drop("_n", "_r")


#: Fixed value: characters other than these are special on a page.
PLAIN_CHARACTERS = r"[^a-zA-Z0-9\s.,!?;:'-]"


def page_flags(text: Column, page_number: Column | None = None, vocabulary: tuple[str, ...] = ()) -> dict[str, Column]:
    """Short page, many special characters, much non-ASCII text; with a page's number also: no word of the vocabulary after page 5."""
    n = F.length(text)
    flags = {
        "short": n < 100,
        "special": F.coalesce(F.try_divide(F.regexp_count(text, F.lit(PLAIN_CHARACTERS)), n) > 0.1, F.lit(False)),
        "non_ascii": F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[^\x00-\x7F]")), n) > 0.05, F.lit(False)),
    }
    if page_number is not None:
        flags["no_vocabulary"] = ~F.lower(text).rlike(r"\b(" + "|".join(vocabulary) + r")\b") & (page_number > 5)
    return flags
