"""Candidates for Jaro similarity by an equality join on letters.

With m matching letters the similarity is at most (m / |a| + m / |b| + 1) / 3,
and m is at most the number of letters that both have. So two names of given
lengths need a least number of letters in common. Each name's letters are
numbered (the second "e" is another letter than the first) and put in one order,
the rarest first. Of two names with enough in common, the first few letters of
both (the prefixes) must share one: that letter, with both lengths, is the key
of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack of the bounds against rounding.
SLACK = 1e-9


def indexed(names: DataFrame, name: str = "name", *flags: str) -> DataFrame:
    """Distinct names with ``_len`` and ``_letters``, their numbered letters, the rarest of all names first, and whether any row has each flag. An empty name has one letter, the empty one."""
    one = names.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_rows"), *[F.bool_or(f).alias(f) for f in flags])
    chars = F.regexp_extract_all("_name", F.lit("(?s)(.)"), 1)
    spelled = one.select("_name", *flags, chars.alias("_c"))
    number = F.transform("_c", lambda c, i: F.concat(c, F.size(F.filter(F.slice("_c", F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    spelled = spelled.select("_name", *flags, F.when(F.size("_c") == 0, F.array(F.lit(""))).otherwise(number).alias("_t"))
    long = spelled.select("_name", *flags, F.explode("_t").alias("_t"))
    often = long.groupBy("_t").agg(F.count(F.lit(1)).alias("_f"))
    listed = long.join(often, "_t").groupBy("_name", *flags).agg(F.array_sort(F.collect_list(F.struct("_f", "_t"))).alias("_all"))
    return listed.select("_name", *flags, F.length("_name").alias("_len"), F.transform("_all", lambda x: x["_t"]).alias("_letters"))


def _least_common(x: Column, y: Column, least: float) -> Column:
    """How many letters names of these lengths need in common; one at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide((3 * least - 1) * x * y, (x + y).cast("double")), F.lit(0.0)) - SLACK).cast("int"))


def _keyed(index: DataFrame, least: float, longest: int, side: str) -> DataFrame:
    """A row for each length that the other name may have and each letter of the prefix for it."""
    ratio = 3 * least - 2
    n = F.col("_len")
    low = F.ceil(n * ratio - SLACK).cast("int") if ratio > 0 else F.lit(0)
    high = F.least(F.lit(longest), F.floor(n / ratio + SLACK).cast("int")) if ratio > 0 else F.lit(longest)
    low = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), low))
    high = F.when(n == 0, 0).otherwise(high)
    other = index.filter(low <= high).select("*", F.explode(F.sequence(low, high)).alias("_other"))
    need = _least_common(n, F.col("_other"), least)
    cut = other.withColumn("_prefix", F.slice("_letters", F.lit(1), F.greatest(F.lit(0), F.greatest(n, F.lit(1)) - need + 1)))
    mine, theirs = ("_la", "_lb") if side == "a" else ("_lb", "_la")
    return cut.select(F.explode("_prefix").alias("_t"), n.alias(mine), F.col("_other").alias(theirs), F.col("_name").alias(f"_{side}"), F.col("_letters").alias(f"_{side}s"), F.col("_prefix").alias(f"_{side}p"))


def candidates(left: DataFrame, right: DataFrame, least: float, ordered: bool = False) -> DataFrame:
    """``a``, ``b``: the pairs of ``indexed`` names that may have a Jaro similarity of ``least``, once each; with ``ordered`` only a < b.

    Both sides must be indexed together (see ``indexed``), so that their letters
    are in one order. ``least`` is over a third: below, names without a letter
    in common would do.
    """
    if least <= 1 / 3:
        raise ValueError("a least similarity over a third is needed")
    longest = left.select("_len").unionByName(right.select("_len")).agg(F.max("_len")).first()[0] or 0
    a, b = _keyed(left, least, longest, "a"), _keyed(right, least, longest, "b")
    met = a.join(b, ["_t", "_la", "_lb"])
    if ordered:
        met = met.filter("_a < _b")
    # of the letters that both prefixes hold only the first gives the pair
    met = met.filter(F.col("_t") == F.get(F.array_intersect("_ap", "_bp"), 0))
    both = F.size(F.array_intersect("_as", "_bs"))
    reach = (F.col("_la") == 0) | ((both / F.col("_la") + both / F.col("_lb") + 1) / 3 >= least - SLACK)
    return met.filter(reach).select(F.col("_a").alias("a"), F.col("_b").alias("b"))
