"""Passages and terms in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import squish, squish_for_matching
from factloom.storage import written

#: Terms too broad to search for.
BROAD_TERMS = (
    "investment tax credit", "balanced budget", "taxpayer relief", "excess profits tax", "depreciation guidelines", "temporary income tax",
    "revenue", "economic growth", "jobs", "tax reduction", "job creation", "tax equity",
)

#: Fixed value: names of acts inside longer names.
FORMAL_NAME = r"([A-Z][\w-]+(?:\s+[A-Z][\w-]+)*\s+Act\s+of\s+\d{4})"
#: Fixed value: names that tell of an event, its action and its subject.
EVENT_NAME = r"^(Expiration|Suspension|Restoration|Changes)\s+(?:in\s+)?(.*?)(?:\s+and\s+|$)"


#: About so many distinct terms are sent to every task at a time, as one automaton.
MOST_TERMS = 200_000


def _found(listed: list[str]):
    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for word in listed:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({w for _, w in automaton.iter(t)}) if t and listed else [] for t in texts], dtype=object)

    return found


def holding(rows: DataFrame, text: str, terms: DataFrame, term: str, most: int = MOST_TERMS) -> DataFrame:
    """Each row with each distinct term that its text holds, in a column ``term``.

    An automaton of the terms reads every text once, however many terms there
    are up to about ``most``; more are dealt into as many automata as they take,
    one after the other. Null texts, null terms and empty terms give no rows.
    """
    words = terms.select(term).filter(F.length(term) > 0).distinct()
    blocks = max(1, -(-words.count() // most))
    out = None
    for b in range(blocks):
        # a block at a time: the driver holds the terms of one
        listed = [r[0] for r in words.filter(F.pmod(F.xxhash64(term), F.lit(blocks)) == b).collect()]
        part = rows.withColumn(term, F.explode(_found(listed)(F.col(text))))
        part = part if blocks == 1 else written(part, "holding")
        out = part if out is None else out.unionByName(part)
    return out


def passage_matches(chunks: DataFrame, passages: DataFrame, key: list[str], order: list[str], text: str = "text", name: str = "name", passage: str = "passage", probe: int = 100, shorter: int = 60, least: int = 50) -> DataFrame:
    """For each passage of more than ``least`` characters the first chunk that holds its first ``probe`` ones.

    Passages without such a chunk are tried with ``shorter`` characters. The
    passages are a gold table, so they are the side that Spark may broadcast.
    Returns key columns and name, distinct.
    """
    found = passages.select(name, squish(F.lower(passage)).alias("_p")).filter(F.length("_p") > least).distinct()
    here = chunks.select(*key, squish_for_matching(F.col(text)).alias("_t"), *[c for c in order if c not in key])
    probes = found.select(name, "_p", F.posexplode(F.array(F.substring("_p", 1, probe), F.substring("_p", 1, shorter))).alias("_short", "_probe"))
    met = holding(here, "_t", probes, "_probe").drop("_t").join(probes, "_probe")
    first = Window.partitionBy(name, "_p").orderBy("_short", *order)
    return met.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(*key, name).distinct()


def term_matches(chunks: DataFrame, terms: DataFrame, key: list[str], exclude: DataFrame | None = None, text: str = "text", name: str = "name", term: str = "term") -> DataFrame:
    """All chunks that hold any term of a name, without chunks of ``exclude`` (whatever their name)."""
    here = chunks if exclude is None else chunks.join(exclude.select(*key).distinct(), key, "left_anti")
    t = terms.select(name, squish(F.lower(term)).alias("_term")).filter(F.length("_term") > 0).distinct()
    texts = here.select(*key, squish_for_matching(F.col(text)).alias("_t"))
    return holding(texts, "_t", t, "_term").drop("_t").join(t, "_term").select(*key, name).distinct()


def all_terms_present(text: Column, rules: list[list[str]]) -> Column:
    """Every term of some rule is in the text."""
    out = F.lit(False)
    for terms in rules:
        every = F.lit(True)
        for t in terms:
            every = every & F.contains(F.lower(text), F.lit(t.lower()))
        out = out | every
    return out


def search_terms(names: DataFrame, name: str = "name") -> DataFrame:
    """Search terms of a name with the mechanism they come from; a term keeps its first mechanism.

    Null names give no rows. Terms are compared with the broad ones ignoring case.
    """
    n = F.col(name)
    none = F.array().cast("array<string>")
    inner = F.regexp_extract(n, r"\(([^)]+)\)", 1)
    with_article = F.when(F.contains(inner, F.lit(" of ")) & ~F.contains(inner, F.lit(" of the ")), F.array(F.regexp_replace(inner, r"^(.*?) of ", "$1 of the ")))
    before = F.when(F.contains(n, F.lit("(")), F.array(F.regexp_replace(n, r"^(.*?)\s*\([^)]+\)", "$1")))
    action, subject = F.lower(F.regexp_extract(n, EVENT_NAME, 1)), F.lower(F.trim(F.regexp_extract(n, EVENT_NAME, 2)))
    event = F.when(action != "", F.array(F.concat(action, F.lit(" of the "), subject), F.concat(action, F.lit(" of "), subject)))
    mechanisms = [
        ("Full name", F.array(n)),
        ("Split on 'and'", F.when(F.contains(n, F.lit(" and ")), F.split(n, " and "))),
        ("Parenthetical", F.array(inner)),
        ("Parenthetical + article", with_article),
        ("Before parenthetical", before),
        ("Embedded formal name", F.regexp_extract_all(n, F.lit(FORMAL_NAME))),
        ("Public Law number", F.array(F.regexp_extract(n, r"Public Law \d+-\d+", 0))),
        ("Action + subject", event),
    ]

    def entries(order: int, mechanism: str, terms: Column) -> Column:
        return F.transform(F.coalesce(terms, none), lambda t: F.struct(F.lit(order).alias("order"), F.lit(mechanism).alias("mechanism"), F.trim(t).alias("term")))

    found = [entries(i, kind, terms) for i, (kind, terms) in enumerate(mechanisms)]
    rows = names.filter(n.isNotNull()).select(name, F.explode(F.concat(*found)).alias("_t")).select(name, "_t.*")
    kept = rows.filter((F.length("term") > 0) & ~F.lower("term").isin(*BROAD_TERMS))
    return kept.groupBy(name, "term").agg(F.min_by("mechanism", "order").alias("mechanism"))


def negatives(chunks: DataFrame, *positives: DataFrame, key: list[str]) -> DataFrame:
    """Chunks that no positive table holds."""
    for p in positives:
        chunks = chunks.join(p.select(*key).distinct(), key, "left_anti")
    return chunks


def several_names(matches: DataFrame, key: list[str], name: str = "name", least: int = 2) -> DataFrame:
    """Chunks that match at least ``least`` names."""
    names = F.array_sort(F.collect_set(name))
    return matches.groupBy(*key).agg(names.alias("names"), F.countDistinct(name).alias("n_names")).filter(F.col("n_names") >= least)


def term_counts(chunks: DataFrame, terms: DataFrame, key: list[str], text: str = "text", name: str = "name", term: str = "term", mechanism: str = "mechanism") -> DataFrame:
    """Chunks that hold each term, by name and mechanism; terms without a chunk, and empty terms, count 0."""
    t = terms.select(name, term, mechanism, squish(F.lower(term)).alias("_term")).distinct()
    here = chunks.select(*key, squish_for_matching(F.col(text)).alias("_t"))
    counts = holding(here, "_t", t, "_term").groupBy("_term").agg(F.count(F.lit(1)).alias("_n"))
    return t.join(counts, "_term", "left").select(name, term, mechanism, F.coalesce("_n", F.lit(0)).alias("n_chunks"))


def contains_either(a: Column, b: Column) -> Column:
    """One of two strings holds the other, ignoring case; null if either is null."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x)


def coverage_status(names: DataFrame, first: DataFrame, second: DataFrame, name: str = "name") -> DataFrame:
    """Q20: number and share of the names found in both tiers, in one of them or in none."""
    marked = names.select(name).distinct()
    for tier, flag in ((first, "_one"), (second, "_two")):
        marked = marked.join(tier.select(name).distinct().withColumn(flag, F.lit(True)), name, "left")
    one, two = F.col("_one").isNotNull(), F.col("_two").isNotNull()
    status = F.when(one & two, "both").when(one, "tier 1 only").when(two, "tier 2 only").otherwise("uncovered")
    counts = marked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
