"""Merging, pasting, stamping and filtering of rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.distance import jaro_similarity
from factloom.functions.text import normalize_name_for_grouping, squish
from factloom.operators import fuzzy
from factloom.storage import written

#: What stands between passages, and the characters a passage has more than.
PASSAGE_BREAK, SHORT_PASSAGE = "\n\n---\n\n", 50


def language_of_id(doc_id: Column) -> Column:
    """``bm`` for ids that end in -BM, else ``en``; null stays null."""
    return F.when(doc_id.rlike("-BM$"), "bm").when(doc_id.isNotNull(), "en")


def up_to_year(year: Column, latest: int) -> Column:
    """Rows of years up to ``latest``; those without a year stay."""
    return year.isNull() | (year <= latest)


def classified_input(rows: DataFrame, label: str, motivation: str | None = None) -> DataFrame:
    """Rows labelled as fiscal measures; the primary input wants a discussed motivation too, the sensitivity input does not."""
    fiscal = rows.filter(F.col(label) == "FISCAL_MEASURE")
    return fiscal if motivation is None else fiscal.filter(F.col(motivation))


def bind_countries(parts: list[tuple[str, DataFrame]], column: str = "country") -> DataFrame:
    """Tables of countries one under another, each stamped with its country, which replaces a column of that name."""
    out = None
    for name, df in parts:
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def literal_manifest(spark, rows: list[tuple[int, str, str]], first: int, last: int) -> DataFrame:
    """A manifest written out as (year, package_id, url), cut to the years asked for."""
    return spark.createDataFrame(rows, "year int, package_id string, url string").filter(F.col("year").between(first, last))


def merged_documents(rows: DataFrame, doc_id: str, pages: str, order: str) -> DataFrame:
    """Rows of one id become one: their pages in row order, the first row's other columns; rows of one place go by their values. Rows of a null id are one document."""
    others = [c for c in rows.columns if c not in (doc_id, pages)]
    whole = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*others).alias("_row"), F.col(pages).alias("_pages"))))
    made = rows.groupBy(doc_id).agg(whole.alias("_all"))
    return made.select(doc_id, F.flatten(F.transform("_all", lambda x: F.coalesce(x["_pages"], F.array().cast(rows.schema[pages].dataType)))).alias(pages), *[F.col("_all")[0]["_row"][c].alias(c) for c in others])


def pasted(rows: DataFrame, by: list[str], text: str, source: str, order: list[str]) -> DataFrame:
    """Of each group the number of rows, their texts joined in order and their distinct sources as first seen; nulls are left out, rows of one place go by text and source."""
    whole = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(text).alias("_t"), F.col(source).alias("_s"))))
    made = rows.groupBy(*by).agg(whole.alias("_all"))
    return made.select(
        *by, F.size("_all").alias("n_passages"), F.array_join(F.transform("_all", lambda x: x["_t"]), "\n\n").alias("passages_text"),
        F.array_join(F.array_distinct(F.transform("_all", lambda x: x["_s"])), ", ").alias("passage_sources"),
    )


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with equal keys the first by order (the keys may be null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_span(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least and greatest value of the row's group beside each row."""
    w = Window.partitionBy(*by)
    return rows.select("*", F.min(value).over(w).alias("least"), F.max(value).over(w).alias("greatest"))


def bound_by_place(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Tables bound side by side by an ordinal that both carry; Spark has no order of its own to go by."""
    return left.join(right, place)


def overlap_status(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """PASS if no row of one table has its keys in the other, else FAIL, with the number of those that have."""
    both = left.join(right.select(*keys), keys).agg(F.count(F.lit(1)).alias("n_overlap"))
    return both.select("n_overlap", F.when(F.col("n_overlap") == 0, "PASS").otherwise("FAIL").alias("status"))


def export_rows(rows: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """The columns asked for, in order of type and year; nulls last."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).select(*columns)


def apart(parts: list[str], threshold: float) -> list[int]:
    """Places of the texts that stay when each is held against every earlier one that is still in, as C10 does."""
    words = [frozenset(re.split(r"\s+", p.lower())) for p in parts]
    kept: dict[int, None] = {}
    for i, own in enumerate(words):
        stays = True
        for j in list(kept):
            small, large = sorted((len(own), len(words[j])))
            if small / large < threshold:  # sets of such sizes can't be near
                continue
            both = len(own & words[j])
            if both / (small + large - both) >= threshold:
                if len(parts[i]) <= len(parts[j]):
                    stays = False
                else:
                    del kept[j]
        if stays:
            kept[i] = None
    return sorted(kept)


def distinct_passages(passages: list[str | None], threshold: float = 0.8) -> str:
    """Passages of one act without those near another one, joined.

    Longer passages than ``SHORT_PASSAGE`` take part, in their order. Each is
    held against every earlier one that is still in; of two whose word sets
    have a Jaccard index of ``threshold`` the shorter goes, of equal lengths the
    later. A passage that goes is still held against the rest. If none is long
    enough, all are joined as they are. Nulls are left out.
    """
    whole = [p for p in passages if p is not None]
    parts = [q.strip() for p in whole for q in p.split(PASSAGE_BREAK)]
    parts = [p for p in parts if len(p) > SHORT_PASSAGE]
    if not parts:
        return "\n\n".join(whole)
    return PASSAGE_BREAK.join(parts[i] for i in apart(parts, threshold))


def combined_passages(rows: DataFrame, by: str, text: str, order: str, threshold: float = 0.8) -> DataFrame:
    """C10 for every act: (act, passages_text). An act's passages are a list of one act's mentions, and meet in one task."""
    kind = rows.schema[by].dataType.simpleString()

    def combine(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order, kind="stable")
        return pd.DataFrame({by: t[by].iloc[:1], "passages_text": [distinct_passages(t[text].where(t[text].notna(), None).tolist(), threshold)]})

    return rows.select(by, text, order).groupBy(by).applyInPandas(combine, f"`{by}` {kind}, passages_text string")


def grouped_passages(rows: DataFrame, by: str, threshold: float = 0.8) -> DataFrame:
    """Of each cluster of extracted passages its combined text, distinct pages and documents, number and means.

    ``rows`` has ord, doc_id, page_numbers, passages_text, confidence and
    agreement_rate; names and years of clusters come from ``consensus``. Means
    leave nulls out.
    """
    facts = rows.groupBy(by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("page_numbers"), F.array_sort(F.collect_set("doc_id")).alias("source_docs"),
        F.count(F.lit(1)).alias("n_chunks"), F.avg("confidence").alias("avg_confidence"), F.avg("agreement_rate").alias("avg_agreement_rate"),
    )
    return facts.join(combined_passages(rows, by, "passages_text", "ord", threshold), by)


def snake_names(names: list[str]) -> list[str]:
    """Column names in lower case with underscores; of names that become equal the second gets _2, and so on."""
    out: list[str] = []
    for name in names:
        plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", " percent ").replace("#", " number "))
        plain = re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_") or "x"
        known = sum(1 for x in out if x == plain or re.fullmatch(re.escape(plain) + r"_\d+", x))
        out.append(f"{plain}_{known + 1}" if plain in out else plain)
    return out


def clean_shocks(rows: DataFrame, act: str = "act_name") -> DataFrame:
    """snake_case names, quarters (year and month) as the first of their month, act names squished, exogeneity and categories without white space.

    A quarter that is no year and month becomes null.
    """
    named = rows.toDF(*snake_names(rows.columns))

    def cleaned(c: str) -> Column:
        if "quarter" in c:
            return F.try_to_timestamp(F.col(c), F.lit("yyyy-MM")).cast("date").alias(c)
        if c.endswith(("_exo", "_category")):
            return F.regexp_replace(c, r"\s+", "").alias(c)
        return squish(F.col(c)).alias(c) if c == act else F.col(c)

    return named.select(*[cleaned(c) for c in named.columns])


def kept_acts(names: list[str | None], texts: list[str | None], sizes: list[int], alike: float = 0.9, same_name: float = 0.8) -> list[bool]:
    """C11: which acts stay: of two whose word sets have a Jaccard index of ``alike`` and names a similarity of ``same_name`` that of more chunks, of equal ones the earlier.

    Each act is held against every earlier one that is still in, even after it
    has gone itself. Texts without a word and null names are like no other.
    """
    return _kept(names, [frozenset(re.split(r"\s+", (t or "").lower())) - {""} for t in texts], sizes, alike, same_name)


def _kept(names: list[str | None], words: list[frozenset[str]], sizes: list[int], alike: float, same_name: float) -> list[bool]:
    """``kept_acts`` of word sets; equal ones may be one object."""
    stays, still = [True] * len(words), {}
    for i, own in enumerate(words):
        for j in list(still):
            small, large = sorted((len(own), len(words[j])))
            if not small or small / large < alike:
                continue
            both = small if own is words[j] else len(own & words[j])
            near = both / (small + large - both) >= alike
            if near and names[i] is not None and names[j] is not None and jaro_similarity(names[i], names[j]) >= same_name:
                gone = i if sizes[i] <= sizes[j] else j
                stays[gone] = False
                still.pop(gone, None)
        if stays[i]:
            still[i] = None
    return stays


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(frozenset(re.split(r"\s+", (t or "").lower())) - {""}) for t in texts], dtype=object)


def _near_sets(sets: DataFrame, alike: float) -> DataFrame:
    """Pairs (a < b) of the ids of word sets ``_w`` with a Jaccard index of ``alike``.

    Such sets share a word among the rarest of each: all but ``alike`` of its
    words, and one. Sets without a word are in no pair.
    """
    each = sets.select("_id", F.size("_w").alias("_k"), F.explode("_w").alias("_word"))
    often = each.groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))
    ranked = each.join(often, "_word").groupBy("_id", "_k").agg(F.array_sort(F.collect_list(F.struct("_df", "_word"))).alias("_r"))
    # a little less than the least number of words in common, for the sake of rounding
    rare = F.slice("_r", F.lit(1), (F.col("_k") - F.ceil(F.col("_k") * alike - 1e-9) + 1).cast("int"))
    front = written(ranked.select("_id", "_k", F.explode(rare).alias("_c")).select("_id", "_k", "_c._word"), "rare-words")
    one, two = (front.select(F.col("_id").alias(i), F.col("_k").alias(k), "_word") for i, k in (("a", "_ka"), ("b", "_kb")))
    fits = F.least("_ka", "_kb") / F.greatest("_ka", "_kb") >= alike
    pairs = one.join(two, "_word").filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    words = [sets.select(F.col("_id").alias(i), F.col("_w").alias(w)) for i, w in (("a", "_wa"), ("b", "_wb"))]
    both = F.size(F.array_intersect("_wa", "_wb"))
    met = pairs.join(words[0], "a").join(words[1], "b")
    return met.filter(both / (F.size("_wa") + F.size("_wb") - both) >= alike).select("a", "b")


def distinct_acts(rows: DataFrame, order: str, name: str, text: str, size: str, alike: float = 0.9, same_name: float = 0.8) -> DataFrame:
    """C11: the rows of the acts that stay, by ``kept_acts`` in the order of ``order`` (no value twice).

    Distinct word sets that are alike are joined first. Acts whose sets such
    pairs connect are judged together, a task for each connected lot: each act
    meets the earlier ones there that are still in. Acts without a name or a
    word stay.
    """
    listed = rows.select(F.col(order).alias("_o"), normalize_name_for_grouping(F.col(name)).alias("_n"), F.col(size).cast("long").alias("_s"), _words(F.col(text)).alias("_w"))
    able = listed.filter(F.col("_n").isNotNull() & (F.size("_w") > 0))
    able = written(able.withColumn("_id", F.sha2(F.array_join("_w", " "), 256)), "acts")
    sets = written(able.groupBy("_id").agg(F.first("_w").alias("_w")), "word-sets")
    near = written(_near_sets(sets, alike), "near-sets")
    ends = near.select(F.col("a").alias("_id")).unionByName(near.select(F.col("b").alias("_id"))).distinct()
    linked = fuzzy.connected(ends, near, "_id").select(F.col("v").alias("_id"), F.col("label").alias("_label"))
    lots = sets.join(linked, "_id", "left").select("_id", "_w", F.coalesce("_label", "_id").alias("_lot"))
    members = able.select("_o", "_n", "_s", "_id").join(lots.select("_id", "_lot"), "_id")
    key = rows.schema[order].dataType.simpleString()

    def gone(acts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        acts = acts.sort_values("_o")
        words = dict(zip(known["_id"], map(frozenset, known["_w"])))
        stays = _kept(acts["_n"].tolist(), [words[i] for i in acts["_id"]], acts["_s"].fillna(0).tolist(), alike, same_name)
        return acts.loc[[not x for x in stays], ["_o"]]

    judged = members.groupBy("_lot").cogroup(lots.select(F.col("_lot").alias("_of"), "_id", "_w").groupBy("_of")).applyInPandas(gone, f"_o {key}")
    return rows.join(judged, F.col(order) == F.col("_o"), "left_anti")


def joined_once(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join many to one: an error that names a key if ``right`` has one twice (null keys meet nothing and may repeat)."""
    known = right
    for c in on:
        known = known.filter(F.col(c).isNotNull())
    twice = known.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['_n']} rows for {[twice[0][c] for c in on]} where one was expected")
    return left.join(right, on)


def needs_rescue(native: Column, images: Column, least: int = 100) -> Column:
    """Whether a page should be read by its image: fewer than ``least`` characters without the archive's marks, and an image on it."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.coalesce(native, F.lit("")), F.lit("Digitized for FRASER"), F.lit("")), F.lit("Federal Reserve Bank"), F.lit("")), r"^\s+", ""), r"\s+$", ""))
    return (F.length(clean) < least) & (F.coalesce(images, F.lit(0)) > 0)
