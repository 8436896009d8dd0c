"""Queries of search terms, tiers, pages and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import matching, paragraphs
from factloom.plans import register
from factloom.plans.corpus import CHUNKS_SQL, KEYS, chunks_of, table

ACTS_SQL = """acts AS (SELECT CASE n_nationkey % 5 WHEN 0 THEN 'Relief Act of 1997 and ' || n_name || ' Budget Act of 1997' WHEN 1 THEN n_name || ' Package (Tariff of ' || n_name || ')'
 WHEN 2 THEN 'Public Law 1-' || n_nationkey || ' and jobs' WHEN 3 THEN 'Expiration of ' || n_name || ' and Revenue' ELSE 'Suspension in ' || n_name END AS name FROM nation)"""


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey") % 5
    name = (
        F.when(k == 0, F.concat(F.lit("Relief Act of 1997 and "), n, F.lit(" Budget Act of 1997")))
        .when(k == 1, F.concat(n, F.lit(" Package (Tariff of "), n, F.lit(")")))
        .when(k == 2, F.concat(F.lit("Public Law 1-"), F.col("n_nationkey").cast("string"), F.lit(" and jobs")))
        .when(k == 3, F.concat(F.lit("Expiration of "), n, F.lit(" and Revenue")))
        .otherwise(F.concat(F.lit("Suspension in "), n))
    )
    return table(spark, sf_dir, "nation").select(name.alias("name"))


EVENT = r"'^(Expiration|Suspension|Restoration|Changes)\s+(?:in\s+)?(.*?)(?:\s+and\s+|$)'"


@register("search_terms", rf"""WITH {ACTS_SQL}, e AS (SELECT name, lower(regexp_extract(name, {EVENT}, 1)) AS a, lower(trim(regexp_extract(name, {EVENT}, 2))) AS s, regexp_extract(name, '\(([^)]+)\)', 1) AS p FROM acts),
t AS (SELECT name, 1 AS o, 'Full name' AS mechanism, name AS term FROM e
 UNION ALL SELECT name, 2, 'Split on ''and''', trim(unnest(string_split(name, ' and '))) FROM e WHERE contains(name, ' and ')
 UNION ALL SELECT name, 3, 'Parenthetical', p FROM e
 UNION ALL SELECT name, 4, 'Parenthetical + article', regexp_replace(p, ' of ', ' of the ') FROM e WHERE contains(p, ' of ') AND NOT contains(p, ' of the ')
 UNION ALL SELECT name, 5, 'Before parenthetical', trim(regexp_replace(name, '\s*\([^)]+\)', '')) FROM e WHERE contains(name, '(')
 UNION ALL SELECT name, 6, 'Embedded formal name', unnest(regexp_extract_all(name, '[A-Z][\w-]+(?:\s+[A-Z][\w-]+)*\s+Act\s+of\s+\d{{4}}')) FROM e
 UNION ALL SELECT name, 7, 'Public Law number', regexp_extract(name, 'Public Law \d+-\d+') FROM e
 UNION ALL SELECT name, 8, 'Action + subject', unnest([a || ' of the ' || s, a || ' of ' || s]) FROM e WHERE a <> '')
SELECT name, term, arg_min(mechanism, o) AS mechanism FROM t WHERE term <> '' AND lower(term) NOT IN ('investment tax credit', 'balanced budget', 'taxpayer relief', 'excess profits tax', 'depreciation guidelines', 'temporary income tax',
 'revenue', 'economic growth', 'jobs', 'tax reduction', 'job creation', 'tax equity') GROUP BY 1, 2""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.search_terms(acts(spark, sf_dir))


PROBES_SQL = """terms AS (SELECT item_id AS name, lower(substr(text, 1, 30)) AS term, 'probe' AS mechanism FROM benchmark UNION ALL SELECT item_id, lower(substr(text, 41, 15)), 'inner' FROM benchmark)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "name")
    return b.select("name", F.lower(F.substring("text", 1, 30)).alias("term"), F.lit("probe").alias("mechanism")).unionByName(b.select("name", F.lower(F.substring("text", 41, 15)).alias("term"), F.lit("inner").alias("mechanism")))


@register("term_counts", rf"""WITH {CHUNKS_SQL}, {PROBES_SQL}, c AS (SELECT trim(regexp_replace(regexp_replace(lower(text), '(\w)-\s+(\w)', '\1\2', 'g'), '\s+', ' ', 'g')) AS t FROM chunks),
q AS (SELECT DISTINCT name, term, mechanism, trim(regexp_replace(term, '\s+', ' ', 'g')) AS s FROM terms)
SELECT name, term, mechanism, count(c.t) AS n_chunks FROM q LEFT JOIN c ON contains(c.t, q.s) GROUP BY 1, 2, 3""")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.term_counts(chunks_of(spark, sf_dir), probes(spark, sf_dir), ["doc_id", "chunk_id"])


@register("tier_coverage", """WITH n AS (SELECT DISTINCT c_nationkey AS k FROM customer), a AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0), b AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < -900),
s AS (SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'tier 1 only' WHEN b.k IS NOT NULL THEN 'tier 2 only' ELSE 'uncovered' END AS status FROM n LEFT JOIN a USING (k) LEFT JOIN b USING (k))
SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM s GROUP BY 1""")
def tier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("name"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("name"))
    return matching.coverage_status(c, s, c.filter("c_acctbal < -900")).withColumn("share", F.round("share", 9))


@register("contains_either", """SELECT r_name, n_name, contains(lower(r_name), lower(left(n_name, 2))) OR contains(lower(left(n_name, 2)), lower(r_name)) AS either FROM nation JOIN region ON n_regionkey = r_regionkey""")
def contains_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("r_name", "n_name", matching.contains_either(F.col("r_name"), F.substring("n_name", 1, 2)).alias("either"))


LINES_SQL = "lines AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))"
MADE_SQL = r"len(regexp_extract_all({0}, '\S+')) AS n_tokens, len(regexp_extract_all({0}, '\b\d+\b')) AS n_numbers, CAST(regexp_matches(lower({0}), '\b(the|and|that)\b') AS INTEGER) AS relevant"


@register("page_features", f"WITH {LINES_SQL} SELECT doc_id, CAST(n AS INTEGER) AS page_number, {MADE_SQL.format('t')} FROM lines")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("pages", F.split("text", "\n"))
    return paragraphs.page_features(docs, "pages", KEYS, "doc_id").drop("text")


PARAGRAPHS_SQL = f"""{LINES_SQL}, paragraphs AS (SELECT doc_id, CAST(n AS INTEGER) AS paragraph_number, lower(t) AS p, {MADE_SQL.format('lower(t)')}, CAST(count(*) OVER (PARTITION BY doc_id, lower(t)) > 1 AS INTEGER) AS is_duplicate FROM lines WHERE t <> '')"""


@register("paragraph_features", f"WITH {PARAGRAPHS_SQL} SELECT doc_id, paragraph_number, md5(p) AS p_md5, n_tokens, n_numbers, relevant, is_duplicate FROM paragraphs")
def paragraph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paragraphs.paragraph_features(table(spark, sf_dir, "documents"), "doc_id", "text", KEYS, "\n")
    return got.withColumn("p_md5", F.md5("paragraph")).drop("paragraph")


@register("relevant_paragraphs", f"WITH {PARAGRAPHS_SQL} SELECT doc_id, count(*) AS n_relevant, sum(n_tokens)::BIGINT AS n_tokens FROM paragraphs WHERE relevant = 1 AND is_duplicate = 0 AND n_numbers < 0.5 * n_tokens GROUP BY 1")
def relevant_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paragraphs.paragraph_features(table(spark, sf_dir, "documents"), "doc_id", "text", KEYS, "\n")
    return paragraphs.relevant_paragraphs(got).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum("n_tokens").alias("n_tokens"))


@register("document_texts", r"""WITH d AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1) SELECT conv_id, md5(t) AS text_md5, len(regexp_extract_all(t, '\S+')) AS n_tokens FROM d""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return paragraphs.document_texts(turns, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_md5"), "n_tokens")


@register("mention_counts", r"""WITH d AS (SELECT len(regexp_extract_all(text, '\$\s?\d+')) AS a, len(regexp_extract_all(text, '[0-9]+(\.[0-9]+)?\s?%')) AS b, len(regexp_extract_all(text, '(19[4-9]\d|20[0-2]\d)')) AS c FROM documents)
SELECT unnest(['dollars', 'percent', 'years']) AS pattern, unnest([coalesce(sum(a), 0), coalesce(sum(b), 0), coalesce(sum(c), 0)])::BIGINT AS n_matches, unnest([count(*) FILTER (a > 0), count(*) FILTER (b > 0), count(*) FILTER (c > 0)]) AS n_rows FROM d""")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = {"dollars": r"\$\s?\d+", "percent": r"[0-9]+(\.[0-9]+)?\s?%", "years": r"(19[4-9]\d|20[0-2]\d)"}
    return paragraphs.mentions(table(spark, sf_dir, "documents"), "text", patterns)


@register("page_lengths", f"WITH {LINES_SQL} SELECT min(length(t)) AS shortest, max(length(t)) AS longest, round(avg(length(t)), 6) AS mean, sum(length(t))::BIGINT AS total FROM lines")
def page_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("t").cast("long")
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("t"))
    return rows.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.sum(n).alias("total"))


@register("chunk_coverage", f"""WITH {CHUNKS_SQL}, e AS (SELECT doc_id, min(start_page) AS first_page, max(end_page) AS last_page FROM chunks GROUP BY 1)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pages, first_page, last_page, first_page = 1 AND last_page >= len(p) AS covered FROM pages JOIN e USING (doc_id)""")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_pages"))
    return paragraphs.covered(chunks_of(spark, sf_dir), docs, "doc_id", "n_pages")
