"""Queries over paged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import squish
from factloom.operators import evidence, matching, windows
from factloom.plans import register

KEYS = ("the", "and", "that")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A source with fewer splits than there are cores, dealt to all of them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document are its pages; windows of 10 pages share 3."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.split("text", "\n").alias("pages"))
    return windows.page_windows(docs, size=10, overlap=3)


CHUNKS_SQL = """
pages AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, p, len(p) AS n, unnest(range(1, len(p) + 1, 7)) AS s FROM pages),
windows AS (
  SELECT doc_id, CAST((s - 1) // 7 + 1 AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start_page,
         CAST(least(s + 9, n) AS INTEGER) AS end_page, CAST(least(s + 9, n) - s + 1 AS INTEGER) AS n_pages,
         array_to_string(p[s : least(s + 9, n)], chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10)) AS text
  FROM starts),
chunks AS (SELECT *, CAST(round_even(length(text) / 4, 0) AS INTEGER) AS approx_tokens FROM windows WHERE length(text) > 100)
"""


@register("density_bins", f"""
WITH {CHUNKS_SQL},
counted AS (
  SELECT len(regexp_extract_all(lower(text), '\\b(the|and|that)\\b')) AS k, len(regexp_extract_all(text, '\\S+')) AS w FROM chunks),
d AS (SELECT CASE WHEN w = 0 THEN 0.0 ELSE k / w END AS density FROM counted),
b AS (SELECT CASE WHEN density <= 0.001 THEN '0' WHEN density <= 0.01 THEN '(0,1%]' WHEN density <= 0.03 THEN '(1%,3%]'
      WHEN density <= 0.05 THEN '(3%,5%]' ELSE '>5%' END AS bin FROM d),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT l.bin, coalesce(n.n, 0) AS n_chunks, round_even(100.0 * coalesce(n.n, 0) / (SELECT sum(n) FROM n), 1) AS pct
FROM (VALUES ('0'), ('(0,1%]'), ('(1%,3%]'), ('(3%,5%]'), ('>5%')) AS l(bin) LEFT JOIN n ON n.bin = l.bin
""")
def density_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    _, _, density = windows.keyword_density(F.col("text"), KEYS)
    counts = chunks.select(windows.density_bin(density).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    labels = spark.createDataFrame([(x,) for x in windows.DENSITY_LABELS], "bin string")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return labels.join(counts, "bin", "left").crossJoin(total).select("bin", n.alias("n_chunks"), F.bround(F.try_divide(F.lit(100.0) * n, F.col("total")), 1).alias("pct"))


@register("chunk_windows", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_id, start_page, end_page, n_pages, approx_tokens, md5(text) AS text_md5 FROM chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("doc_id", "chunk_id", "start_page", "end_page", "n_pages", "approx_tokens", F.md5("text").alias("text_md5"))


@register("chunk_summary", f"""WITH {CHUNKS_SQL}
SELECT doc_id, count(*) AS n_chunks, CAST(sum(n_pages) AS BIGINT) AS total_pages, CAST(sum(approx_tokens) AS BIGINT) AS total_tokens, round(avg(approx_tokens), 6) AS mean_tokens, max(approx_tokens) AS max_tokens FROM chunks GROUP BY doc_id""")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chunk_summary(chunks_of(spark, sf_dir)).withColumn("mean_tokens", F.round("mean_tokens", 6))


@register("chunk_validation", f"""WITH {CHUNKS_SQL}
SELECT count(*) AS n_chunks, count(*) FILTER (approx_tokens > 1000) AS too_long, count(*) FILTER (length(text) <= 100) AS too_short, count(DISTINCT doc_id) AS n_docs FROM chunks""")
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("approx_tokens") > 1000).alias("too_long"), F.count_if(F.length("text") <= 100).alias("too_short"), F.countDistinct("doc_id").alias("n_docs")
    )


def passages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("passage"))


def whole_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


SQUISHED = "trim(regexp_replace(regexp_replace(lower(text), '(\\w)-\\s+(\\w)', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"
TIER1_SQL = f"""
t AS MATERIALIZED (SELECT doc_id, {SQUISHED} AS t FROM documents),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS name, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS p FROM benchmark),
q AS (SELECT * FROM p WHERE length(p) > 50),
l AS MATERIALIZED (SELECT name, p, min(doc_id) AS doc_id FROM q JOIN t ON contains(t.t, substr(q.p, 1, 100)) GROUP BY name, p),
s AS (SELECT name, p, min(doc_id) AS doc_id FROM (SELECT * FROM q ANTI JOIN l USING (name, p)) r JOIN t ON contains(t.t, substr(r.p, 1, 60)) GROUP BY name, p),
tier1 AS MATERIALIZED (SELECT DISTINCT doc_id, name FROM (SELECT * FROM l UNION ALL SELECT * FROM s))
"""
TIER2_SQL = TIER1_SQL + """,
w AS (SELECT DISTINCT name, substr(p, 1, 30) AS w FROM q),
tier2 AS MATERIALIZED (SELECT DISTINCT doc_id, name FROM (SELECT * FROM t WHERE doc_id NOT IN (SELECT doc_id FROM tier1)) d JOIN w ON contains(d.t, w.w))
"""


def tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, passages = whole_docs(spark, sf_dir), passages_of(spark, sf_dir)
    tier1 = matching.passage_matches(docs, passages, ["doc_id"], ["doc_id"])
    terms = passages.select("name", F.substring(squish(F.lower("passage")), 1, 30).alias("term"), F.length(squish("passage")).alias("n")).filter("n > 50")
    return tier1, matching.term_matches(docs, terms, ["doc_id"], exclude=tier1)


@register("tier1_passage_match", f"WITH {TIER1_SQL} SELECT doc_id, name FROM tier1")
def tier1_passage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(spark, sf_dir)[0]


@register("tier2_term_match", f"WITH {TIER2_SQL} SELECT doc_id, name FROM tier2")
def tier2_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(spark, sf_dir)[1]


@register("negatives_anti", f"WITH {TIER2_SQL} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tier1) AND doc_id NOT IN (SELECT doc_id FROM tier2)")
def negatives_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.negatives(whole_docs(spark, sf_dir).select("doc_id"), *tiers(spark, sf_dir), key=["doc_id"])


@register("multi_passage_docs", f"""WITH {TIER2_SQL}, u AS (SELECT * FROM tier1 UNION ALL SELECT * FROM tier2)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, count(DISTINCT name) AS n_names FROM u GROUP BY doc_id HAVING count(DISTINCT name) >= 1""")
def multi_passage_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tiers(spark, sf_dir)
    return matching.several_names(a.unionByName(b), ["doc_id"], least=1).withColumn("names", F.array_join("names", ","))


@register("cooccurrence", """
SELECT doc_id, (contains(lower(text), 'the') AND contains(lower(text), 'and')) OR (contains(lower(text), 'der') AND contains(lower(text), 'die')) AS present FROM documents""")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_docs(spark, sf_dir).select("doc_id", matching.all_terms_present(F.col("text"), [["the", "and"], ["der", "die"]]).alias("present"))


@register("page_quality", """
SELECT page_id, length(html) < 100 AS short, coalesce(len(regexp_extract_all(html, '[^a-zA-Z0-9\\s.,!?;:''-]')) / nullif(length(html), 0) > 0.1, false) AS special,
       coalesce(len(regexp_extract_all(html, '[^\\x00-\\x7F]')) / nullif(length(html), 0) > 0.05, false) AS non_ascii FROM pages""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = evidence.page_flags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in flags.items()])


@register("dup_hash", """
WITH h AS (SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:5], '')) AS h, text FROM documents WHERE text <> ''),
n AS (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) SELECT doc_id, h AS first_pages_md5, n AS n_same FROM n WHERE n > 1""")
def dup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole_docs(spark, sf_dir).filter("text <> ''").select("doc_id", F.md5(F.array_join(F.slice(F.split("text", "\n"), 1, 5), "")).alias("first_pages_md5"))
    counts = docs.groupBy("first_pages_md5").agg(F.count(F.lit(1)).alias("n_same")).filter("n_same > 1")
    return docs.join(counts, "first_pages_md5").select("doc_id", "first_pages_md5", "n_same")
