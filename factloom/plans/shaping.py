"""Queries of merged, pasted, stamped and filtered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import evidence, shaping, tallies, windows
from factloom.plans import register
from factloom.plans.corpus import CHUNKS_SQL, chunks_of, table


@register("merged_conversations", """SELECT conv_id, md5(array_to_string(list(text ORDER BY turn), chr(10))) AS pages_md5, count(text) AS n_pages, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id""")
def merged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array("text").alias("pages"))
    merged = shaping.merged_documents(rows, "conv_id", "pages", "turn")
    return merged.select("conv_id", F.md5(F.array_join("pages", "\n")).alias("pages_md5"), F.size("pages").cast("long").alias("n_pages"), "role")


@register("pasted_comments", """SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_passages, string_agg(l_linestatus, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_linestatus, l_returnflag) AS passages_text,
 (SELECT string_agg(m, ', ' ORDER BY f) FROM (SELECT m, min(i) AS f FROM (SELECT unnest(s) AS m, unnest(range(len(s))) AS i) GROUP BY m)) AS passage_sources
FROM (SELECT *, list(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_linestatus, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM lineitem) GROUP BY l_orderkey, s""")
def pasted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.pasted(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linestatus", "l_returnflag", ["l_linenumber", "l_partkey"])


@register("first_orders", """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return shaping.first_rows(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])


@register("price_spans", """SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS least, max(o_totalprice) OVER (PARTITION BY o_custkey) AS greatest FROM orders""")
def price_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.with_span(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice").select("o_orderkey", "least", "greatest")


@register("bound_turns", """SELECT d.doc_id, d.lang, v.vec_id FROM documents d JOIN embeddings v ON d.doc_id = v.vec_id""")
def bound_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), "lang")
    right = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("place"), "vec_id")
    return shaping.bound_by_place(left, right, "place").select(F.col("place").alias("doc_id"), "lang", "vec_id")


@register("label_overlap", """SELECT count(*) AS n_overlap, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT doc_id FROM labels WHERE quality = 1) a JOIN (SELECT doc_id FROM labels WHERE toxic = 1) b USING (doc_id)""")
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return shaping.overlap_status(labels.filter("quality = 1").select("doc_id"), labels.filter("toxic = 1").select("doc_id"), ["doc_id"])


@register("exported_orders", """SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year FROM orders""")
def exported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return shaping.export_rows(rows, ["o_orderkey", "o_orderpriority", "year"], "o_orderpriority", "year", "o_orderkey")


@register("stamped_countries", """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'A' ELSE 'B' END AS country FROM documents WHERE lang IN ('en', 'fr', 'de')""")
def stamped_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("country"))
    return shaping.bind_countries([("A", docs.filter(F.col("lang").isin("en", "fr"))), ("B", docs.filter("lang = 'de'"))]).select("doc_id", "country")


@register("recent_orders", """SELECT y, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(o_orderdate) END AS y FROM orders) WHERE y IS NULL OR y <= 1995 GROUP BY y""")
def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.year("o_orderdate")).alias("y"))
    return rows.filter(shaping.up_to_year(F.col("y"), 1995)).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("classified_inputs", """SELECT 'primary' AS input, count(*) AS n FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT 'sensitivity', count(*) FROM labels WHERE quality = 1""")
def classified_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "FISCAL_MEASURE").otherwise("NOT_FISCAL_MEASURE").alias("label"), (F.col("toxic") == 0).alias("motivation"))
    n = F.count(F.lit(1)).alias("n")
    one = shaping.classified_input(rows, "label", "motivation").agg(n).select(F.lit("primary").alias("input"), "n")
    return one.unionByName(shaping.classified_input(rows, "label").agg(n).select(F.lit("sensitivity").alias("input"), "n"))


@register("gated_measures", """SELECT count(*) AS n FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 AND length(d.text) % 3 = 1 AND l.toxic = 0 AND coalesce(d.source, '') <> 'web'""")
def gated_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    label = F.when(F.col("quality") == 1, "FISCAL_MEASURE").otherwise("NOT_FISCAL_MEASURE")
    country = F.when(F.col("source") == "web", "OTHER").otherwise(F.col("source"))
    return rows.filter(evidence.passes_gate(label, F.length("text") % 3, F.col("toxic") == 0, country)).agg(F.count(F.lit(1)).alias("n"))


@register("normalized_names", """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(x), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS plain,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '\\b(the|of|act|and)\\b', '', 'g'), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS grouping,
 CASE WHEN length(x) > 20 THEN substring(x, 1, 19) || '…' ELSE x END AS short, CASE WHEN regexp_matches(x, '-BM$') THEN 'bm' ELSE 'en' END AS language
FROM (SELECT p_partkey, 'The ' || p_name || '  & Act of ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '-BM' ELSE '' END AS x FROM part)""")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("The "), "p_name", F.lit("  & Act of "), "p_type", F.when(F.col("p_partkey") % 2 == 0, "-BM").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("x"))
    x = F.col("x")
    return rows.select("p_partkey", X.normalize_name(x).alias("plain"), X.normalize_name_for_grouping(x).alias("grouping"), X.truncate(x, 20).alias("short"), shaping.language_of_id(x).alias("language"))


@register("worst_chunks", f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_id, n_pages, approx_tokens FROM chunks WHERE approx_tokens > 1000 ORDER BY approx_tokens DESC, doc_id, chunk_id LIMIT 5""")
def worst_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.worst_chunks(chunks_of(spark, sf_dir), 1000)


@register("suspicious_pages", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, length(t) < 100 AS short, len(regexp_extract_all(t, '[^a-zA-Z0-9\\s.,!?;:''-]')) / greatest(length(t), 1) > 0.1 AS special,
 len(regexp_extract_all(t, '[^\\x00-\\x7F]')) / greatest(length(t), 1) > 0.05 AS non_ascii, NOT regexp_matches(lower(t), '\\b(the|and|that)\\b') AND k > 5 AS no_vocabulary FROM p)
SELECT count(*) AS n_pages, count(*) FILTER (short) AS short, count(*) FILTER (special) AS special, count(*) FILTER (non_ascii) AS non_ascii, count(*) FILTER (no_vocabulary) AS no_vocabulary,
 count(*) FILTER (short OR special OR non_ascii OR no_vocabulary) AS suspicious FROM f""")
def suspicious_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.posexplode(F.split("text", "\n")).alias("_at", "t"))
    flags = evidence.page_flags(F.col("t"), F.col("_at") + 1, ("the", "and", "that"))
    rows = pages.select(*[c.alias(k) for k, c in flags.items()])
    anything = F.col("short") | F.col("special") | F.col("non_ascii") | F.col("no_vocabulary")
    return rows.agg(F.count(F.lit(1)).alias("n_pages"), *[F.count_if(k).alias(k) for k in flags], F.count_if(anything).alias("suspicious"))


@register("combined_passages")
def combined_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation without those near another one."""
    return shaping.combined_passages(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


@register("cleaned_shocks", """SELECT o_orderkey AS order_key, trim(regexp_replace(' ' || o_orderpriority || '  x ', '\\s+', ' ', 'g')) AS act_name, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS change_quarter, replace(o_orderpriority, ' ', '') AS present_category FROM orders""")
def cleaned_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("OrderKey"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  x ")).alias("Act Name"),
        F.date_format("o_orderdate", "yyyy-MM").alias("Change Quarter"), F.col("o_orderpriority").alias("Present Category"),
    )
    return shaping.clean_shocks(rows)


@register("distinct_acts")
def distinct_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a gold list of acts: those of one nation share their words."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("act of nation "), F.col("s_nationkey").cast("string")).alias("passages_text"), (F.col("s_suppkey") % 5).alias("n_chunks"))
    return shaping.distinct_acts(rows, "s_suppkey", "s_name", "passages_text", "n_chunks")


PER_DOC = """SELECT CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) AS year, CASE WHEN o_orderstatus = 'F' THEN 'bm' ELSE 'en' END AS doc_language, count(DISTINCT o_custkey) AS n_measures, count(DISTINCT o_custkey % 40) AS n_acts,
 round(count(DISTINCT o_custkey) / greatest(count(DISTINCT o_custkey % 40), 1), 9) AS compression FROM orders GROUP BY 1, 2"""


@register("document_compression", PER_DOC)
def document_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("er-"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderstatus") == "F", "-BM").otherwise(""))
    rows = table(spark, sf_dir, "orders").select(group.alias("g"), "o_custkey", (F.col("o_custkey") % 40).alias("c"))
    return tallies.document_compression(rows, "g", "o_custkey", "c").withColumn("compression", F.round("compression", 9))
