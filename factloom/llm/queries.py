"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import divergence, langid, lexical, line_dedup, lm_scoring, media, mixing, near_dedup, packing, quality, sharding, token_counts, topk
from factloom.llm.common import read_table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@F.pandas_udf(T.LongType())
def _ids_crc32(ids: pd.Series) -> pd.Series:
    """crc32 of two-byte ids written as unsigned 32-bit, little-endian."""
    return pd.Series([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], dtype="int64")


@query("op1_pack")
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER, capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), _ids_crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op4_mix")
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed at weights 5, 2, 1, none above three times its size."""
    spans, laid = mixing.mix_spans(read_table(spark, sf_dir, "documents"))
    return mixing.taken_words(spans, laid).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_media")
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as mu-law files, stored in the shared folder, read back and described."""
    files = media.read_media(written(media.encode_media(read_table(spark, sf_dir, "documents")), "media"))
    n = F.length("payload")
    return files.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query("op7_shard")
def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on a bounded-load ring of eight shards, counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sharding.assign_shards(docs, ["doc_id", "size", "text_crc32"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op9_topk",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of each query vector."""
    vectors = topk.whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


@query(
    "op8_near_dedup",
    r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
x AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM t WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
r AS (SELECT a AS v, a AS u FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id
""",
)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their four-word shingles."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts scored by a suffix tree and by add-one unigrams."""
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of whole texts."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


@query("op5_langid")
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query(
    "op11_line_dedup",
    """
WITH l AS (SELECT doc_id, i, x[i] AS line, translate(trim(x[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
r AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.top AS gone FROM l LEFT JOIN r ON r.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
""",
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least three documents hold, but in the largest of these."""
    left = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op12_source_audit",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT x.lang, source, x.term, count(*) AS n FROM x JOIN k ON k.lang = x.lang AND k.term = x.term GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
f AS (SELECT k.lang, n.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (n.n + v.v) AS p
  FROM k JOIN n ON n.lang = k.lang JOIN v ON v.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.source = n.source AND c.term = k.term),
l AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // (any_value(a.n) + any_value(v.v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY lang) a ON a.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term),
t AS (SELECT f.lang, f.source, 'term' AS part, f.term AS item, ((p - q) * (p - q)) // q AS value FROM f JOIN l ON l.lang = f.lang AND l.term = f.term WHERE f.c > 0 AND p > q),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM f a JOIN f b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM p))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM u WHERE part = 'pair' OR rank <= 200
""",
)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the most typical terms of each."""
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


@query(
    "op13_search",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT i.item_id, p.r, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM i JOIN p ON p.term = i.term JOIN w ON w.term = i.term, s GROUP BY i.item_id, p.r, p.doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""",
)
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)
