"""One text of many megabytes beside short ones through every operator."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import divergence, langid, lexical, line_dedup, media, mixing, near_dedup, packing, quality, queries, sharding, token_counts

DOC = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(110_000)]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text, "en", "a"), (2, long_text + " end", "en", "b"), (3, "a few words", "en", "a"), (4, "ein paar Worte", "de", "a"), (5, None, None, None)]
    rows += [(10 + i, f"{'the tax of spring' if i % 2 else 'die steuer im mai'} number {i}", "en" if i % 2 else "de", "ab"[i % 2]) for i in range(30)]
    return queries.written(spark.createDataFrame(rows, DOC), "long")


def test_counts_and_files(docs, long_text):
    got = {r.doc_id: r.n_words for r in token_counts.token_counts(docs, queries.PIECE_MODEL).collect()}
    assert got[1] == len(long_text.split()) and got[5] == 0
    files = media.read_media(queries.written(media.encode_media(docs), "media"))
    assert {r.doc_id: r.n for r in files.select("doc_id", F.length("payload").alias("n")).collect()}[1] == -(-len(long_text) // 576) * 576


def test_packing_and_shards(docs, long_text):
    rows = packing.pack_documents(docs, queries.WORD_TOKENIZER).filter("doc_id = 1").select("piece", "start", "length").orderBy("piece").collect()
    assert [r.piece for r in rows] == list(range(len(rows))) and all(r.length == 4096 for r in rows[:-1]) and rows[-1].start == 4096 * (len(rows) - 1)
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    assert sharding.assign_shards(sized, ["doc_id", "size"]).count() == docs.count()


def test_mix(docs, long_text):
    spans, laid = mixing.mix_spans(docs)
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.taken_words(spans, laid).collect()}
    assert taken[1][0] == len(long_text.split()) and 0 < taken[1][1] <= 3 * taken[1][0]


def test_models(spark, docs):
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert len(got) == docs.count() and got[5] == "und" and got[1] in ("en", "de")
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert quality.classify(docs, labels).filter("score BETWEEN 0 AND 1").count() == docs.count()


def test_near_copies(docs):
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, words=5, percent=80).collect()}
    assert got[1] == (1, True) and got[2] == (1, False) and got[3] == (3, True)


def test_lines_sources_and_search(spark, docs, long_text):
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, least_docs=2).collect()}
    n = len(long_text.split("\n"))
    assert lines[1] == (n, n - 1) and lines[2] == (n, 0)  # the last lines differ by a word
    found = divergence.audit_sources(docs, least_docs=2).filter("lang = 'en' AND part = 'pair'").collect()
    assert {(r.source, r["item"]) for r in found} == {("a", "b"), ("b", "a")}
    items = spark.createDataFrame([(7, long_text[:60])], "item_id int, text string")
    best = lexical.ranked_search(docs, items).orderBy("rank").collect()
    assert {r.doc_id for r in best} == {1, 2} and best[0].score >= best[1].score > 0
