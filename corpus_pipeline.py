"""A corpus pipeline of five stages over ``documents``.

Quality classifier, language identification, near-duplicate removal, mixing of
sources and packing, each over all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, mixing, near_dedup, packing, quality
from factloom.llm.common import fold, keyed_rows, read_table, written
from factloom.llm.queries import WORD_TOKENIZER

#: Below this confidence a language is not accepted.
SURE = 0.5


def _with_input(docs: DataFrame) -> DataFrame:
    """``text`` and the whole row beside it, so that no column of the input clashes with a verdict's."""
    return docs.select(F.col("text"), F.struct(*docs.columns).alias("_row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more).

    All columns stay as they are, whatever their names. Null texts are judged
    as empty ones, repeated rows each; a null id learns in the fold of the empty
    text. Without learning labels every score is 0.5 and nothing is kept; an
    empty table gives no rows.
    """
    labels = read_table(spark, sf_dir, "labels")
    learning = docs.filter(fold("doc_id", 4) != 2)
    model = quality.learn(learning, labels.filter(fold("doc_id", 4) != 2))
    return quality.predict(_with_input(docs), model, 0.7).filter("predicted = 1").select("_row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with some confidence.

    All columns stay as they are, whatever their names. Null texts and texts
    without a letter go; repeated rows are judged each. Without learning rows
    nothing is kept; an empty table gives no rows.
    """
    model = langid.learn(docs.filter(fold("doc_id", 4) != 2))
    guessed = langid.predict(_with_input(docs), model)
    return guessed.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select("_row.*")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8), that of the smallest id.

    Rows that repeat an id are judged each by its text; of equal ones one stays, the first
    by id and key. Rows of a null id stand alone and stay, as do empty and null texts. All
    columns stay as they are; an empty table gives no rows.
    """
    keyed = keyed_rows(docs)
    named = keyed.filter("doc_id IS NOT NULL")
    judged = near_dedup.near_duplicates(named, words=5, percent=80, doc_id="_key").select(F.col("doc_id").alias("_key"), "component_id")
    ids = judged.join(named.select("_key", "doc_id"), "_key")
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("_first")).select(F.col("_first._key").alias("_key"))
    return named.join(kept, "_key", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, none above three times its size; a row for each document and pass.

    ``n_chars``, if there, becomes the length of the text that is left. Null sources are a
    source of their own; rows of null and repeated ids are documents each; documents without
    words go, since they take no part in a mix of words. An empty table gives no rows.
    """
    mixed = mixing.mix_documents(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: the pieces of documents with their ids and places.

    Null texts are the end id alone; repeated rows are packed as often as they occur; other
    columns are not carried; an empty table gives no rows.
    """
    return packing.pack_documents(docs, WORD_TOKENIZER, capacity=4096, end_id=1)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_dedup", keep_first),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can express neither the classifiers nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
