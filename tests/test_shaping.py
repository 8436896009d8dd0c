"""Merged rows, passages without near copies, evaluations with nulls."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation, metrics, shaping


def slow(passages, threshold):
    """The sequential rule, every pair compared."""
    parts = [q.strip() for p in passages for q in p.split("\n\n---\n\n")]
    parts = [p for p in parts if len(p) > 50]
    if not parts:
        return "\n\n".join(passages)
    keep = [True] * len(parts)
    for i, j in itertools.product(range(len(parts)), repeat=2):
        if j < i and keep[j]:
            a, b = set(parts[i].lower().split()), set(parts[j].lower().split())
            if len(a & b) / len(a | b) >= threshold:
                keep[i if len(parts[i]) <= len(parts[j]) else j] = False
    return "\n\n---\n\n".join(p for p, k in zip(parts, keep) if k)


@pytest.mark.parametrize("seed", range(6))
def test_passages_without_near_copies(seed):
    rng = random.Random(seed)
    base = [f"word{i}" for i in range(14)]
    texts = [" ".join(rng.sample(base, rng.randint(9, 14))) + rng.choice(["", " Tail", "\n\n---\n\n" + " ".join(base)]) for _ in range(25)] + ["short"]
    assert shaping.distinct_passages(texts, 0.8) == slow(texts, 0.8)


def test_passages_of_acts(spark):
    long = "one two three four five six seven eight nine ten eleven"
    rows = spark.createDataFrame([("a", 2, long), ("a", 1, long + " twelve"), ("a", 3, None), ("b", 1, "x"), ("b", 2, "y"), (None, 1, "z"), ("c", 1, None)], "act string, at int, text string")
    got = {r["act"]: r["passages_text"] for r in shaping.combined_passages(rows, "act", "text", "at").collect()}
    assert got == {"a": long + " twelve", "b": "x\n\ny", None: "z", "c": ""}
    assert shaping.combined_passages(rows.limit(0), "act", "text", "at").count() == 0


def test_grouped_passages(spark):
    rows = spark.createDataFrame(
        [(1, 1, "d1", [3, 1], "x", 0.5, None), (1, 2, "d2", [1], "y", None, 1.0), (2, 1, "d1", None, None, None, None)],
        "cluster_id int, ord int, doc_id string, page_numbers array<int>, passages_text string, confidence double, agreement_rate double",
    )
    got = {r["cluster_id"]: r for r in shaping.grouped_passages(rows, "cluster_id").collect()}
    assert (got[1]["page_numbers"], got[1]["source_docs"], got[1]["n_chunks"], got[1]["avg_confidence"], got[1]["passages_text"]) == ([1, 3], ["d1", "d2"], 2, 0.5, "x\n\ny")
    assert got[2]["n_chunks"] == 1 and got[2]["avg_confidence"] is None


def test_merged_documents(spark):
    rows = spark.createDataFrame([("d", 2, ["c"], "late"), ("d", 1, ["a", "b"], "first"), ("e", 1, None, "x"), (None, 1, ["n"], "y")], "doc_id string, at int, pages array<string>, body string")
    got = {r["doc_id"]: (r["pages"], r["body"]) for r in shaping.merged_documents(rows, "doc_id", "pages", "at").collect()}
    assert got == {"d": (["a", "b", "c"], "first"), "e": ([], "x"), None: (["n"], "y")}


def test_first_rows_of_null_keys_and_ties(spark):
    rows = spark.createDataFrame([(None, 1, "x"), (None, 1, "a"), ("k", 2, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in shaping.first_rows(rows, ["k"], [F.col("o"), F.col("v")]).collect()} == {(None, "a"), ("k", "z")}


def test_countries_and_manifests(spark):
    a, b = spark.createDataFrame([(1, "old")], "id int, country string"), spark.createDataFrame([(2, 5)], "id int, extra int")
    assert {(r["id"], r["country"], r["extra"]) for r in shaping.bind_countries([("US", a), ("MY", b)]).collect()} == {(1, "US", None), (2, "MY", 5)}
    assert [r["year"] for r in shaping.literal_manifest(spark, [(1990, "a", "u"), (2001, "b", "v")], 1995, 2005).collect()] == [2001]


def test_class_rates_leave_nulls_out(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), (None, "a"), ("b", "a"), ("c", "b")], "p string, y string")
    got = {r["level"]: r for r in metrics.class_metrics(rows, "p", "y", ["a", "b"]).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (1.0, 0.5, 3)
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["f1"], got["b"]["support"]) == (0.0, 0.0, None, 1)
    total = evaluation.multiclass_totals(rows, "p", "y", ["a", "b"]).first()
    assert (total["n"], total["accuracy"], total["macro_f1"]) == (5, 0.2, pytest.approx(2 / 3)) and total["weighted_f1"] == pytest.approx(2 / 3 * 3 / 4)
    empty = evaluation.multiclass_totals(rows.limit(0), "p", "y", ["a"]).first()
    assert (empty["n"], empty["accuracy"], empty["macro_f1"]) == (0, None, None)
