"""Extractions against known acts, left-out predictions, measures of acts, reduced vectors and blocks of terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation, matching, projection


def test_extracted_acts_are_matched_by_name(spark):
    known = spark.createDataFrame([("Tax Reform Act of 1986",), ("Revenue Act of 1948",), ("Lost Act",), (None,)], "act_name string")
    found = spark.createDataFrame([("TAX REFORM ACT, of 1986",), ("Tax Reform Acts of 1986",), ("Revenue  Act of 1948",), ("Invented",)], "act_name string")
    extracted, real = evaluation.matched_extraction(found, known, "act_name")
    assert {r.act_name: r.found for r in extracted.collect()} == {"TAX REFORM ACT, of 1986": True, "Tax Reform Acts of 1986": True, "Revenue  Act of 1948": True, "Invented": False}
    assert {r.act_name: r.found for r in real.collect()} == {"Tax Reform Act of 1986": True, "Revenue Act of 1948": True, "Lost Act": False, None: False}
    got = evaluation.extraction_metrics(extracted, real).first().asDict()
    assert got == {"true_positives": 3, "false_positives": 1, "n_extracted": 4, "false_negatives": 2, "n_known": 4, "precision": 0.75, "recall": 0.6, "f1_score": pytest.approx(2 / 3)}
    none = evaluation.extraction_metrics(*evaluation.matched_extraction(found.limit(0), known.limit(0), "act_name")).first()
    assert none.precision is None and none.n_known == 0


LEVELS = ["A", "B", "C"]


def test_left_out_predictions(spark):
    rows = [(1, "A", "A", True, True), (2, "A", "B", True, False), (3, "B", "B", False, False), (4, "B", "B", False, True), (5, None, "C", None, True), (6, "C", "A", None, True)]
    df = spark.createDataFrame(rows, "k int, p string, y string, e boolean, t boolean")
    got = {r.metric: r for r in evaluation.left_out_evaluation(df, "k", "p", "y", "e", "t", LEVELS, replicates=300).collect()}
    values = {m: r.value for m, r in got.items()}
    # C is never right, so it has no F1; A has 2/4, B 4/5
    assert values == {"accuracy": 0.6, "exogenous_accuracy": 0.5, "exogenous_precision": 0.5, "exogenous_recall": 0.5, "macro_f1": pytest.approx((0.5 + 0.8) / 2)}
    assert all(r.low <= r.value <= r.high and r.low < r.high for r in got.values())


def test_intervals_of_chunks_and_what_counts(spark):
    rows = [(i, "P" if i % 3 else "N", "P" if i % 4 else "N", i % 3, None if i % 2 else 1 + i % 4) for i in range(200)] + [(900, None, "P", 1, 1)]
    df = spark.createDataFrame(rows, "k int, p string, y string, tier int, measure_rank int")
    counts = [(p, y, t) for _, p, y, t, r in rows if (r is None or r == 1) and p is not None]
    got = {r.metric: r for r in evaluation.chunk_intervals(df, "p", "y", "P", "k", replicates=200).collect()}
    tp = sum(p == y == "P" for p, y, _ in counts)
    assert got["recall"].value == pytest.approx(tp / sum(y == "P" for _, y, _ in counts)) and got["tier1_recall"].value == pytest.approx(np.mean([p == "P" for p, _, t in counts if t == 1]))
    assert got["specificity"].value == pytest.approx(sum(p == y == "N" for p, y, _ in counts) / sum(y == "N" for _, y, _ in counts))
    assert evaluation.chunk_errors(df, "p", "y").count() == sum(p != y for p, y, _ in counts)
    assert all(r.low <= r.value <= r.high for r in got.values())


def test_an_act_is_named_by_any_measure_of_its_chunk(spark):
    rows = [("Tax Reform Act of 1986", 1, 1, "tax reform act"), ("Tax Reform Act of 1986", 1, 2, None), ("Tax Reform Act of 1986", 2, 1, "another"), ("Tax Reform Act of 1986", 3, 1, None), ("ERTA", 4, 1, "the ERTA of 1981"), ("ERTA", 5, 1, "")]
    df = spark.createDataFrame([(a, c, r, m, "P", 1) for a, c, r, m in rows] + [("ERTA", 9, 1, None, "P", 2), ("ERTA", 8, 1, None, "N", 1)], "act string, chunk int, measure_rank int, measure string, y string, tier int")
    got = {r.act: (r.n_chunks, r.n_recalled, round(r.recall, 6)) for r in evaluation.measured_act_recall(df, "y", "P", "act", ["chunk"], "measure").collect()}
    assert got == {"Tax Reform Act of 1986": (3, 1, 0.333333), "ERTA": (2, 2, 1.0)}


def test_terms_in_blocks_are_those_of_one_automaton(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 40}" for j in range(6))) for i in range(30)] + [(99, None)], "k int, t string")
    terms = spark.createDataFrame([(f"w{i}",) for i in range(40)] + [("",), (None,), ("w1 w2",)], "term string")
    whole = {tuple(r) for r in matching.holding(texts, "t", terms, "term").collect()}
    assert {tuple(r) for r in matching.holding(texts, "t", terms, "term", most=7).collect()} == whole
    assert whole == {(i, t, w.term) for i, t in texts.collect() if t for w in terms.collect() if w.term and w.term in t}


def test_principal_axes_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ rng.normal(size=(5, 5)) + 7
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0])], "k int, v array<double>").repartition(5)
    whole = df.filter("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    mean, axes, spread = projection.principal_axes(whole, "v", 2)
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(spread, want[1] ** 2 / 299) and np.allclose(np.abs(axes.T @ want[2][:2].T), np.eye(2), atol=1e-6)
    got = {r.k: r.v for r in projection.reduced(df, "v", 2, normalise=False).collect()}
    assert len(got) == 300 and np.allclose([got[i] for i in range(300)], (x - mean) @ axes)
    again = projection.principal_axes(whole, "v", 2)[1]
    assert (again == axes).all()
    with pytest.raises(ValueError, match="one length"):
        projection.principal_axes(df.select(F.when(F.col("k") > 5, F.col("v")).otherwise(F.array(F.lit(1.0))).alias("v")), "v", 1)


def test_reduced_groups_stay_apart(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:3] * 4
    rows = [(i, (centres[i % 3] + rng.normal(0, 0.1, 8)).tolist(), 1990) for i in range(60)]
    got = projection.reduced_grid(spark.createDataFrame(rows, "k long, v array<double>, y int"), "k", "v", [2, 3], [5], [None, 1], "y").collect()
    assert len(got) == 60 * 4 and {(r.dimensions, r.year_window) for r in got} == {(2, None), (2, 1), (3, None), (3, 1)}
    for d in (2, 3):
        groups = [{r.cluster_id for r in got if r.dimensions == d and r.year_window is None and r.k % 3 == g and r.cluster_id > 0} for g in range(3)]
        assert all(len(g) >= 1 for g in groups) and not groups[0] & groups[1] and not groups[1] & groups[2]


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<double>")
    assert len(projection.reduced(df, "v", 1).collect()) == 1
    assert projection.reduced(df.filter("k > 9"), "v", 1).collect() == []
