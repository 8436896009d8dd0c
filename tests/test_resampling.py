"""Intervals, probes and scoped clusters on small tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import evaluation, fuzzy, neighbours, resampling, vectors


def test_drawn_takes_as_many_rows_as_there_are(spark):
    rows = spark.createDataFrame([("x", i) for i in range(7)] + [("y", i) for i in range(3)], "g string, k int")
    sums = resampling.drawn(rows, "k", 50, 3, "g").groupBy("g", "_rep").agg(F.sum("_w").alias("n")).collect()
    assert len(sums) == 100 and all(r["n"] == {"x": 7, "y": 3}[r["g"]] for r in sums)
    assert resampling.drawn(rows.limit(0), "k", 50, 3).count() == 0


def test_draws_are_numbered_in_runs(spark, monkeypatch):
    rows = spark.range(10).select("id")
    whole = sorted(map(tuple, resampling.drawn(rows, "id", 20, 3).select("_rep", "id", "_w").collect()))
    monkeypatch.setattr(resampling, "RUN", 3)
    assert sorted(map(tuple, resampling.drawn(rows, "id", 20, 3).select("_rep", "id", "_w").collect())) == whole
    plan = resampling.drawn(rows, "id", 20, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1, _n" not in plan


def test_rate_intervals_hold_the_binomial_width(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("double").alias("hit"))
    got = resampling.rate_intervals(rows, "id", {"rate": (F.col("hit"), F.lit(1.0)), "none": (F.col("hit"), F.lit(0.0))}, replicates=600)
    found = {r["metric"]: r for r in got.collect()}
    r, half = found["rate"], 1.96 * math.sqrt(0.25 * 0.75 / 400)
    assert r["value"] == 0.25 and abs(r["low"] - (0.25 - half)) < 0.012 and abs(r["high"] - (0.25 + half)) < 0.012
    assert found["none"]["value"] is None and found["none"]["low"] is None


def test_weights_are_poisson_and_summed_in_tasks(spark):
    w = resampling.weights(np.arange(4000, dtype=np.int64) * 7919, 300)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - math.exp(-1)) < 0.003
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i % 5), None if i % 3 else 1.0) for i in range(700)] + [(999, None, 1.0, 1.0)], "k int, g string, x double, y double").repartition(5)
    got = {(r.g, r["_rep"]): (r.x, r.y) for r in resampling.weighted_sums(rows, "k", ["x", "y"], [False, True], 40, 3, "g").collect()}
    hashes = {r.k: r.h for r in rows.select("k", F.xxhash64(F.lit(3), "k").alias("h")).collect()}
    data = [r for r in rows.collect() if r.g]
    own = resampling.weights(np.array([hashes[r.k] for r in data]), 40)
    for rep in (1, 17, 40):
        for g in "ab":
            x = sum(float(own[i, rep - 1]) * r.x for i, r in enumerate(data) if r.g == g)
            y = sum(float(own[i, rep - 1] > 0) for i, r in enumerate(data) if r.g == g and r.y)
            assert got[g, rep] == (x, y)
    assert len(got) == 80
    plan = resampling.rate_intervals(rows, "k", {"m": (F.col("x"), F.lit(1.0))})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate explode(sequence" not in plan


def test_mean_interval(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(900, None)], "k int, v int")
    got = resampling.mean_interval(rows, "k", "v", 500).first()
    assert got.estimate == 0.5 and abs(got.low - (0.5 - 1.96 * 0.025)) < 0.012 and abs(got.high - (0.5 + 1.96 * 0.025)) < 0.012


def test_gate_intervals_enclose_their_points(spark):
    matches = spark.createDataFrame([("v", 1, 1, True, True, True), ("v", 2, 1, True, True, False), ("v", 2, 2, True, False, True), ("v", 3, 3, False, True, True)], "v string, c int, a int, p boolean, np boolean, y boolean")
    clusters = spark.createDataFrame([("v", c) for c in range(1, 6)], "v string, c int")
    acts = spark.createDataFrame([(a,) for a in range(1, 5)], "a int")
    got = {r["metric"]: r for r in resampling.gate_intervals(matches, clusters, acts, "v", "c", "a", "p", "np", "y", replicates=300).collect()}
    assert {m: round(r["value"], 9) for m, r in got.items()} == {"coverage": 0.5, "fragmentation": 1.5, "year_alignment": round(2 / 3, 9), "spurious_rate": 0.6}
    assert all(r["low"] <= r["value"] <= r["high"] for r in got.values())
    assert got["fragmentation"]["low"] == 1.0 and got["fragmentation"]["high"] == 2.0


def test_cluster_intervals_settle_ambiguous_names_anew(spark):
    gold = spark.createDataFrame([(1, "a", "X"), (2, "a", "X"), (3, "a", "Y"), (4, "b", "X"), (5, "c", "Y"), (6, "d", "Y")], "k int, name string, act string")
    predicted = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "name string, cluster int")
    got = {r["metric"]: r for r in resampling.cluster_intervals(predicted, gold, "name", "cluster", "act", "k", replicates=200).collect()}
    assert got["f1"]["value"] == 1.0 and got["purity"]["value"] == 1.0
    assert got["purity"]["low"] < 1.0 == got["purity"]["high"]


def test_probe_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"l{i % 5}" if i else "alone", [float(v) for v in rng.normal(size=6) + 2 * (i % 5)]) for i in range(90)] + [(90, None, [1.0] * 6), (91, "l1", None), (92, "l2", [None] + [1.0] * 5)]
    df = spark.createDataFrame(rows, "k int, label string, v array<double>")
    x, labels = np.array([r[2] for r in rows[:90]]), np.array([r[1] for r in rows[:90]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    for measure, d, name in (("cosine", -(unit @ unit.T), "cosine"), ("euclidean", far, "distance")):
        for block in (7, 2000):
            got = neighbours.neighbour_probe(df, "k", "label", "v", measure, block).first()
            own = d.copy()
            np.fill_diagonal(own, np.inf)
            near = labels[own.argmin(axis=1)]
            up = np.triu_indices(90, 1)
            alike = labels[up[0]] == labels[up[1]]
            w, b = (abs(np.median(d[up][alike == s])) if name == "distance" else -np.median(d[up][alike == s]) for s in (True, False))
            assert abs(got["top1_nn_same_act_rate"] - (near == labels)[labels != "alone"].mean()) < 1e-9
            assert abs(got[f"median_within_act_{name}"] - w) < 1e-9 and abs(got[f"median_between_act_{name}"] - b) < 1e-9
            assert got["separation"] > 0 and got["n_eval_names"] == 90 and got["n_eval_acts"] == 6
    none = neighbours.neighbour_probe(df.limit(0), "k", "label", "v").first()
    assert none["top1_nn_same_act_rate"] is None and none["separation"] is None and none["n_eval_acts"] == 0


def test_scoped_clusters_stay_in_their_group(spark):
    rows = [("d1", "tax reform act"), ("d1", "tax reform acts"), ("d2", "tax reform act"), ("d2", "highways"), (None, "x"), ("d2", None), ("d1", "tax reform act")]
    pool = spark.createDataFrame(rows, "doc string, name string")
    by_doc = {(r["scope_group"], r["measure_name"]): (r["cluster_id"], r["n_members"]) for r in fuzzy.scoped_clusters(pool, "doc").collect()}
    assert by_doc == {("d1", "tax reform act"): (1, 2), ("d1", "tax reform acts"): (1, 2), ("d2", "highways"): (1, 1), ("d2", "tax reform act"): (2, 1)}
    joint = fuzzy.scoped_clusters(pool.filter("doc IS NOT NULL"), None).collect()
    assert {r["scope_group"] for r in joint} == {"joint"} and len({r["cluster_id"] for r in joint}) == 2


def test_counts_of_draws_have_the_law_of_drawing_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "abc"[min(i % 6, 2)], None if i % 5 == 0 else i % 5) for i in range(600)], "k int, x string, y int")
    sizes = {(r.x, r.y): r["count"] for r in rows.groupBy("x", "y").count().collect()}
    for most in (4096, 4):  # one bucket and several
        monkeypatch.setattr(resampling, "CELLS", most)
        got = resampling.drawn_counts(rows, ["x", "y"], 400, 3)
        found = {(r.x, r.y, r["_rep"]): r["_w"] for r in got.collect()}
        for rep in range(1, 401):
            assert sum(n for (*_, r), n in found.items() if r == rep) == 600
        for cell, n in sizes.items():
            w = np.array([found.get((*cell, rep), 0) for rep in range(1, 401)])
            assert abs(w.mean() - n) < 4 * math.sqrt(n / 400) and abs(w.var() / (n * (1 - n / 600)) - 1) < 0.35
        assert found == {(r.x, r.y, r["_rep"]): r["_w"] for r in resampling.drawn_counts(rows.repartition(7), ["x", "y"], 400, 3).collect()}
    assert resampling.drawn_counts(rows.limit(0), ["x", "y"], 5, 3).count() == 0


def test_no_draw_is_made_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(resampling, "drawn", None)
    rows = spark.range(3_000_000).select("id", F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("p"), F.when(F.col("id") % 4 == 0, "A").otherwise("B").alias("y"), (F.col("id") % 2 == 0).alias("e"))
    plan = evaluation.left_out_evaluation(rows, "id", "p", "y", "e", "e", ["A", "B"], replicates=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan


def test_names_of_one_lot_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, f"l{i % 4}", [float(v) for v in rng.normal(size=20) + i % 4]) for i in range(80)], "k int, label string, v array<double>")
    for measure in ("cosine", "euclidean"):
        monkeypatch.setattr(vectors, "LOTS", 16)
        whole = neighbours.neighbour_probe(df, "k", "label", "v", measure, 1000).first()
        monkeypatch.setattr(vectors, "LOTS", 2)
        lots = neighbours.neighbour_probe(df, "k", "label", "v", measure, 7).first()
        assert vectors.lots_for(80, 7) == 2 and all(abs(x - y) < 1e-11 for x, y in zip(whole, lots))


def test_a_distance_is_the_same_in_any_block():
    rng = np.random.default_rng(1)
    for dim in (2, 16, 17, 64):
        x, y = rng.normal(size=(30, dim)), rng.normal(size=(41, dim))
        whole = vectors.euclidean(x, y)
        assert np.allclose(whole, np.linalg.norm(x[:, None] - y[None], axis=2), rtol=1e-13)
        assert (whole[3:9, 5:12] == vectors.euclidean(x[3:9], y[5:12])).all() and (whole == vectors.euclidean(y, x).T).all()


def test_medians_are_found_wherever_a_few_names_point(spark, monkeypatch):
    """The first names' pairs only tell where to look: medians out of that range are looked for there, and no number that is none makes it endless."""
    rng = np.random.default_rng(14)
    rows = [(i, f"l{i % 3}", [float(v) for v in rng.normal(size=20) + (i % 3) * (i % 2)]) for i in range(120)] + [(200 + i, "l1", [1.0] * 20) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, label string, v array<double>")
    want = {measure: neighbours.neighbour_probe(df, "k", "label", "v", measure, 1000).first() for measure in ("cosine", "euclidean")}
    monkeypatch.setattr(neighbours, "TRIED", 60)
    monkeypatch.setattr(neighbours, "BINS", 8)
    for measure in want:
        assert all(abs(x - y) < 1e-11 for x, y in zip(want[measure], neighbours.neighbour_probe(df, "k", "label", "v", measure, 16).first()))
    x, labels = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    up = np.triu_indices(len(x), 1)
    far, same = np.linalg.norm(x[up[0]] - x[up[1]], axis=1), labels[up[0]] == labels[up[1]]
    assert abs(want["euclidean"]["median_within_act_distance"] - np.median(far[same])) < 1e-9 and abs(want["euclidean"]["median_between_act_distance"] - np.median(far[~same])) < 1e-9
