"""Folds, series, density clusters and streams on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom import plans
from factloom.operators import density, proxies, vectors
from factloom.streaming import windows as streams


def test_two_dense_groups_and_noise():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (15, 2)), [[50.0, -40.0], [-60.0, 70.0]]])
    d = np.linalg.norm(points[:, None] - points[None, :], axis=2)
    got = density.density_labels(d, 5)
    assert set(got[:20]) == {1} and set(got[20:35]) == {2} and sorted(got[35:]) == [-2, -1]


def test_equal_points_and_tiny_pools():
    assert list(density.density_labels(np.zeros((1, 1)), 2)) == [1]
    assert list(density.density_labels(np.zeros((0, 0)), 2)) == []
    assert len(density.density_labels(np.zeros((4, 4)), 2)) == 4


def test_years_out_of_the_window_part_clusters(spark):
    rows = [(i, [1.0, 0.001 * i], 1990) for i in range(6)] + [(10 + i, [1.0, 0.001 * i], 2010) for i in range(6)] + [(99, None, 1990)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    got = density.density_grid(df, "k", "v", [3], [2], "y").collect()
    ids = {r.k: r.cluster_id for r in got}
    assert 99 not in ids and len({ids[i] for i in range(6) if ids[i] > 0} & {ids[10 + i] for i in range(6) if ids[10 + i] > 0}) == 0


def plain_labels(rows, least, window, beyond=None):
    """Labels by one whole matrix of distances."""
    x = np.array([v for _, v, _ in rows])
    if beyond is None:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        d = np.maximum(1 - x @ x.T, 0.0)
    else:
        d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    if window is not None:
        y = np.array([t for _, _, t in rows], dtype=float)
        d[~(np.abs(y[:, None] - y[None, :]) <= window)] = 1.0 if beyond is None else np.linalg.norm(x[:, None] - x[None, :], axis=2).max() + 1
    d = np.round(d, 12)
    np.fill_diagonal(d, 0.0)
    return {k: int(c) for (k, _, _), c in zip(rows, density.density_labels(d, least))}


@pytest.mark.parametrize("measure", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [1000, 25, 9])
def test_blocks_and_rounds_give_the_labels_of_the_whole_matrix(spark, measure, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (4, 6))
    rows = [(3 * i, (centres[i % 4] + rng.normal(0, 0.15, 6)).tolist(), 1990 + i % 7 if i % 11 else None) for i in range(70)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(8)]  # equal points
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    got = density.density_grid(df, "k", "v", [2, 4], [None, 2], "y", measure, block, per_group=100).collect()
    rows = [(k, v, np.nan if t is None else t) for k, v, t in sorted(rows, key=lambda r: r[0])]
    for s in (2, 4):
        for w in (None, 2):
            mine = {r.k: r.cluster_id for r in got if r.min_cluster_size == s and r.year_window == w}
            assert mine == plain_labels(rows, s, w, None if measure == "cosine" else 1), (s, w)


def test_one_point_and_none(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0])], "k long, v array<double>")
    assert [tuple(r) for r in density.density_grid(df, "k", "v", [2], [None]).collect()] == [(5, 2, None, 1)]
    assert density.density_grid(df.filter("k < 0"), "k", "v", [2], [None]).collect() == []


def test_equal_distances_are_one_merge():
    # three points that meet each other and a group at one distance are no pair and a point
    edges = [(0.1, 0, 1), (0.1, 1, 2), (1.0, 2, 3), (1.0, 3, 4), (1.0, 4, 5)]
    labels = density.labels_of_edges(edges, 6, 2)
    for order in ([0, 1, 4, 3, 2], [1, 0, 2, 4, 3]):
        assert list(density.labels_of_edges(sorted((edges[i] for i in order), key=lambda e: e[0]), 6, 2)) == list(labels)
    assert sorted(labels[3:]) == [-3, -2, -1] or (labels[3:] < 0).all()


def test_midpoint_rule(spark):
    df = spark.createDataFrame([("1990-11-15",), ("1990-11-16",), ("1990-01-01",), (None,)], "d string").select(F.to_date("d").alias("d"))
    q = proxies.midpoint_quarter(F.col("d"))
    assert [r[0] for r in df.select(proxies.quarter_label(q)).collect()] == ["1990-Q4", "1991-Q1", "1990-Q1", None]


def test_calendar_is_dense_and_signed(spark):
    df = spark.createDataFrame([(10, 1), (10, 1), (12, -1), (12, 1), (13, None), (None, 1)], "q int, s int")
    assert sorted(tuple(r) for r in proxies.signed_proxy(df, "q", "s").select("q", "z", "n_acts").collect()) == [(10, 1, 2), (11, 0, 0), (12, 0, 2)]
    assert proxies.signed_proxy(df.limit(0), "q", "s").count() == 0


def test_folds_never_show_their_own_act(spark):
    pos = spark.createDataFrame([(a, 10 * i + j) for i, a in enumerate("abc") for j in range(3)], "act string, k long")
    neg = spark.createDataFrame([("n", 100 + i) for i in range(50)], "act string, k long")
    got = proxies.left_out_folds(pos, neg, "act", "k", n_negatives=4, n_shots=5).collect()
    for fold in "abc":
        mine = [r for r in got if r.fold == fold]
        assert sorted(r.role for r in mine) == ["negative"] * 4 + ["shot"] * 2 + ["test"] * 3
        assert all(r.act == fold for r in mine if r.role == "test") and all(r.act != fold for r in mine if r.role == "shot")
    negatives = [r.k for r in got if r.role == "negative"]
    assert len(negatives) == len(set(negatives))


def test_stream_of_documents_gives_the_windows_of_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "\n".join(f"page {i} {j} " + "x" * 60 for j in range(i))) for i in range(1, 9)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.arriving_windows(streams.read_folder(spark, str(tmp_path / "in"), docs.schema, 1), "doc_id", "text", size=3, overlap=1)
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    want = streams.arriving_windows(docs, "doc_id", "text", size=3, overlap=1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_all_orders_enter_the_signed_series(spark):
    sf = "/root/testdata/sf0.001"
    n = plans.queries()["signed_proxy"](spark, sf).agg(F.sum("n_acts")).first()[0]
    assert n == spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderdate IS NOT NULL").count()


def test_points_are_sent_once_for_each_lot(spark, monkeypatch):
    """However many blocks there are, a point goes to as many tasks as there are lots; several blocks of one lot meet too."""
    assert [vectors.lots_for(n, 1000) for n in (0, 900, 10_256, 51_282, 500_000, 615_000, 2_000_000)] == [1, 1, 11, 16, 16, 19, 62]
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 4).tolist(), 1990.0 + i % 5) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y double")
    monkeypatch.setattr(vectors, "LOTS", 2)
    monkeypatch.setattr(density, "HELD", 50)
    assert vectors.lots_for(90, 7) == 2
    for measure in ("cosine", "euclidean"):
        got = density.density_grid(df, "k", "v", [3], [2], "y", measure, 7).collect()
        assert {r.k: r.cluster_id for r in got} == plain_labels(rows, 3, 2, None if measure == "cosine" else 1)


def test_tree_grows_from_near_ones_and_open_parts_are_looked_for(spark, monkeypatch):
    """Tight groups larger than the kept lists have no listed way out; copies are one point of the search and keep their labels."""
    # the edge at 2.0 is not certain while pairs from 1.0 on may be missing on both its sides
    rows = [(0.5, 1, 2, 0), (0.5, 3, 4, 0), (2.0, 2, 3, 0)] + [(1.0, k, k, 0) for k in (1, 2, 3, 4)]
    got = density._grown(pd.DataFrame(rows, columns=["d", "u", "v", "sure"]).assign(s=2, w=-1), False)
    assert sorted(got[got["sure"] == 1]["d"]) == [0.5, 0.5] and set(got[got["sure"] == 2]["v"]) == {1, 3}
    closed = pd.DataFrame([r if r[1] != r[2] or r[1] > 2 else (2.0, *r[1:]) for r in rows], columns=["d", "u", "v", "sure"]).assign(s=2, w=-1)
    assert sorted(density._grown(closed, False)["d"]) == [0.5, 0.5, 2.0]

    rng = np.random.default_rng(12)
    centres = rng.normal(0, 1, (6, 20))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.02 + 0.01 * (i % 6), 20)).tolist(), 1990.0 + i % 6) for i in range(150)]
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(40)] + [(2000 + i, rows[i][1], None) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y double")
    monkeypatch.setattr(density, "SOUGHT", 40)
    full = [(k, v, np.nan if t is None else t) for k, v, t in rows]
    for measure in ("cosine", "euclidean"):
        got = density.density_grid(df, "k", "v", [2, 5], [None, 1], "y", measure, 16).collect()
        for s in (2, 5):
            for w in (None, 1):
                assert {r.k: r.cluster_id for r in got if r.min_cluster_size == s and r.year_window == w} == plain_labels(full, s, w, None if measure == "cosine" else 1), (measure, s, w)
