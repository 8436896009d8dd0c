"""Tallies and comparisons on small fixtures: nulls, ties and empty tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom import plans
from factloom.operators import tallies


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pool_counts_before_distinct_and_drops_null_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1)], "name string, y int")
    assert rows(tallies.name_pool(df, "name", "y")) == [("a", 1, 3), ("a", 2, 3)]


def test_marginals_leave_null_verdicts_out(spark):
    df = spark.createDataFrame([("x", True), ("x", None), ("y", False)], "label string, e boolean")
    assert rows(tallies.marginals(df, "e", "label")) == [("x", 2, 1, 0), ("y", 1, 0, 1)]


def test_act_inputs_take_the_year_in_the_name_first(spark):
    df = spark.createDataFrame([(1, "Act of 1964", 1970), (2, "Act", 1971), (2, "Act", 1969)], "c int, n string, y int")
    assert rows(tallies.act_inputs(df, "c", "n", "y").select("act_name", "year")) == [("Act [c2]", 1969), ("Act of 1964 [c1]", 1964)]


def test_numbers_of_clusters_are_no_years(spark, tmp_path):
    orders = [(k, 1899 + k % 4 + 100 * (k % 2), f"{1992 + k % 5}-03-01") for k in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = plans.queries()["act_inputs"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.oracle_sql()['act_inputs']})").fetchall()
    assert rows(got) == sorted(want) and len(want) == 4


@pytest.mark.parametrize("a, f, verdict", [(1.0, 2 / 3, "fail (overfit)"), (0.7, 0.7, "structural_issue"), (0.9, 0.85, "pass"), (0.75, 0.85, "marginal")])
def test_stability_verdicts(spark, a, f, verdict):
    runs = [(g, "act", "x", "x" if i < share * 60 - 1e-9 else "y") for g, share in (("A", a), ("F", f)) for i in range(60)]
    got = tallies.shuffle_stability(spark.createDataFrame(runs, "g string, act string, b string, s string"), "g", "act", "b", "s", "A")
    assert got.filter("g = 'F'").first()["verdict"] == verdict


def test_stability_without_the_reference_group_is_incomplete(spark):
    df = spark.createDataFrame([("F", "a", "x", "x")], "g string, act string, b string, s string")
    assert tallies.shuffle_stability(df, "g", "act", "b", "s", "A").first()["verdict"] == "incomplete"


def test_equal_partitions_agree_fully(spark):
    df = spark.createDataFrame([(v, k, k % 2) for v in "ab" for k in range(6)] + [("c", k, 1) for k in range(6)], "v string, k int, c int")
    got = tallies.order_agreement(df, "v", "k", "c").first()
    assert got["n_pairs"] == 3 and got["max_ari"] == 1.0 and got["min_ari"] == pytest.approx(0.0)


def test_tradeoff_counts_both_ends(spark):
    df = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 2, None), (4, 5, True)], "k int, n int, m boolean")
    assert rows(tallies.frequency_tradeoff(df, "k", "n", "m")) == [(1, 2, 2, 1), (2, 1, 1, 1), (5, 1, 0, 2)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "v string, k int, c int")
    assert tallies.order_agreement(df, "v", "k", "c").first()["n_pairs"] == 0
    assert tallies.cluster_summary(df, "c", "v").first()["n_clusters"] == 0
