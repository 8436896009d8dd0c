"""Cleaned shocks, distinct acts and tallies of consistency on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from factloom.functions.text import normalize_name_for_grouping
from factloom.operators import shaping, tallies


def test_clean_shocks(spark):
    rows = spark.createDataFrame([(" Tax   Reform ", "1981-08", " LONG RUN ", "x"), (None, "soon", None, "y")], "`Act Name` string, `ChangeQuarter` string, `Rule_Exo` string, `act-name` string")
    got = shaping.clean_shocks(rows)
    assert got.columns == ["act_name", "change_quarter", "rule_exo", "act_name_2"]
    assert [tuple(r) for r in got.collect()] == [("Tax Reform", dt.date(1981, 8, 1), "LONGRUN", "x"), (None, None, None, "y")]


def test_kept_acts_by_hand():
    a, b = "one two three four five six seven eight nine ten", "other words"
    assert shaping.kept_acts(["tax act", "tax acts", "roads"], [a, a, a], [1, 2, 1]) == [False, True, True]
    assert shaping.kept_acts(["tax act", "tax acts"], [a, a], [2, 2]) == [True, False]
    assert shaping.kept_acts(["tax act", "tax act", None, "tax act"], [a, b, a, ""], [1, 1, 1, 1]) == [True] * 4


def test_distinct_acts_reads_rows_in_order(spark):
    rows = spark.createDataFrame([(2, "Tax Act", "a b c", 3), (1, "The Tax Act", "A b  c", 3), (3, "Roads", "a b c", 9), (4, None, None, None)], "k int, name string, text string, n int")
    assert sorted(r["k"] for r in shaping.distinct_acts(rows, "k", "name", "text", "n").collect()) == [1, 3, 4]
    assert shaping.distinct_acts(rows.limit(0), "k", "name", "text", "n").count() == 0


def test_distinct_acts_are_those_of_one_pass_over_all(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    base = [rng.sample(words, 20) for _ in range(4)]
    rows = []
    for i in range(120):
        text = list(base[i % 4])
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(20)] = rng.choice(words)
        rows.append((i * 3 % 121, rng.choice(["Tax Act of Spring", "The Tax Acts of Spring", "Roads", "Roads and Rail", None, "The Act"]), " ".join(text) if i % 11 else rng.choice(["", None, " "]), rng.choice([1, 2, 3, None])))
    df = spark.createDataFrame(rows, "k int, name string, text string, n int")
    ordered = sorted(rows)
    plain = {r["k"]: r["p"] for r in df.select("k", normalize_name_for_grouping(df.name).alias("p")).collect()}
    stays = shaping.kept_acts([plain[k] for k, *_ in ordered], [t for _, _, t, _ in ordered], [n or 0 for *_, n in ordered])
    want = [k for (k, *_), s in zip(ordered, stays) if s]
    assert sorted(r["k"] for r in shaping.distinct_acts(df, "k", "name", "text", "n").collect()) == want and len(want) < 100


def test_consistency_tallies(spark):
    members = spark.createDataFrame([("er-2010-BM", "a", 1), ("er-2010-BM", "b", 1), ("er-2010", "c", 1), ("none", "d", 2)], "scope_group string, measure_name string, cluster_id int")
    inventory = spark.createDataFrame([("en", "X", True, 2010), ("en", "X", None, None), ("bm", None, False, 2010)], "side string, pred_label string, pred_exogenous boolean, act_name_year int")
    joint = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "cluster_id int, measure_name string")
    pool = spark.createDataFrame([("a", "bm"), ("b", "bm"), ("c", "en")], "measure_name string, doc_language string")
    got = {k: sorted(map(tuple, v.collect()), key=str) for k, v in tallies.consistency_tallies(members, inventory, joint, pool).items()}
    assert set(got["per_doc"]) == {(2010, "bm", 2, 1, 2.0), (2010, "en", 1, 1, 1.0), (None, "en", 1, 1, 1.0)}
    assert set(got["counts"]) == {("en", 2, 1, 0), ("bm", 1, 0, 1)}
    assert set(got["labels"]) == {("en", "X", 2), ("bm", None, 1)} and set(got["act_years"]) == {("en", 2010, 1), ("bm", 2010, 1)}
    assert got["joint"][0][:2] == (2, 1)


def test_near_word_sets_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.sample([f"w{i}" for i in range(60)], 22) for _ in range(5)]
    sets = {f"s{i}": frozenset(w for w in base[i % 5] if rng.random() > 0.04) | ({"more"} if i % 7 == 0 else set()) for i in range(90)} | {"none": frozenset(), "one": frozenset({"w1"})}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "_id string, _w array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9}
    assert {tuple(r) for r in shaping._near_sets(df, 0.9).collect()} == want and len(want) > 20


def test_copies_of_acts_are_never_joined_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(shaping.fuzzy, "similar_across", None)
    rows = spark.range(30_000).select("id", F.format_string("Supplier#%09d", "id").alias("name"), F.concat(F.lit("act of nation "), (F.col("id") % 5).cast("string")).alias("text"), (F.col("id") % 5).alias("n"))
    got = sorted(r.id for r in shaping.distinct_acts(rows, "id", "name", "text", "n").collect())
    assert 5 <= len(got) < 500
