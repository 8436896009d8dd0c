"""Training sets, examples, contexts, ladders, numbers of rows and joins many to one."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import ladders, numbering, shaping, training


def order(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key


def test_numbers_follow_the_seeded_order(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(500)] + [(900, None)], "k int, g string")
    got = {r.k: r["_k"] for r in numbering.numbered(rows, 5, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted([*range(500), 900], key=lambda k: order(5, k)))}
    by = {(r.g, r.k): r.n for r in numbering.numbered(rows, 5, "k", "g", name="n").collect()}
    assert by == {(g, k): i for g in "ab" for i, k in enumerate(sorted((k for k in range(500) if ("a" if k % 3 else "b") == g), key=lambda k: order(5, k)))}


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(f"n{i * 7 % 100:03d}", i % 3) for i in range(100)], "a string, b int").repartition(7)
    got = {r.a: r["_k"] for r in numbering.in_order(rows, "b", "a").collect()}
    assert got == {a: i for i, (b, a) in enumerate(sorted((r.b, r.a) for r in rows.collect()))}
    assert numbering.in_order(rows.limit(0), "a").collect() == []


def test_negatives_take_the_positives_shares(spark):
    yes = spark.createDataFrame([("t", "A", s, 1990, "m") for s in ["train"] * 5 + ["val"] * 2 + ["test"]], "passages_text string, act_name string, split string, year int, motivation_category string")
    no = spark.createDataFrame([(i, f"n{i}", 1950, "s", "b") for i in range(21)], "k int, text string, year int, source string, body string")
    got = training.detection_set(yes, no, "k").filter("is_fiscal_act = 0").collect()
    counts = {s: sum(r.split == s for r in got) for s in ("train", "val", "test")}
    assert counts == {"train": round(21 * 5 / 8), "val": round(21 * 2 / 8), "test": 21 - round(21 * 5 / 8) - round(21 * 2 / 8)}
    assert all(r.act_name is None and r.source == "s" for r in got)
    assert {r.split for r in training.detection_set(yes.limit(0), no, "k").collect()} == {"test"}


def test_magnitudes_need_a_known_quarter_and_amount(spark):
    q = "array<struct<quarter:string,amount:double>>"
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([None, [], [("Q", None)], [("Q", None), (None, 1.0)], [("Q", 2.0)]])], f"i int, ground_truth_quarters {q}")
    full = rows.select(F.col("i").cast("string").alias("act_name"), F.lit("p").alias("passages_text"), F.lit(1).alias("year"), F.lit(None).cast("date").alias("date_signed"), "ground_truth_quarters", F.lit("train").alias("split"))
    assert sorted(r.act_name for r in training.magnitude_set(full).collect()) == ["3", "4"]


def test_edge_cases_come_first(spark):
    rows = [(i, f"They {'propose' if i in (3, 8) else 'should' if i == 5 else 'say'} {i}", int(i > 20), f"Act {i}", "train" if i != 8 else "test") for i in range(40)]
    got = training.detection_examples(spark.createDataFrame(rows, "k int, text string, is_fiscal_act int, act_name string, split string"), "k", 4, 6).collect()
    kinds = {kind: [r.k for r in got if r.kind == kind] for kind in ("positive", "edge", "plain")}
    assert sorted(kinds["edge"]) == [3, 5] and len(kinds["plain"]) == 2 and not set(kinds["plain"]) & {3, 5, 8}
    assert sorted(kinds["positive"]) == sorted(sorted(range(21, 40), key=lambda k: order(20251206, k))[:4])
    out = {r.k: json.loads(r.output) for r in got}
    assert out[3]["contains_act"] is False and out[3]["act_name"] is None and out[kinds["positive"][0]]["act_name"] == f"Act {kinds['positive'][0]}"


def test_required_acts_and_full_classes(spark):
    rows = [(i, f"Act {i}", "x" * 400, 1990 + i % 3, "AB"[i % 2], True, "train" if i < 14 else "test") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, act_name string, passages_text string, year int, motivation string, exogenous boolean, split string")
    slump = spark.createDataFrame([(1991, "bust")], "year int, context string")
    got = training.motivation_examples(df, "k", 3, ["Act 17", "none of these", "Act 2"], slump, {"Act 17": "Because.", "Act": "Any."}).collect()
    assert {r.k: r.required for r in got if r.required} == {17: 1, 2: 3}
    assert {m: sum(r.motivation == m for r in got) for m in "AB"} == {"A": 3, "B": 3}
    by = {r.k: json.loads(r.output) for r in got}
    assert by[17]["reasoning"] == "Because." and by[2]["reasoning"] == "Any." and all("Because" not in by[k]["reasoning"] and by[k]["reasoning"] != "Any." for k in by if k not in (2, 17))
    assert len(by[2]["evidence"][0]["passage_excerpt"]) == 150
    context = {r.k: "RECESSION YEAR: bust" in r.input for r in got}
    assert all(context[k] == ((1990 + k % 3) == 1991) for k in context)
    assert all("ECONOMIC CONTEXT" not in r.input for r in training.motivation_examples(df, "k", 1).collect())


def test_extraction_examples_hold_passage_and_pages(spark):
    acts = spark.createDataFrame([(1, "Act of Spring", 1960, "the passage", "Long-run"), (2, "Lost", 1800, "p", "x")], "k int, act_name string, year int, passages_text string, motivation_category string")
    docs = spark.createDataFrame(
        [("far", 1961, ["f"]), ("near", 1960, [f"page {i}" for i in range(1, 8)]), ("none", 1960, [])]
        + [(f"long{j}", 1950, [f"{'Act of 1950' if i % 4 == 0 and j else 'table'} {i}" for i in range(1, 13)]) for j in range(2)] + [("acts", 1950, [f"law 19{i}0 x" for i in range(1, 12)])],
        "d string, year int, pages array<string>",
    )
    got = training.extraction_examples(acts, docs, "k", "d").collect()
    yes = [r for r in got if r.kind == "positive"]
    assert len(yes) == 1 and yes[0].input.startswith("DOCUMENT: near\nDOCUMENT YEAR: 1960\nPAGES: ") and "the passage\n\n--- PAGE BREAK ---\n\npage " in yes[0].input
    out = json.loads(yes[0].output)
    pages = out["acts"][0]["passages"][0]["page_numbers"]
    assert len(pages) == 4 and yes[0].input.count("PAGE BREAK") == 3 and f"PAGES: {pages[0]} to {pages[-1]}" in yes[0].input
    no = {r.name: r for r in got if r.kind == "negative"}
    assert len(no) == 3 and all(json.loads(r.output)["no_acts_found"] for r in no.values())
    assert "Act of 1950" not in no["long1"].input and json.loads(no["long0"].output)["extraction_notes"].startswith("Tables")
    assert "law 19" in no["acts"].input  # no page is free of acts: some from the second half


def test_ladders(spark):
    rows = [("v", "coverage", 0.5, 0.4, 0.6, "jw", 9, 8, 7), ("v", "spurious_rate", None, None, None, "jw", 9, 8, 7), ("v", "coverage", 0.1, 0.1, 0.1, "keyword", 9, 8, 7), ("v", "other", 1.0, 1.0, 1.0, "jw", 9, 8, 7)]
    df = spark.createDataFrame(rows, "variant_id string, metric string, value double, ci_lo double, ci_hi double, gate string, n_clusters int, n_clusters_matched int, n_rr_acts_matched int")
    got = ladders.gate_ladder(df, "jw").collect()
    assert [r.asDict() for r in got] == [{"variant_id": "v", "Coverage": "0.500 [0.400, 0.600]", "Spurious": "—", "Fragmentation": None, "Year alignment": None, "n clusters": 9, "Clusters matched": 8, "RR acts matched": 7}]
    with pytest.raises(ValueError, match="gate"):
        ladders.gate_ladder(df, "both")


def test_a_key_twice_is_an_error(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "r"), (None, "s"), (None, "t")], "k int, y string")
    assert sorted(r.x for r in shaping.joined_once(left, right, ["k"]).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match=r"2 rows for \[1\]"):
        shaping.joined_once(left, right.unionByName(right), ["k"])


def test_pages_to_rescue(spark):
    df = spark.createDataFrame([("short", 1), ("short", 0), (None, 2), ("x" * 100, 1), ("  Digitized for FRASER " + "y" * 99 + "\n", 1), ("short", None)], "t string, n int")
    assert [r[0] for r in df.select(shaping.needs_rescue(df.t, df.n)).collect()] == [True, False, True, False, True, False]
