"""Act summaries against a plain reading of whole texts, and logs from a fixture."""

import json
import random
import re

import pytest

from factloom.operators import act_text
from factloom.sources import iteration_logs


def plain_blocks(text):
    """Blocks by walking up and down the lines of one text."""
    lines = [x.strip() for x in text.split("\n")]
    start = next((i for i, x in enumerate(lines) if "II. ACT-BY-ACT SUMMARY" in x), 0)
    dated = [i for i in range(start, len(lines)) if re.match(r"(Signed|Date|Effective):\s+.+$", lines[i])]

    def above(i):
        seen_page = False
        for j in range(i - 1, -1, -1):
            if lines[j] and (seen_page or not re.fullmatch(r"\d{1,3}", lines[j])):
                return j
            seen_page = seen_page or bool(lines[j])
        return None

    out = []
    for n, i in enumerate(dated):
        if n + 1 < len(dated):
            end = above(dated[n + 1])
        else:
            end = next((j for j in range(i, len(lines)) if lines[j] == "REFERENCES"), len(lines))
        name = above(i)
        out.append((n + 1, "" if name is None else lines[name], [(j, lines[j]) for j in range(i + 1, max(end, i + 1)) if lines[j]]))
    return out


def test_blocks_of_random_lines(spark):
    rng = random.Random(4)
    pool = ["", "", "  ", "17", "5", "Name A", "Name B ", "Signed: 3/4/50", " Date:  1/2/03", "Effective: soon", "text", "REFERENCES", "Signed:", "more text", "Change in Liabilities:"]
    texts = [(i, "\n".join((["II. ACT-BY-ACT SUMMARY x"] if i % 3 == 0 else []) + rng.choices(pool, k=rng.randint(1, 40)))) for i in range(60)]
    texts = [(i, t if i % 7 else "Name\nDate: 1/1/1990\n" + t) for i, t in texts] + [(99, None), (100, ""), (101, "Signed: 1/1/1901\nx")]
    got = act_text.act_blocks(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    rows = {(r.id, r.block): (r.act_name, [(x.no, x.line) for x in r.lines]) for r in got.collect()}
    want = {(i, n): (name, lines) for i, t in texts if t for n, name, lines in plain_blocks(t)}
    assert rows == want and len(want) > 40


def test_dates(spark):
    df = spark.createDataFrame([("on 3/4/44 and 5/6/50",), ("12/31/45",), ("1/2/1913",), (" later ",)], "d string")
    assert [r[0] for r in df.select(act_text.signed_date(df.d)).collect()] == ["2044-03-04", "1945-12-31", "1913-01-02", "later"]


def lines(text):
    return [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]


def test_columns_of_quarters_and_amounts():
    table, rest = act_text.split_block(lines("Change in Liabilities:\n1980Q1\n1980Q2\n17\n+$1 billion\n–$2.5 billion (Exogenous; Long-run)\n-$3 billion\n(Endogenous: Countercyclical)\nIt was a long narrative.\n+ not a change\n"))
    assert rest[0] == "It was a long narrative." and "17" not in table
    assert act_text.dated_changes(table) == [
        {"section": "standard", "quarter": "1980-01", "amount": 1.0, "category": "Countercyclical", "exogeneity": "Endogenous"},
        {"section": "standard", "quarter": "1980-02", "amount": -2.5, "category": "Long-run", "exogeneity": "Exogenous"},
        {"section": "standard", "quarter": "1980-02", "amount": -3.0, "category": None, "exogeneity": None},
    ]


def test_notes_are_skipped_while_the_table_goes_on():
    near = "Change in Liabilities:\n1980Q1 +$1 billion\na note\n" + "\n" * 20 + "1981Q1 +$2 billion\ntext"
    far = "Change in Liabilities:\n1980Q1 +$1 billion\na narrative\n" + "\n" * 40 + "1981Q1 +$2 billion\ntext"
    assert [x["quarter"] for x in act_text.dated_changes(act_text.split_block(lines(near))[0])] == ["1980-01", "1981-01"]
    table, rest = act_text.split_block(lines(far))
    assert len(act_text.dated_changes(table)) == 1 and rest[0] == "a narrative"


def test_sections_and_owed_quarters():
    got = act_text.dated_changes(["1979Q1 +$9 billion", "Change in Liabilities (excluding retroactive changes):", "1980Q1", "Change in Liabilities (including retroactive changes):", "1981Q1 +$1 billion", "Present Value: 1982Q1 +$4 billion", "+$5 billion", "(Exogenous, Deficit-driven)"])
    assert [(x["section"], x["quarter"], x["amount"], x["category"]) for x in got] == [("retroactive", "1981-01", 1.0, "Deficit-driven"), ("present_value", "1982-01", 4.0, None), ("present_value", "1982-01", 5.0, None)]


def test_quotations():
    text = 'On 3/4/64 the president said "We must have growth in this land" and "too short". ' + "x " * 150 + 'He wrote “another long quotation here”. In the 1966 Economic Report "a third long quotation".'
    got = act_text.quoted_labels(text)
    assert [x["quote"] for x in got] == ["We must have growth in this land", "another long quotation here", "a third long quotation"]
    assert got[0]["date"] == "3/4/64" and got[0]["source"].endswith("the president") and got[1]["date"] == ""


def test_an_act_takes_the_class_of_its_first_change(spark):
    text = "A\nSigned: 1/2/50\nChange in Liabilities (including retroactive x):\n1950Q1 +$1 billion (Exogenous; Long-run)\nStory 50\n20\nB\nDate: x\nNothing here\nREFERENCES\nC\nmore"
    acts = act_text.read_acts(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("block").collect()
    assert [(r.act_name, r.date_signed, r.category, r.exogeneity, r.narrative) for r in acts] == [("A", "1950-01-02", "Long-run", "Exogenous", "Story 50"), ("B", "x", "", "", "Nothing here")]


LOG = [
    {"iteration": 1, "stage": "s1", "date": "2025-01-31", "model": "m", "results": {"overall_pass": False, "metrics": [{"test": "I", "value": 1, "pass": True}, {"test": "IV", "value": "bad", "change_rate_reversed": 0.1, "skipped": True}]}},
    {"iteration": 2, "stage": "s2", "condition": "x", "results": {"metrics": [{"metric": "f1", "value": 0.9, "ci_lower": 0.8}, {"note": "n"}, {"value": 2}], "secondary_metrics": [{"metric": "kappa", "value": 0.5}], "per_class": [{"class": "A", "f1": 0.5, "support": 7}], "per_class_f1": {"Z": 1}, "confusion_matrix": {"tp": 1, "fp": 2, "fn": 3, "tn": 4}}},
    {"iteration": 3, "stage": "s2", "results": {"metrics": {"note": "extraction only"}, "per_class_f1": {"B": 1}, "confusion_matrix": {"tp": 9}}},
    {"iteration": 4, "stage": "s2", "results": {"metrics": [{"metric": "f1"}], "per_class_f1": {"B": 0.25, "C": None}, "confusion_matrix": "none"}},
    {"iteration": 5, "stage": "s3", "results": {"metrics": [{"test": "V_exclusion_criteria", "combos": {"a": 0.5, "b": "x"}, "overall_consistency": 0.9, "all_combos_correct_rate": "n/a"}, {"test": "VII_swapped_labels", "swapped_f1": 0.3, "original_f1": 1}, {"test": "VIII", "swapped_f1": 1}, {"swapped_f1": 2}], "ablation": [{"condition": "full", "accuracy": 0.9, "f1": 0.8, "weighted_f1": 0.7}, {"note": "skipped"}, {"note": "kept", "accuracy": 0.5, "f1_drop": 0.1}]}},
    {"iteration": 6, "stage": "s3_manual_analysis", "results": {"category_distribution": [{"category": "A", "count": 3, "pct": 0.6}], "bias_corrected_metrics": {"effective_n": 12, "accuracy": 0.5, "confusion_matrix": {"tp": 4}}}},
    {"iteration": 7, "stage": "s3_manual_analysis", "results": {}},
    {"stage": "s1"},
    {"iteration": 8, "stage": "s3", "date": "soon", "results": {"ablation": [{"condition": "full", "accuracy": 1}]}},
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "c1.json"
    path.write_text(json.dumps({"iterations": LOG}))
    entries = iteration_logs.log_entries(spark, {"c1": str(path)})
    more = spark.createDataFrame([("c1", "no json"), ("c1", "[1]"), ("c1", None)], entries.schema)
    return {k: v.collect() for k, v in iteration_logs.iteration_tables(entries.unionByName(more)).items()}


def rows(tables, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in tables[name]), key=str)


def test_nine_tables(tables):
    assert {k: len(v) for k, v in tables.items()} == {"meta": 9, "s1": 2, "s2": 4, "s2_per_class": 3, "s2_confusion": 1, "s3": 4, "s3_ablation": 2, "s3_manual": 1, "s3_manual_bias_corrected": 1}
    assert {r.iteration: str(r.date) for r in tables["meta"] if r.stage in ("s1", "s3")} == {1: "2025-01-31", None: "None", 5: "None", 8: "None"}
    assert rows(tables, "s1", "place", "test", "value", "pass", "skipped", "change_rate_reversed") == [(1, "I", 1.0, True, False, None), (2, "IV", None, None, True, 0.1)]
    assert rows(tables, "s2", "iteration", "place", "metric", "value", "condition") == [(2, 1, "f1", 0.9, "x"), (2, 3, None, 2.0, "x"), (2, 4, "kappa", 0.5, "x"), (4, 1, "f1", None, None)]
    assert rows(tables, "s2_per_class", "iteration", "class", "f1", "support") == [(2, "A", 0.5, 7), (4, "B", 0.25, None), (4, "C", None, None)]
    assert rows(tables, "s2_confusion", "iteration", "tp", "fp", "fn", "tn") == [(2, 1, 2, 3, 4)]
    assert rows(tables, "s3", "test", "field", "value") == [("VII_swapped_labels", "swapped_f1", 0.3), ("V_exclusion_criteria", "combo_a", 0.5), ("V_exclusion_criteria", "combo_b", None), ("V_exclusion_criteria", "overall_consistency", 0.9)]
    assert rows(tables, "s3_ablation", "condition", "accuracy", "f1", "f1_drop") == [("full", 0.9, 0.7, None), (None, 0.5, None, 0.1)]
    assert rows(tables, "s3_manual", "category", "count", "pct") == [("A", 3, 0.6)]
    assert rows(tables, "s3_manual_bias_corrected", "iteration", "effective_n", "tp", "fp", "accuracy", "recall") == [(6, 12, 4, None, 0.5, None)]


def test_a_file_without_iterations(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="iterations"):
        iteration_logs.log_entries(spark, {"c": str(tmp_path / "x.json")})
