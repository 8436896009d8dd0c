"""Codebooks, prompts and recodes on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import recodes
from factloom.operators.goldmatch import resolved_gold
from factloom.sources import codebooks

BOOK = {
    "name": "C1: Measures", "version": "1", "instructions": "Read {country} ({country_iso}).", "output_instructions": "Answer.",
    "extra_output_fields": [{"name": "flag"}],
    "classes": [
        {"label": "A", "label_definition": "d", "clarification": ["one", "two"], "negative_clarification": [], "positive_examples": [{"text": " t ", "reasoning": "r"}]},
        {"label": "B", "label_definition": "e", "clarification": [], "negative_clarification": ["no"]},
    ],
}


def test_prompt_text():
    got = codebooks.prompt(BOOK, order=[1, 0], removed={"A": {"clarification_1"}}, without={"label_definition"}, country="new zealand", country_iso="NZ")
    assert got == (
        "Read New Zealand (NZ).\n\n# Class Definitions\n\n## B\n\n**Exclusion criteria:**\n- no\n\n## A\n\n**Inclusion criteria:**\n- two\n\n"
        '**Positive examples for A:**\n\nExample 1:\nText: t\n\nExpected output:\n{\n  "label": "A",\n  "flag": null,\n  "reasoning": "r"\n}\n\n# Output Instructions\n\nAnswer.\n'
    )


def test_validation_names_what_lacks(tmp_path):
    assert codebooks.labels(codebooks.validated(BOOK)) == ["A", "B"]
    with pytest.raises(ValueError, match="lacks version"):
        codebooks.validated({k: v for k, v in BOOK.items() if k != "version"})
    with pytest.raises(ValueError, match="class A lacks clarification"):
        codebooks.validated(BOOK | {"classes": [{"label": "A", "label_definition": "d", "negative_clarification": []}]})
    (tmp_path / "b.json").write_text(json.dumps({"codebook": BOOK}))
    assert codebooks.load(str(tmp_path / "b.json")) == BOOK


def test_cells_and_recodes(spark):
    df = spark.createDataFrame([(None, 0, 0), (0.5, 3, 0), (0.25, 1, 4), (0.1, None, 1)], "v double, a int, b int")
    got = [tuple(r) for r in df.select(recodes.interval_cell(df.v, df.v, df.v), recodes.ratio_cell(df.a, df.b)).collect()]
    assert got == [("—", "0 : 0"), ("0.500 [0.500, 0.500]", "3 : 0"), ("0.250 [0.250, 0.250]", "0.25"), ("0.100 [0.100, 0.100]", "—")]
    one = spark.createDataFrame([("x",)], "k string")
    assert one.select(recodes.looked_up(F.col("k"), {"a": "b"}, True), recodes.looked_up(F.col("k"), {"a": "b"})).first() == ("x", None)
    assert one.select(recodes.signed_effect(F.lit(None).cast("string"), F.lit("mixed")), recodes.signed_effect(F.lit("+"), F.lit(None).cast("string"))).first()[1] == "increase (+)"


def test_gold_ties_go_to_the_first_act(spark):
    df = spark.createDataFrame([("n", "b"), ("n", "a"), ("m", "c"), ("m", "c"), ("m", "a"), (None, "a")], "name string, act string")
    assert sorted(tuple(r) for r in resolved_gold(df, "name", "act").collect()) == [("m", "c"), ("n", "a")]
