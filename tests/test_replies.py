"""Replies of models on small fixtures: fences, reasons, repairs and failing calls."""

from pyspark.sql import functions as F

from factloom.operators import replies


def test_fenced_and_plain_json(spark):
    texts = ['{"k": 1}', 'x\n```json\n{"k": 2}\n```', '```\n{"k": 3}\n```', "none", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(replies.parsed(df.t, "k long")["k"]).collect()]
    assert got == [1, 2, 3, None, None, None]


def test_repairs_as_in_the_worked_case(spark):
    names = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "g int, k long")
    said = spark.createDataFrame([(1, "1", "a", 1), (1, "1", "b", 2), (1, "9", "a", 3), (1, "zz", "a", 4)], "g int, k string, c string, ord int")
    clusters, integrity = replies.repaired_clusters(names, said, "g", "k", "c", "ord")
    assert {(r.k, r.n_members) for r in clusters.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert clusters.select("cluster_id").distinct().count() == 3
    assert integrity.first().asDict() == {"g": 1, "n_expected": 3, "n_missing": 2, "n_returned": 2, "n_extra": 1}


def test_a_sign_out_of_range_keeps_the_label(spark):
    df = spark.createDataFrame([('{"label":"A","enacted":true,"sign":"mixed","confidence":"low","reasoning":""}',), ('{"label":"Z","enacted":true,"sign":"increase","confidence":"low","reasoning":""}',), ('{"label":"A","sign":"increase","confidence":"low","reasoning":""}',)], "t string")
    made = replies.graceful_verdict(replies.parsed(F.col("t"), replies.VERDICT), ["A", "B"])
    got = [tuple(r) for r in df.select(*made.values()).collect()]
    assert got == [("A", None, "mixed"), (None, None, "increase"), (None, None, "increase")]


def test_failing_calls_give_null_rows(spark):
    def call(text):
        if text == "bad":
            raise ValueError("refused")
        return text.upper()

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, prompt string")
    got = sorted(tuple(r) for r in replies.ask(df, "prompt", call).collect())
    assert got == [(1, "good", "GOOD", None), (2, "bad", None, "refused"), (3, None, None, "no prompt")]
