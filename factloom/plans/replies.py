"""Queries of parsed and validated replies; replies are built from the rows of ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import replies
from factloom.plans import register
from factloom.plans.corpus import table


@register("parsed_replies", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 7 = 0 AS failed FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS props FROM events)""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 7
    fenced = F.concat(F.lit("So:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, "no json here").when(m == 1, F.col("props")).otherwise(fenced).alias("reply"))
    k = replies.parsed(F.col("reply"), "k long")["k"]
    return rows.select("event_id", k.alias("k"), k.isNull().alias("failed"))


@register("evidence_reasons", """SELECT o_orderkey AS orderkey, ['JSON parse error', 'Missing or non-list ''evidence'' field', 'evidence[2]: missing or non-character ''quote''', 'timing_signals[1]: missing or non-character ''signal''', NULL][o_orderkey % 5 + 1] AS reason FROM orders""")
def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = '{"quote":"a","signal":"b"}'
    texts = [
        "oops", '{"enacted_signals":[],"timing_signals":[]}', f'{{"evidence":[{fine},{{"signal":"b"}}],"enacted_signals":[],"timing_signals":[]}}',
        f'{{"evidence":[{fine}],"enacted_signals":[],"timing_signals":[{{"quote":"a"}}]}}', f'{{"evidence":[{fine}],"enacted_signals":[{fine}],"timing_signals":[]}}',
    ]
    reply = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), replies.parsed(reply, replies.EVIDENCE).alias("body"))
    return rows.select("orderkey", replies.evidence_reason(F.col("body")).alias("reason"))


@register("verdicts", """WITH v AS (SELECT o_orderkey AS k, o_orderpriority AS label, ['increase', 'decrease', 'no_change', 'mixed'][o_orderkey % 4 + 1] AS sign FROM orders)
SELECT k AS orderkey, CASE WHEN label <> '5-LOW' THEN label END AS pred_label, CASE WHEN label <> '5-LOW' THEN CASE sign WHEN 'increase' THEN '+' WHEN 'decrease' THEN '-' WHEN 'no_change' THEN '0' END END AS pred_sign, sign AS pred_sign_raw FROM v""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.element_at(F.array(*[F.lit(x) for x in ("increase", "decrease", "no_change", "mixed")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("label"), F.lit(True).alias("enacted"), sign.alias("sign"), F.lit("high").alias("confidence"), F.lit("r").alias("reasoning"))).alias("reply"),
    )
    rows = rows.withColumn("body", replies.parsed(F.col("reply"), replies.VERDICT))
    made = replies.graceful_verdict(F.col("body"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])
    return rows.select("orderkey", *[c.alias(n) for n, c in made.items()])


ANSWERS_SQL = """names AS (SELECT o_custkey AS g, o_orderkey AS k FROM orders), answers AS (SELECT o_custkey AS g, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000000 ELSE 0 END AS k, o_orderpriority AS c FROM orders WHERE o_orderkey % 3 <> 0)"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    names = o.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"))
    key = (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 5 == 0, 1000000000).otherwise(0)).cast("string")
    said = o.filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("g"), key.alias("k"), F.col("o_orderpriority").alias("c"), F.lit(1).alias("ord"))
    later = said.select("g", "k", F.lit("later").alias("c"), F.lit(2).alias("ord"))
    junk = said.select("g", F.lit("x").alias("k"), "c", F.lit(0).alias("ord"))
    return names, said.unionByName(later).unionByName(junk)


@register("repaired_clusters", f"""WITH {ANSWERS_SQL}, w AS (SELECT n.g, n.k, coalesce(a.c, '__singleton_' || n.k) AS raw FROM names n LEFT JOIN answers a USING (g, k))
SELECT g, k, CAST(dense_rank() OVER (PARTITION BY g ORDER BY raw) AS INTEGER) AS cluster_id, count(*) OVER (PARTITION BY g, raw) AS n_members FROM w""")
def repaired_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.repaired_clusters(*_answers(spark, sf_dir), "g", "k", "c", "ord")[0]


@register("cluster_integrity", f"""WITH {ANSWERS_SQL}, e AS (SELECT n.g, count(*) AS n_expected, count(*) FILTER (a.c IS NULL) AS n_missing FROM names n LEFT JOIN answers a USING (g, k) GROUP BY 1),
x AS (SELECT a.g, count(*) AS n_returned, count(*) FILTER (n.k IS NULL) AS n_extra FROM answers a LEFT JOIN names n USING (g, k) GROUP BY 1)
SELECT g, n_expected, n_missing, coalesce(n_returned, 0) AS n_returned, coalesce(n_extra, 0) AS n_extra FROM e LEFT JOIN x USING (g)""")
def cluster_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.repaired_clusters(*_answers(spark, sf_dir), "g", "k", "c", "ord")[1]


@register("flattened_acts", """SELECT o_orderkey AS orderkey, o_orderpriority AS act_name, CAST(year(o_orderdate) AS INTEGER) AS year, 'a' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || o_orderstatus AS passages_text, '2,3,7' AS pages,
 CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.5 END AS confidence FROM orders""")
def flattened_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.when(F.col("o_orderkey") % 2 == 1, F.lit(0.5))
    passages = F.array(F.struct(F.lit("a").alias("text"), F.array(F.lit(7), F.lit(2)).alias("pages"), sure.alias("confidence")), F.struct(F.col("o_orderstatus").alias("text"), F.array(F.lit(3), F.lit(2)).alias("pages"), F.lit(None).cast("double").alias("confidence")))
    acts = F.array(F.struct(F.col("o_orderpriority").alias("act_name"), F.year("o_orderdate").alias("year"), passages.alias("passages")))
    got = replies.flattened_acts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), acts.alias("acts")), "acts", "orderkey")
    return got.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@register("sign_metrics", """WITH s AS (SELECT ['+', '-', '0', 'UNCLEAR', NULL][o_orderkey % 5 + 1] AS p, ['+', '-', '0'][o_orderkey % 3 + 1] AS y, o_orderstatus = 'F' AS called FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT count(*) AS n_true_exogenous, round(avg(CASE WHEN p <> 'UNCLEAR' AND p = y THEN 1.0 ELSE 0.0 END), 9) AS sign_accuracy, round(avg(CASE WHEN p <> 'UNCLEAR' AND p = y AND called THEN 1.0 ELSE 0.0 END), 9) AS signed_precision FROM s""")
def sign_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.element_at(F.array(*[F.lit(x) for x in ("+", "-", "0", "UNCLEAR", None)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    y = F.element_at(F.array(*[F.lit(x) for x in "+-0"]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(p.alias("p"), y.alias("y"), (F.col("o_orderstatus") == "F").alias("called"), (F.col("o_orderpriority") == "1-URGENT").alias("exo"))
    got = replies.sign_metrics(rows, "p", "y", "called", "exo")
    return got.select("n_true_exogenous", *[F.round(c, 9).alias(c) for c in got.columns[1:]])
