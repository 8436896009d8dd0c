"""Queries over the replies of a rule-based model: votes, second calls, behavioural tests, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import behaviour, consistency, model_calls, replies, rule_model
from factloom.operators.model_calls import Client
from factloom.plans import register
from factloom.plans.corpus import table

BOOK = {
    "name": "measures", "version": "1", "instructions": "Say whether the text tells of a measure.", "output_instructions": "Return JSON with the label, MEASURE or OTHER.",
    "classes": [
        {"label": "MEASURE", "label_definition": 'The text has "the" or "die" in it.', "clarification": ["Any place."], "negative_clarification": ["Not in names."], "positive_examples": [{"text": "the tax", "reasoning": "r"}], "negative_examples": [{"text": "nothing here", "reasoning": "r"}]},
        {"label": "OTHER", "label_definition": "Anything else.", "clarification": [], "negative_clarification": []},
    ],
}


def no_wait(seconds: float) -> None:
    """Nothing to wait for: the model is a rule."""


def rule_client(follows: str = "definitions", **how) -> Client:
    return Client(rule_model.RuleModel(follows, **how), {"model": f"rule-{follows}"}, tries=2, sleep=no_wait)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "OTHER").otherwise("MEASURE").alias("truth"), (F.col("doc_id") % 2 + 1).alias("tier"))


#: What the rule says of the texts: with the codebook as it is, and with its definitions swapped.
RULED = """t AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'OTHER' ELSE 'MEASURE' END AS truth, doc_id % 2 + 1 AS tier FROM documents),
r AS (SELECT *, CASE WHEN text IS NULL THEN NULL WHEN contains(lower(text), 'the') OR contains(lower(text), 'die') THEN 'MEASURE' ELSE 'OTHER' END AS label FROM t)"""


@register("asked_labels", f"WITH {RULED} SELECT doc_id, label, text IS NULL AS failed FROM r")
def asked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = behaviour.classified(texts(spark, sf_dir), [behaviour.plain_variant(BOOK)], rule_client(), "doc_id", "text")
    return rows.select("doc_id", "label", F.col("error").isNotNull().alias("failed"))


@register("legal_outputs", f"""WITH {RULED}, m AS (SELECT doc_id, label, coalesce(len(regexp_extract_all(text, '[A-Z]\\w+(?: [A-Z]\\w+)* Act of \\d{{4}}')), 0) AS n FROM r)
SELECT doc_id, label IS NOT NULL AS valid_json, label IS NOT NULL AS valid_label, coalesce((label = 'MEASURE') = (n > 0), FALSE) AS valid_schema, CAST(n AS INTEGER) AS n_measures FROM m""")
def legal_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = behaviour.classified(texts(spark, sf_dir), [behaviour.plain_variant(BOOK)], rule_client(), "doc_id", "text")
    return behaviour.legal_outputs(rows, "doc_id", "MEASURE").drop("label")


@register("order_changes", f"""WITH {RULED}, o AS (SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'MEASURE' ELSE label END AS original, CASE WHEN length(text) % 2 = 0 THEN 'OTHER' ELSE label END AS reversed FROM r)
SELECT doc_id, original, reversed, reversed AS shuffled, original IS DISTINCT FROM reversed AS changed_reversed, original IS DISTINCT FROM reversed AS changed_shuffled FROM o""")
def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of the classes under a model that favours the first one: it must fail the test."""
    return behaviour.order_changes(behaviour.classified(texts(spark, sf_dir), behaviour.order_variants(BOOK), rule_client("order"), "doc_id", "text"), "doc_id")


@register("order_summary", f"""WITH {RULED}, o AS (SELECT CASE WHEN length(text) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS changed FROM r),
m AS (SELECT avg(coalesce(changed, 0)) AS metric, count(*) AS n_total FROM o)
SELECT 'IV_order_invariance' AS test, round(metric, 9) AS metric, n_total, 0.05::DOUBLE AS threshold, '<' AS comparison, metric < 0.05 AS passed FROM m""")
def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = behaviour.order_summary(order_changes(spark, sf_dir), "doc_id").select("test", "metric", "n_total", "threshold", "comparison", "passed")
    return got.withColumn("metric", F.round("metric", 9))


@register("exclusion_combos", f"""WITH {RULED}, c AS (SELECT truth, label, unnest(['normal_doc_normal_cb', 'modified_doc_normal_cb', 'normal_doc_modified_cb', 'modified_doc_modified_cb']) AS combo, contains(lower(text), 'elephant') AS e FROM (SELECT truth, text, CASE WHEN contains(lower(text || ' the'), 'the') THEN label END AS label FROM r)),
p AS (SELECT combo, CASE WHEN label IS NULL THEN NULL WHEN combo = 'modified_doc_modified_cb' OR combo = 'normal_doc_modified_cb' AND e THEN 'OTHER' ELSE label END AS predicted, CASE WHEN combo = 'modified_doc_modified_cb' THEN 'OTHER' ELSE truth END AS expected FROM c)
SELECT combo, count(*) FILTER (predicted = expected) AS n_correct, count(*) AS n_total, round(count(*) FILTER (predicted = expected) / count(*), 9) AS accuracy FROM p GROUP BY 1""")
def exclusion_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, "exclusion")["combos"].withColumn("accuracy", F.round("accuracy", 9))


def _analysis(spark: SparkSession, sf_dir: str, test: str) -> dict[str, DataFrame]:
    return behaviour.error_analysis(texts(spark, sf_dir), BOOK, rule_client(), "doc_id", "text", "truth", "tier", (test,))


@register("label_tests", f"""WITH {RULED}, f AS (SELECT avg(CAST(label = truth AS DOUBLE)) AS a, 2.0 * count(*) FILTER (label = 'MEASURE' AND truth = 'MEASURE') / (count(*) FILTER (label = 'MEASURE') + count(*) FILTER (truth = 'MEASURE' AND label IS NOT NULL)) AS f1,
 avg(CAST(label <> truth AS DOUBLE)) AS b, 2.0 * count(*) FILTER (label = 'OTHER' AND truth = 'MEASURE') / (count(*) FILTER (label = 'OTHER') + count(*) FILTER (truth = 'MEASURE' AND label IS NOT NULL)) AS f2 FROM r)
SELECT round(a, 9) AS original_accuracy, round(a, 9) AS generic_accuracy, 0.0::DOUBLE AS change_rate, round(f1, 9) AS original_f1, 1.0::DOUBLE AS follows_definitions_rate, 0.0::DOUBLE AS follows_names_rate, round(b, 9) AS swapped_accuracy, round(f2, 9) AS swapped_f1, FALSE AS relies_on_names FROM f""")
def label_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic labels and swapped definitions under a model that follows definitions: it must pass both."""
    got = _analysis(spark, sf_dir, "labels")
    both = got["generic"].select("original_accuracy", "generic_accuracy", "change_rate", "original_f1").crossJoin(got["swapped"])  # one row each
    return both.select(*[c if c == "relies_on_names" else F.round(c, 9).alias(c) for c in both.columns])


@register("ablation_drops", f"""WITH {RULED}, v AS (SELECT unnest(['full', 'no_label_def', 'no_clarifications', 'all_removed']) AS condition, truth, tier, label FROM r WHERE label IS NOT NULL),
p AS (SELECT condition, truth, tier, CASE WHEN condition IN ('full', 'no_clarifications') THEN label ELSE 'MEASURE' END AS l FROM v),
m AS (SELECT condition, avg(CAST(l = truth AS DOUBLE)) AS accuracy, count(*) FILTER (l = 'MEASURE' AND truth = 'MEASURE') / count(*) FILTER (truth = 'MEASURE') AS recall, avg(CAST(l = 'MEASURE' AS DOUBLE)) FILTER (tier = 1) AS tier1_recall FROM p GROUP BY 1)
SELECT m.condition, round(m.accuracy, 9) AS accuracy, round(m.recall, 9) AS recall, round(f.accuracy - m.accuracy, 9) AS accuracy_drop, round(f.recall - m.recall, 9) AS recall_drop, round(f.tier1_recall - m.tier1_recall, 9) AS tier1_recall_drop FROM m, m AS f WHERE f.condition = 'full'""")
def ablation_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _analysis(spark, sf_dir, "ablation")["ablation"]
    return got.select("condition", *[F.round(c, 9).alias(c) for c in ("accuracy", "recall", "accuracy_drop", "recall_drop", "tier1_recall_drop")])


@register("evidence_orders", """SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 'EMPTY' ELSE substr(text, 1, 10) || '|' || CASE WHEN length(text) % 2 = 0 THEN 'MEASURE' ELSE 's' END END AS original, coalesce(text <> '' AND length(text) % 2 = 0, FALSE) AS changed_reversed FROM documents""")
def evidence_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    client = Client(rule_model.ordered_evidence, {"model": "evidence-order"}, tries=2, sleep=no_wait)
    return behaviour.evidence_tests(docs, docs.limit(0), BOOK, client, "doc_id", "text")["order"].select("doc_id", "original", "changed_reversed")


#: The digit of each text and sample, as the rule has it.
DIGITS = """d AS (SELECT doc_id, text, s AS sample, CAST('0x' || substr(md5(text || '#' || s), 1, 1) AS INTEGER) AS d FROM (SELECT doc_id, text, unnest(range(1, 6)) AS s FROM documents))"""


def _bodies(spark: SparkSession, sf_dir: str, call, schema: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", consistency.few_shot_prompt("Read the text.", [], F.col("text")).alias("prompt"))
    client = Client(call, {"model": call.__name__, "temperature": 0.7}, tries=2, sleep=no_wait)
    return consistency.read_replies(consistency.sampled(rows, client), schema, "reply", "doc_id", "sample")


@register("sampled_detections", f"""WITH {DIGITS}, v AS (SELECT doc_id, sample, d, CASE WHEN d < 8 THEN TRUE WHEN d < 14 THEN FALSE END AS a, CASE WHEN d < 8 THEN 'Act ' || d % 3 END AS name, CASE WHEN d < 14 THEN 'digit ' || d END AS why FROM d),
c AS (SELECT doc_id, count(*) FILTER (a) AS y, count(*) FILTER (NOT a) AS n, first(why ORDER BY sample) FILTER (why IS NOT NULL) AS reasoning FROM v GROUP BY 1),
k AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, name) AS r FROM v WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT c.doc_id, CASE WHEN y + n > 0 THEN y > n END AS contains_act, k.name AS act_name, CASE WHEN y + n > 0 THEN round(greatest(y, n) / (y + n), 9) ELSE 0.0::DOUBLE END AS agreement_rate, reasoning, 5 AS n_samples, y + n AS n_valid FROM c LEFT JOIN k ON k.doc_id = c.doc_id AND k.r = 1""")
def sampled_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = consistency.detected(_bodies(spark, sf_dir, rule_model.sampled_detection, consistency.DETECTION), "doc_id", "sample")
    return got.withColumn("agreement_rate", F.round("agreement_rate", 9))


@register("sampled_motivations", f"""WITH {DIGITS}, v AS (SELECT doc_id, sample, d, ['Long-run', 'Deficit-driven', 'Spending-driven', 'Countercyclical'][d % 4 + 1] AS m FROM d WHERE d < 15),
k AS (SELECT doc_id, m, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, m) AS r, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM v GROUP BY 1, 2),
f AS (SELECT doc_id, bool_or(d % 5 = 0) AS needs, first('r' || d ORDER BY sample) FILTER (d % 5 = 0) AS why, first('e' || d ORDER BY sample) FILTER (d > 4) AS e, first('digit ' || d ORDER BY sample) AS reasoning FROM v GROUP BY 1)
SELECT x.doc_id, k.m AS motivation, k.m IN ('Long-run', 'Deficit-driven') AS exogenous, coalesce(round(k.n / k.t, 9), 0.0::DOUBLE) AS agreement_rate, coalesce(needs, FALSE) AS needs_expert_review, why AS review_reason, coalesce(e, '') AS evidence, reasoning, CAST(coalesce(t, 0) AS BIGINT) AS n_valid
FROM documents x LEFT JOIN k ON k.doc_id = x.doc_id AND k.r = 1 LEFT JOIN f ON f.doc_id = x.doc_id""")
def sampled_motivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = consistency.motivated(_bodies(spark, sf_dir, rule_model.sampled_motivation, consistency.MOTIVATION), "doc_id", "sample")
    return got.drop("n_samples").withColumns({"agreement_rate": F.round("agreement_rate", 9), "evidence": F.array_join("evidence", ",")})


@register("sampled_changes", f"""WITH {DIGITS}, c AS (SELECT doc_id, sample, 0 AS pos, '200' || d % 3 || '-Q1' AS q, d / 4 AS m, CASE WHEN d % 2 = 0 THEN '2000-Q1' END AS p, d / 16 AS c, NULL AS s FROM d WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, sample, 1, '2009-Q4', -1.5::DOUBLE, NULL, NULL, 's' || d FROM d WHERE d > 9)
SELECT doc_id, q AS timing_quarter, round(median(m), 9) AS magnitude_billions, first(p ORDER BY sample, pos) FILTER (p IS NOT NULL) AS present_value_quarter, round(avg(c), 9) AS confidence, first(s ORDER BY sample, pos) FILTER (s IS NOT NULL) AS source, count(*) AS n_samples_agree FROM c GROUP BY 1, 2""")
def sampled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = consistency.agreed_changes(_bodies(spark, sf_dir, rule_model.sampled_changes, consistency.CHANGES), "doc_id", "sample")
    return got.drop("present_value_billions").withColumns({c: F.round(c, 9) for c in ("magnitude_billions", "confidence")})


@register("sampled_acts", f"""WITH {DIGITS}, v AS (SELECT doc_id, count(*) FILTER (d < 15) AS n FROM d GROUP BY 1),
a AS (SELECT doc_id, sample, 0 AS pos, 'the act ' || d % 3 AS k, CASE WHEN d % 2 = 1 THEN 'THE' ELSE 'The' END || ' Act ' || d % 3 AS name, 1990 + d % 2 AS y, 'passage of act ' || d % 3 AS p, CASE WHEN d % 4 > 0 THEN 'digit ' || d END AS why FROM d WHERE d > 3 AND d < 15
 UNION ALL SELECT doc_id, sample, 1, 'other', 'Other', 2000, 'one more passage', NULL FROM d WHERE d > 11 AND d < 15),
n AS (SELECT doc_id, k, name, row_number() OVER (PARTITION BY doc_id, k ORDER BY count(*) DESC, name) AS r FROM a GROUP BY 1, 2, 3), y AS (SELECT doc_id, k, y, row_number() OVER (PARTITION BY doc_id, k ORDER BY count(*) DESC, y) AS r FROM a GROUP BY 1, 2, 3),
g AS (SELECT doc_id, k, count(*) AS votes, min(p) AS p, first(why ORDER BY sample, pos) FILTER (why IS NOT NULL) AS reasoning FROM a GROUP BY 1, 2)
SELECT g.doc_id, n.name AS act_name, CAST(y.y AS INTEGER) AS year, g.p AS passages, g.reasoning, g.votes, v.n AS n_valid, round(g.votes / v.n, 9) AS agreement_rate FROM g JOIN v USING (doc_id) JOIN n ON n.doc_id = g.doc_id AND n.k = g.k AND n.r = 1 JOIN y ON y.doc_id = g.doc_id AND y.k = g.k AND y.r = 1
WHERE g.votes >= greatest(1, v.n // 2)""")
def sampled_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = consistency.agreed_acts(_bodies(spark, sf_dir, rule_model.sampled_acts, consistency.EXTRACTION), "doc_id", "sample")
    return got.withColumns({"passages": F.array_join("passages", "|"), "agreement_rate": F.round("agreement_rate", 9)})


@register("second_calls", """SELECT doc_id, CASE WHEN text IS NULL THEN 'no prompt' WHEN length(text) % 9 = 0 THEN 'evidence[1]: missing or non-character ''signal''' END AS invalid, CASE WHEN text IS NULL THEN 0 WHEN length(text) % 3 = 0 THEN 2 ELSE 1 END AS n_asked, CASE WHEN length(text) % 9 > 0 THEN substr(text, 1, 10) END AS quote FROM documents""")
def second_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", consistency.few_shot_prompt("Read the text.", [], F.col("text")).alias("prompt"))
    client = Client(rule_model.improving_evidence, {"model": "evidence"}, tries=2, sleep=no_wait)
    got = model_calls.answered_validly(rows, client, lambda reply: replies.evidence_reason(replies.parsed(reply, replies.EVIDENCE)))
    quote = F.when(F.col("invalid").isNull(), replies.parsed(F.col("reply"), replies.EVIDENCE)["evidence"][0]["quote"])
    return got.select("doc_id", "invalid", "n_asked", quote.alias("quote"))


def letter_counts(listed: list[str]) -> list[list[float]]:
    """A stand-in for a model of embeddings: how often each of three letters occurs in a text."""
    return [[float(t.count(x)) for x in "aeo"] for t in listed]


@register("embedded_names", """SELECT p_partkey AS partkey, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS DOUBLE) AS a, CAST(1 + 2 + length(p_name) - length(replace(p_name, 'e', '')) AS DOUBLE) AS e, CAST(length(p_name) - length(replace(p_name, 'o', '')) AS DOUBLE) AS o FROM part""")
def embedded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = model_calls.embedded(table(spark, sf_dir, "part"), letter_counts, "p_name", "Sepe", sleep=no_wait)
    return got.select(F.col("p_partkey").alias("partkey"), *[F.col("embedding")[i].alias(x) for i, x in enumerate("aeo")])
