"""Behavioural tests of a model with a codebook (L08, L09): what changes when the codebook or the text does.

A variant is a changed codebook with its prompt. All texts under all variants
are one table of requests, answered at once; the tests are tables over it.
Codebooks are small and changed on the driver.
"""

from __future__ import annotations

import copy
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import metrics
from factloom.operators.consistency import few_shot_prompt
from factloom.operators.model_calls import Client, answered, answered_variants
from factloom.operators.replies import EVIDENCE, evidence_reason, json_body, parsed
from factloom.sources import codebooks
from factloom.storage import written

#: The paragraph put into texts and the rule that makes it matter.
DISTRACTOR = "And we also support elephants."
EXCLUSION = "IMPORTANT NOTE: This category does not apply if the document discusses an elephant."
#: Least agreement of the first three tests, and the rate of changes from which the order matters.
LEGAL, RECOVERED, ORDER = 1.0, 1.0, 0.05
#: Lower ends of the degrees of agreement of kappa.
AGREEMENT = ((0.8, "Near-perfect agreement"), (0.6, "Substantial agreement"), (0.4, "Moderate agreement"), (0.2, "Fair agreement"))
#: Fixed value: characters of a quote that a fingerprint of evidence has.
FINGERPRINT = 80
#: Sections left out by each condition of an ablation.
ABLATIONS: dict[str, frozenset[str]] = {
    "full": frozenset(),
    "no_label_def": frozenset({"label_definition"}),
    "no_clarifications": frozenset({"clarifications", "negative_clarifications"}),
    "all_removed": frozenset({"label_definition", "positive_examples", "negative_examples", "clarifications", "negative_clarifications"}),
}

TASK = "Now classify the text by the classes above."
MEASURES = "array<struct<name:string,country:string,discusses_motivation:boolean,discusses_timing:boolean,discusses_magnitude:boolean>>"
REPLY = f"label string, reasoning string, measures {MEASURES}"


@dataclass(frozen=True)
class Variant:
    """A codebook's prompt under a name. ``originals`` tells which label of the first codebook a label stands for; ``suffix`` is put after each text."""

    name: str
    prompt: str
    labels: tuple[str, ...]
    originals: dict[str, str] = field(default_factory=dict)
    suffix: str = ""


def _variant(name: str, book: dict, suffix: str = "", originals: dict[str, str] | None = None, **how) -> Variant:
    return Variant(name, codebooks.prompt(book, **how), tuple(codebooks.labels(book)), originals or {}, suffix)


def plain_variant(book: dict, **how) -> Variant:
    return _variant("original", book, **how)


def order_variants(book: dict, seed: int = 42, **how) -> list[Variant]:
    """IV: classes as they are, reversed, and shuffled into another order (with fewer than three classes that is the reversed one)."""
    n = len(book["classes"])
    plain, back = list(range(n)), list(range(n))[::-1]
    mixed = back
    if n > 2:
        draw = random.Random(seed)
        mixed = plain
        while mixed in (plain, back):
            mixed = draw.sample(plain, n)
    return [_variant(name, book, order=o, **how) for name, o in (("original", plain), ("reversed", back), ("shuffled", mixed))]


def with_exclusion(book: dict, rule: str = EXCLUSION) -> dict:
    """The codebook with another criterion of exclusion in its first class."""
    out = copy.deepcopy(book)
    own = out["classes"][0]["negative_clarification"]
    out["classes"][0]["negative_clarification"] = ([own] if isinstance(own, str) else list(own or [])) + [rule]
    return out


def exclusion_variants(book: dict, distractor: str = DISTRACTOR, rule: str = EXCLUSION, **how) -> list[Variant]:
    """V: texts with and without the distractor, codebooks with and without the rule that it triggers."""
    ruled, more = with_exclusion(book, rule), f"\n\n{distractor}"
    return [
        _variant("normal_doc_normal_cb", book, **how), _variant("modified_doc_normal_cb", book, more, **how),
        _variant("normal_doc_modified_cb", ruled, **how), _variant("modified_doc_modified_cb", ruled, more, **how),
    ]


def with_generic_labels(book: dict) -> tuple[dict, dict[str, str]]:
    """The codebook with labels LABEL_1, LABEL_2, ... (in its output instructions too), and what each stands for."""
    out, originals = copy.deepcopy(book), {}
    for n, entry in enumerate(out["classes"], 1):
        originals[f"LABEL_{n}"] = entry["label"]
        entry["label"] = f"LABEL_{n}"
    # longer labels first: one may hold another
    for new, old in sorted(originals.items(), key=lambda x: -len(x[1])):
        out["output_instructions"] = out["output_instructions"].replace(old, new)
    return out, originals


def with_swapped_definitions(book: dict) -> dict:
    """The codebook with the definition and criteria of each class replaced by the next one's (the last gets the first's)."""
    out, n = copy.deepcopy(book), len(book["classes"])
    if n < 2:
        raise ValueError("definitions are swapped between two classes at least")
    for i, entry in enumerate(out["classes"]):
        for part in ("label_definition", "clarification", "negative_clarification"):
            entry[part] = copy.deepcopy(book["classes"][(i + 1) % n][part])
    return out


def label_variants(book: dict, **how) -> list[Variant]:
    """VI and VII: the codebook as it is, with generic labels, and with swapped definitions."""
    generic, originals = with_generic_labels(book)
    return [plain_variant(book, **how), _variant("generic", generic, originals=originals, **how), _variant("swapped", with_swapped_definitions(book), **how)]


def ablation_variants(book: dict, conditions: dict[str, frozenset[str]] | None = None, **how) -> list[Variant]:
    """The codebook without some of its sections, one variant a condition."""
    return [_variant(name, book, without=cut, **how) for name, cut in (ABLATIONS if conditions is None else conditions).items()]


#: What is told of a reply besides its label.
TOLD = ("raw_label", "measures", "reasoning", "reply", "error")


def classified(texts: DataFrame, variants: list[Variant], client: Client, key: str, text: str, *keep: str, told: tuple[str, ...] = TOLD) -> DataFrame:
    """Each text under each variant: ``variant``, ``label`` (null if it is none of the codebook's), ``raw_label``, ``measures``, ``reasoning``, ``reply``, ``error`` (of these what ``told`` names).

    ``label`` is told in the labels of the original codebook. A call that fails
    and a reply that is no JSON give a null label. The replies are written, so
    tests over them call nothing again. Only texts and replies are shuffled:
    prompts are made in the tasks that call.
    """
    asks = list(dict.fromkeys((v.prompt, v.suffix) for v in variants))
    got = answered_variants(texts, client, text, asks, lambda t: few_shot_prompt(TASK, [], t))
    replies = written(got.select("_text_key", "ask", parsed(F.col("reply"), REPLY).alias("_b"), *[c for c in ("reply", "error") if c in told]), "replies")
    by_text = replies.select("_text_key", "ask", F.col("_b.label").alias("raw_label"), *[f"_b.{c}" for c in ("measures", "reasoning") if c in told], *[c for c in ("reply", "error") if c in told])
    rows = texts.select(key, *keep, F.sha2(text, 256).alias("_own"))
    met = rows.filter("_own IS NOT NULL").join(by_text, F.col("_own") == F.col("_text_key")).drop("_own", "_text_key")
    none = rows.filter("_own IS NULL").select(key, *keep, F.explode(F.array(*[F.lit(i) for i in range(len(asks))])).alias("ask"), F.lit(None).cast("string").alias("raw_label"), *([F.lit("no prompt").alias("error")] if "error" in told else []))
    met = met.unionByName(none, allowMissingColumns=True)
    names = F.create_map(*[x for i, a in enumerate(asks) for x in (F.lit(i), F.array(*[F.lit(v.name) for v in variants if (v.prompt, v.suffix) == a]))])
    met = met.withColumn("variant", F.explode(F.element_at(names, F.col("ask"))))
    label, raw = F.lit(None).cast("string"), F.col("raw_label")
    for v in variants:
        own = F.when(raw.isin(*v.labels), raw)
        for new, old in v.originals.items():
            own = F.when(raw == new, F.lit(old)).otherwise(own)
        label = F.when(F.col("variant") == v.name, own).otherwise(label)
    return written(met.select(key, *keep, "variant", label.alias("label"), *told), "classified")


def measures_fit(label: Column, measures: Column, positive: str, iso: str) -> Column:
    """I: the positive label has measures, any other none; each has a name, a country that may be named, and its three flags."""
    m = F.coalesce(measures, F.array().cast(MEASURES))
    whole = F.forall(m, lambda x: (F.coalesce(F.length(x["name"]), F.lit(0)) > 0) & F.coalesce(x["country"].isin(iso, "OTHER"), F.lit(False)) & x["discusses_motivation"].isNotNull() & x["discusses_timing"].isNotNull() & x["discusses_magnitude"].isNotNull())
    return F.when(label.isNull(), False).otherwise(F.when(label == positive, F.size(m) > 0).otherwise(F.size(m) == 0) & whole)


def legal_outputs(rows: DataFrame, key: str, positive: str | None = None, iso: str = "US") -> DataFrame:
    """I, by text: ``valid_json``, ``valid_label``, ``valid_schema`` (with a ``positive`` label also of its measures), ``n_measures``."""
    fits = F.lit(True) if positive is None else measures_fit(F.col("label"), F.col("measures"), positive, iso)
    read = F.coalesce(F.try_parse_json(json_body(F.col("reply"))).isNotNull(), F.lit(False))
    n = F.lit(None).cast("int") if positive is None else F.when(F.col("measures").isNotNull(), F.size("measures")).otherwise(0)
    return rows.select(key, "label", (read & F.col("raw_label").isNotNull()).alias("valid_json"), F.col("label").isNotNull().alias("valid_label"), fits.alias("valid_schema"), n.alias("n_measures"))


def _summary(test: str, metric: Column, n: Column, threshold: float, at_least: bool) -> list[Column]:
    passed = F.coalesce(metric >= threshold if at_least else metric < threshold, F.lit(False))
    return [F.lit(test).alias("test"), metric.alias("metric"), n.alias("n_total"), F.lit(threshold).alias("threshold"), F.lit(">=" if at_least else "<").alias("comparison"), passed.alias("passed")]


def legal_summary(details: DataFrame) -> DataFrame:
    """I: the share of texts with a legal output; all must have one."""
    fine = F.col("valid_json") & F.col("valid_label") & F.col("valid_schema")
    return details.agg(F.avg(fine.cast("double")).alias("m"), F.count(F.lit(1)).alias("n")).select(*_summary("I_legal_outputs", F.col("m"), F.col("n"), LEGAL, True))


def recovery_requests(spark: SparkSession, book: dict) -> DataFrame:
    """II and III: for each definition and each example of the codebook the request to name its label.

    A negative example is right with any label but its own class's.
    """
    rows, labels = [], codebooks.labels(book)
    answer = 'Return your answer as JSON:\n{"label": "<the label>", "reasoning": "Brief explanation"}'
    for entry in book["classes"]:
        own = entry["label"]
        rows.append(("definition", own, 1, f"The following is the definition of a class of the codebook. Name the label that it belongs to.\n\nDefinition: {entry['label_definition']}\n\n{answer}", [own]))
        for kind in ("positive", "negative"):
            right = [own] if kind == "positive" else [x for x in labels if x != own]
            for n, example in enumerate(entry.get(f"{kind}_examples") or [], 1):
                rows.append((kind, own, n, f"The following text is an example of the codebook, word for word. Name the label that it belongs to.\n\nText: {example['text']}\n\n{answer}", right))
    return spark.createDataFrame(rows, "kind string, class string, number int, prompt string, expected array<string>")


def recovered(requests: DataFrame, book: dict, client: Client, **how) -> DataFrame:
    """II and III, by definition and example: ``pred_label`` (null if it is none of the codebook's) and ``correct``."""
    got = answered(requests.withColumn("_system", F.lit(codebooks.prompt(book, **how))), client, "prompt", "_system")
    label = parsed(F.col("reply"), "label string")["label"]
    called = F.when(label.isin(*codebooks.labels(book)), label)
    return got.select("kind", "class", "number", called.alias("pred_label"), F.coalesce(F.array_contains("expected", called), F.lit(False)).alias("correct"))


def recovery_summary(details: DataFrame) -> DataFrame:
    """II and III: shares of right labels; all must be right. A codebook without examples passes III with nothing to do."""
    wide = details.agg(*[c for t, k in (("II", F.col("kind") == "definition"), ("III", F.col("kind") != "definition")) for c in (F.avg(F.when(k, F.col("correct").cast("double"))).alias(f"m{t}"), F.count_if(k).alias(f"n{t}"))])
    two = wide.select(*_summary("II_definition_recovery", F.col("mII"), F.col("nII"), RECOVERED, True))
    three = F.coalesce("mIII", F.when(F.col("nIII") == 0, 1.0))
    return two.unionByName(wide.select(*_summary("III_example_recovery", three, F.col("nIII"), RECOVERED, True)))


def pivoted(rows: DataFrame, key: str, names: list[str], *keep: str) -> DataFrame:
    """A row for each text with the label under each variant."""
    cells = [F.max(F.when(F.col("variant") == n, F.col("label"))).alias(n) for n in names]
    return rows.groupBy(key, *keep).agg(*cells)


def order_changes(rows: DataFrame, key: str) -> DataFrame:
    """IV, by text: labels under the three orders and whether they differ from the first (two missing ones do not)."""
    wide = pivoted(rows, key, ["original", "reversed", "shuffled"])
    return wide.select("*", *[(~F.col("original").eqNullSafe(F.col(n))).alias(f"changed_{n}") for n in ("reversed", "shuffled")])


def kappa_degree(kappa: Column) -> Column:
    out = F.when(kappa.isNull(), "insufficient data")
    for low, name in AGREEMENT:
        out = out.when(kappa > low, name)
    return out.otherwise("Poor agreement")


def order_summary(details: DataFrame, key: str) -> DataFrame:
    """IV: the greater rate of changes, which must be small, both rates, and Fleiss' kappa over texts with all three labels."""
    rates = details.agg(F.avg(F.col("changed_reversed").cast("double")).alias("change_rate_reversed"), F.avg(F.col("changed_shuffled").cast("double")).alias("change_rate_shuffled"), F.count(F.lit(1)).alias("n"))
    names = ["original", "reversed", "shuffled"]
    whole = details.filter(" AND ".join(f"{n} IS NOT NULL" for n in names))
    long = whole.select(key, F.explode(F.array(*names)).alias("label"))
    kappa = metrics.fleiss_kappa(long, key, "label").select("kappa")
    worst = F.greatest("change_rate_reversed", "change_rate_shuffled")
    both = rates.crossJoin(kappa)  # one row each
    return both.select(*_summary("IV_order_invariance", worst, F.col("n"), ORDER, False), "change_rate_reversed", "change_rate_shuffled", "kappa", kappa_degree(F.col("kappa")).alias("kappa_degree"))


def exclusion_details(rows: DataFrame, key: str, true_label: str, negative: str) -> DataFrame:
    """V, by text and combination: the label expected (the negative one where rule and distractor meet) and whether it came (null without a label)."""
    expected = F.when(F.col("variant") == "modified_doc_modified_cb", F.lit(negative)).otherwise(F.col(true_label))
    return rows.select(key, F.col("variant").alias("combo"), expected.alias("expected"), F.col("label").alias("predicted"), (F.col("label") == expected).alias("correct"))


def exclusion_combos(details: DataFrame) -> DataFrame:
    """V, by combination: right labels, texts, accuracy."""
    right = F.count_if(F.col("correct"))
    return details.groupBy("combo").agg(right.alias("n_correct"), F.count(F.lit(1)).alias("n_total"), (right / F.count(F.lit(1))).alias("accuracy"))


def exclusion_summary(details: DataFrame, key: str) -> DataFrame:
    """V: the share of right labels over all combinations, and of texts that are right in all four (a missing label is not right, unless another is wrong it leaves the text out)."""
    every = details.groupBy(key).agg(F.bool_and("correct").alias("_known"), F.count_if(F.col("correct")).alias("_right"), F.count(F.lit(1)).alias("_n"), F.count("correct").alias("_valid"))
    verdict = F.when((F.col("_valid") == F.col("_n")) | ~F.col("_known"), F.col("_known").cast("double"))
    return every.agg((F.sum("_right") / F.sum("_n")).alias("overall_consistency"), F.avg(verdict).alias("all_combos_correct_rate"), F.count(F.lit(1)).alias("n_total"))


def _accuracy(label: Column, true_label: Column) -> Column:
    return F.avg((label == true_label).cast("double"))


def _f1(label: Column, true_label: Column, positive: str) -> Column:
    known = label.isNotNull() & true_label.isNotNull()
    p, y = label == positive, true_label == positive
    tp = F.count_if(known & p & y)
    return F.try_divide(2.0 * tp, 2.0 * tp + F.count_if(known & p & ~y) + F.count_if(known & ~p & y))


def generic_summary(rows: DataFrame, key: str, true_label: str, positive: str) -> DataFrame:
    """VI: accuracy and F1 with the labels as they are and with generic ones, their differences, and the rate of changes among texts with both."""
    wide = pivoted(rows, key, ["original", "generic"], true_label)
    y, a, b = F.col(true_label), F.col("original"), F.col("generic")
    got = wide.agg(_accuracy(a, y).alias("original_accuracy"), _accuracy(b, y).alias("generic_accuracy"), F.avg((a != b).cast("double")).alias("change_rate"), _f1(a, y, positive).alias("original_f1"), _f1(b, y, positive).alias("generic_f1"))
    return got.select("*", (F.col("original_accuracy") - F.col("generic_accuracy")).alias("accuracy_difference"), (F.col("original_f1") - F.col("generic_f1")).alias("f1_difference"))


def swapped_summary(rows: DataFrame, key: str, true_label: str, book: dict) -> DataFrame:
    """VII: how often labels follow swapped definitions and how often names, accuracy and F1 after the swap, and whether names win."""
    labels = codebooks.labels(book)
    follows = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (labels[(i + 1) % len(labels)], label)])
    wide = pivoted(rows, key, ["original", "swapped"], true_label)
    y, a, b = F.col(true_label), F.col("original"), F.col("swapped")
    got = wide.agg(F.avg((b == F.try_element_at(follows, a)).cast("double")).alias("follows_definitions_rate"), F.avg((b == a).cast("double")).alias("follows_names_rate"), _accuracy(b, y).alias("swapped_accuracy"), _f1(b, y, labels[0]).alias("swapped_f1"))
    return got.select("*", (F.col("follows_names_rate") > F.col("follows_definitions_rate")).alias("relies_on_names"))


def ablation_table(rows: DataFrame, true_label: str, positive: str, tier: str, baseline: str = "full") -> DataFrame:
    """Ablation, by condition: accuracy, precision, recall, F1, recalls of both tiers, and how far each falls from the baseline.

    Texts without a label are left out of a rate.
    """
    y, p = F.col(true_label) == positive, F.col("label") == positive
    known = F.col("label").isNotNull() & F.col(true_label).isNotNull()
    hit = F.count_if(known & p & y).cast("double")
    rates = {
        "accuracy": _accuracy(F.col("label"), F.col(true_label)), "precision": F.try_divide(hit, F.count_if(known & p)), "recall": F.try_divide(hit, F.count_if(known & y)), "f1": _f1(F.col("label"), F.col(true_label), positive),
        **{f"tier{t}_recall": F.avg(F.when(F.col(tier) == t, p.cast("double"))) for t in (1, 2)},
    }
    table = rows.groupBy(F.col("variant").alias("condition")).agg(*[c.alias(n) for n, c in rates.items()])
    base = table.filter(F.col("condition") == baseline).select(*[F.col(n).alias(f"_{n}") for n in rates])
    return table.crossJoin(F.broadcast(base)).select("condition", *rates, *[(F.col(f"_{n}") - F.col(n)).alias(f"{n}_drop") for n in rates])


def found_acts(expected: Column, names: Column) -> Column:
    """Which of the expected acts are among the named ones, by containment either way, in lower case (null names hold nothing)."""
    lowered = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.lower(n))
    return F.filter(expected, lambda a: F.exists(lowered, lambda n: F.contains(F.lower(a), n) | F.contains(n, F.lower(a))))


def under_listing(rows: DataFrame, key: str, expected: str) -> DataFrame:
    """How many acts of a text of several acts its measures name: ``n_expected``, ``n_measures``, ``n_acts_found``, ``per_act_recall``."""
    names = F.coalesce(F.transform("measures", lambda m: m["name"]), F.array().cast("array<string>"))
    found = F.size(found_acts(F.col(expected), names))
    return rows.select(key, "label", F.size(expected).alias("n_expected"), F.size(names).alias("n_measures"), found.alias("n_acts_found"), F.try_divide(found.cast("double"), F.size(expected).cast("double")).alias("per_act_recall"))


def evidence_of(texts: DataFrame, variants: list[Variant], client: Client, key: str, text: Column, *keep: str) -> DataFrame:
    """Evidence replies of each text under each variant: ``variant``, ``invalid`` (why the reply does not hold, null if it does), ``n_evidence``, ``label`` (its fingerprint).

    The fingerprint is the sorted quotes (80 characters) with their signals,
    EMPTY without any; a call that fails has none and is invalid.
    """
    one = F.explode(F.array(*[F.struct(F.lit(v.name).alias("variant"), F.lit(v.prompt).alias("_system")) for v in variants])).alias("_v")
    asked = texts.select(key, *keep, text.alias("_text"), one).select(key, *keep, "_v.variant", "_v._system", few_shot_prompt(TASK, [], F.col("_text")).alias("_prompt"))
    got = answered(asked, client, "_prompt", "_system").withColumn("_b", parsed(F.col("reply"), EVIDENCE))
    marks = F.transform("_b.evidence", lambda e: F.concat(F.substring(F.coalesce(e["quote"], F.lit("")), 1, FINGERPRINT), F.lit("|"), F.coalesce(e["signal"], F.lit(""))))
    print_ = F.coalesce(F.nullif(F.array_join(F.array_sort(marks), "||"), F.lit("")), F.lit("EMPTY"))
    why = F.when(F.col("reply").isNull(), F.col("error")).otherwise(evidence_reason(F.col("_b")))
    n = F.coalesce(F.when(F.col("_b.evidence").isNotNull(), F.size("_b.evidence")), F.lit(0))
    return written(got.select(key, *keep, "variant", why.alias("invalid"), n.alias("n_evidence"), F.when(F.col("reply").isNotNull(), print_).alias("label")), "evidence")


def evidence_tests(texts: DataFrame, passages: DataFrame, book: dict, client: Client, key: str, text: str, seed: int = 42, **how) -> dict[str, DataFrame]:
    """I, II and IV for a codebook of evidence: replies that hold, evidence found in ``passages`` (same columns) that plainly have some, and the same evidence under every order of the classes; their ``summary``."""
    rows = evidence_of(texts, order_variants(book, seed, **how), client, key, F.col(text))
    legal = rows.filter(F.col("variant") == "original").select(key, "invalid", F.col("invalid").isNull().alias("valid"))
    plain = evidence_of(passages, [plain_variant(book, **how)], client, key, F.col(text))
    found = plain.select(key, "n_evidence", (F.col("invalid").isNull() & (F.col("n_evidence") > 0)).alias("correct"))
    changes = order_changes(rows, key)
    ordered = order_summary(changes, key)

    def share(test: str, details: DataFrame, flag: str, least: float) -> DataFrame:
        return details.agg(F.avg(F.col(flag).cast("double")).alias("m"), F.count(F.lit(1)).alias("n")).select(*_summary(test, F.col("m"), F.col("n"), least, True))

    summary = share("I_legal_outputs", legal, "valid", LEGAL).unionByName(share("II_instruction_recovery", found, "correct", RECOVERED))
    summary = summary.unionByName(ordered.select("test", "metric", "n_total", "threshold", "comparison", "passed"))
    return {"legal": legal, "recovery": found, "order": changes, "order_summary": ordered, "summary": summary}


def before_evaluation(texts: DataFrame, book: dict, client: Client, key: str, text: str, positive: str | None = None, iso: str = "US", order_texts: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """Tests I to IV and their ``summary``; the orders are tried on the first ``order_texts`` texts by key, as the test asks."""
    spark = texts.sparkSession
    legal = legal_outputs(classified(texts, [plain_variant(book, country_iso=iso)], client, key, text), key, positive, iso)
    found = written(recovered(recovery_requests(spark, book), book, client, country_iso=iso), "recovered")
    few = texts.orderBy(key).limit(order_texts)
    changes = order_changes(classified(few, order_variants(book, seed, country_iso=iso), client, key, text), key)
    ordered = order_summary(changes, key)
    summary = legal_summary(legal).unionByName(recovery_summary(found)).unionByName(ordered.select("test", "metric", "n_total", "threshold", "comparison", "passed"))
    return {"legal": legal, "recovery": found, "order": changes, "order_summary": ordered, "summary": summary}


def error_analysis(texts: DataFrame, book: dict, client: Client, key: str, text: str, true_label: str, tier: str, tests: tuple[str, ...] = ("exclusion", "labels", "ablation"), **how) -> dict[str, DataFrame]:
    """Tests V to VII and the ablation; the codebook's first class is the positive one, its last the negative one.

    ``tests`` names those to make: the exclusion (V), the labels (VI and VII),
    the ablation. Models are asked for these alone.
    """
    labels = codebooks.labels(book)
    makers = {"exclusion": exclusion_variants, "labels": label_variants, "ablation": ablation_variants}
    variants = {v.name: v for t in tests for v in makers[t](book, **how)}
    rows = classified(texts, list(variants.values()), client, key, text, true_label, tier, told=())
    got = {}
    if "exclusion" in tests:
        combos = exclusion_details(rows.filter(F.col("variant").isin(*[v.name for v in exclusion_variants(book, **how)])), key, true_label, labels[-1])
        got |= {"combos": exclusion_combos(combos), "exclusion": exclusion_summary(combos, key)}
    if "labels" in tests:
        got |= {"generic": generic_summary(rows, key, true_label, labels[0]), "swapped": swapped_summary(rows, key, true_label, book)}
    if "ablation" in tests:
        got["ablation"] = ablation_table(rows.filter(F.col("variant").isin(*ABLATIONS)), true_label, labels[0], tier)
    return got
