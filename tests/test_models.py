"""Calls of models, votes over their samples and behavioural tests, with rule-based models."""

import hashlib
import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.operators import behaviour, consistency, model_calls, replies, rule_model
from factloom.operators.model_calls import Client, Replays, patient, wait_after
from factloom.plans.models import BOOK, no_wait, rule_client
from factloom.sources import codebooks
from factloom.storage import shared_dir

# tasks can't import this module: what it defines goes to them whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Noted:
    """A model that notes each call as a file, fails as often as ``fails`` says, and stops the task where told."""

    def __init__(self, folder, fails=0, stops=None):
        self.folder, self.fails, self.stops = folder, fails, stops

    def __call__(self, request):
        if request["prompt"] == self.stops and not os.path.exists(f"{self.folder}/stopped"):
            open(f"{self.folder}/stopped", "w").close()
            raise KeyboardInterrupt("the task is lost")
        open(f"{self.folder}/{request['prompt']}-{request['sample']}-{request['attempt']}-{uuid.uuid4().hex}", "w").close()
        made = sum(x.startswith(f"{request['prompt']}-{request['sample']}-{request['attempt']}-") for x in os.listdir(self.folder))
        if made <= self.fails:
            raise ValueError("HTTP 429" if made == 1 else "broken pipe")
        return f"{request['prompt']}!{request['sample']}{request['system'] or ''}"

    def calls(self):
        return sorted(x.rsplit("-", 1)[0] for x in os.listdir(self.folder) if x != "stopped")


class Slept:
    """Notes how long it was asked to sleep."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, seconds):
        open(f"{self.folder}/{seconds}-{uuid.uuid4().hex}", "w").close()

    def sums(self):
        return sorted(float(x.split("-")[0]) for x in os.listdir(self.folder))


def test_waits():
    assert [wait_after(e, 3) for e in ("HTTP 429", "Too Many Requests", "error 529", "Overloaded now", "timeout")] == [60, 60, 60, 60, 8]
    seen = []

    def fails():
        raise ValueError("x")

    assert patient(fails, 4, seen.append) == (None, "x", 4) and seen == [2, 4, 8]


def test_equal_requests_are_called_once_and_failures_wait(spark, tmp_path):
    calls, naps = tmp_path / "calls", tmp_path / "naps"
    calls.mkdir(), naps.mkdir()
    model, sleep = Noted(str(calls), fails=2), Slept(str(naps))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, prompt string")
    got = model_calls.answered(df, Client(model, sleep=sleep)).orderBy("id")
    for _ in range(2):  # whatever is computed from the result, nothing is called again
        assert [tuple(r) for r in got.collect()] == [(1, "a", "a!1", None, 3), (2, "a", "a!1", None, 3), (3, "b", "b!1", None, 3), (4, None, None, "no prompt", 0)]
    assert model.calls() == ["a-1-1"] * 3 + ["b-1-1"] * 3 and sleep.sums() == [4, 4, 60, 60]
    failed = model_calls.answered(df, Client(Noted(str(calls), fails=99), {"model": "other"}, tries=2, sleep=sleep)).orderBy("id").collect()
    assert [(r.reply, r.error, r.n_calls) for r in failed] == [(None, "broken pipe", 2)] * 3 + [(None, "no prompt", 0)]


def test_a_lost_task_repeats_no_call(spark, tmp_path):
    model = Noted(str(tmp_path), stops="p7")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id int, prompt string").coalesce(1)
    kept = model_calls.replays_of(df, f"replies-{uuid.uuid4().hex}")
    client = Client(model, {"model": "m"}, replays=kept, sleep=no_wait)
    with pytest.raises(Exception, match="lost|SparkException|aborted|crash"):
        model_calls.answered(df, client).collect()
    assert kept.get("00none") is None
    got = model_calls.answered(df, client).collect()
    assert {(r.id, r.reply) for r in got} == {(i, f"p{i}!1") for i in range(12)}
    assert model.calls() == sorted(f"p{i}-1-1" for i in range(12))  # each once over both runs
    again = model_calls.answered(df, client).collect()
    assert {r.n_calls for r in again} == {0} and len(model.calls()) == 12
    other = model_calls.answered(df.limit(1), Client(model, {"model": "n"}, replays=kept, sleep=no_wait)).collect()
    assert other[0].n_calls == 1  # another model is another request
    model_calls.forget(kept)
    assert model_calls.answered(df.limit(1), client).collect()[0].n_calls == 1


def test_replays_of_odd_replies(spark):
    kept = Replays(f"{shared_dir(spark)}/replays-{uuid.uuid4().hex}")
    for key, reply in (("ab1", ""), ("ab2", "é\n "), ("ab2", "second")):
        kept.put(key, reply)
        assert kept.get(key) == reply


def test_invalid_replies_are_asked_again(spark, tmp_path):
    def call(request):
        n, attempt = int(request["prompt"]), request["attempt"]
        if n == 5:
            raise ValueError("refused")
        return json.dumps({"evidence": [], "enacted_signals": [], "timing_signals": []}) if attempt > n else "{}"

    df = spark.createDataFrame([(i, str(i)) for i in range(4)] + [(5, "5"), (6, None)], "id int, prompt string")
    got = model_calls.answered_validly(df, Client(call, tries=1, sleep=no_wait), lambda r: replies.evidence_reason(replies.parsed(r, replies.EVIDENCE)), again=2)
    rows = {r.id: (r.invalid, r.n_asked) for r in got.collect()}
    missing = "Missing or non-list 'evidence' field"
    assert rows == {0: (None, 1), 1: (None, 2), 2: (None, 3), 3: (missing, 3), 5: ("refused", 3), 6: ("no prompt", 0)}


def test_every_distinct_text_is_embedded_once(spark, tmp_path):
    folder = str(tmp_path)

    def embed(listed):
        open(f"{folder}/{uuid.uuid4().hex}-{len(listed)}", "w").close()
        if any("bad" in t for t in listed):
            raise ValueError("no")
        return [[float(len(t))] for t in listed]

    df = spark.createDataFrame([(i, f"t{i % 70}") for i in range(300)] + [(900, None), (901, "")], "id int, name string").coalesce(1)
    got = {r.id: r.embedding for r in model_calls.embedded(df, embed, "name", sleep=no_wait).collect()}
    assert got[900] is None and got[901] is None and got[12] == [3.0] and len(got) == 302
    sizes = [int(x.split("-")[1]) for x in os.listdir(folder)]
    assert sum(sizes) == 70 and max(sizes) <= 32
    bad = spark.createDataFrame([("bad",)], "name string")
    assert model_calls.embedded(bad, embed, "name", tries=2, sleep=no_wait).first().embedding is None


def bodies(spark, texts, schema):
    df = spark.createDataFrame([(i, s, t) for i, s, t in texts], "id int, sample int, reply string")
    return consistency.read_replies(df, schema, "reply", "id", "sample")


def test_votes_keep_failed_samples(spark):
    said = [(1, 1, '{"contains_act": true, "act_name": "B", "reasoning": null}'), (1, 2, '{"contains_act": "TRUE", "act_name": "A", "reasoning": "second"}'), (1, 3, '{"contains_act": false}'), (1, 4, None), (1, 5, "[1]"), (2, 1, None), (2, 2, "x"), (3, 1, '{"contains_act": true}'), (3, 2, '{"contains_act": false}')]
    got = {r.id: r.asDict() for r in consistency.detected(bodies(spark, said, consistency.DETECTION), "id", "sample").collect()}
    assert got[1] == {"id": 1, "contains_act": True, "act_name": "A", "agreement_rate": pytest.approx(2 / 3), "reasoning": "second", "n_samples": 5, "n_valid": 3}
    assert got[2] == {"id": 2, "contains_act": None, "act_name": None, "agreement_rate": 0.0, "reasoning": None, "n_samples": 2, "n_valid": 0}
    assert got[3]["contains_act"] is False and got[3]["agreement_rate"] == 0.5  # FALSE comes before TRUE


def test_acts_of_samples(spark):
    def acts(*found):
        return json.dumps({"acts": [{"act_name": n, "year": y, "passages": p} for n, y, p in found]})

    long, near = "one two three four five six", "one two three four five six seven"
    said = [
        (1, 1, acts(("Tax Act", 1990, [long]))), (1, 2, acts(("tax  act!", 1991, [{"text": near}]), ("Rare", 2000, []))), (1, 3, acts()), (1, 4, "{}"), (1, 5, "oops"),
        (2, 1, acts()), (2, 2, "{}"), (3, 1, "no"),
    ]
    b = bodies(spark, said, consistency.EXTRACTION)
    agreed = consistency.agreed_acts(b, "id", "sample")
    assert [r.asDict() for r in agreed.collect()] == [{"id": 1, "act_name": "Tax Act", "year": 1990, "passages": [near], "reasoning": None, "votes": 2, "n_valid": 4, "agreement_rate": 0.5}]
    rates = {r.id: (r.no_acts_found, r.n_acts, r.n_samples, r.n_valid, r.agreement_rate) for r in consistency.extraction_agreement(b, agreed, "id", "sample").collect()}
    assert rates == {1: (False, 1, 5, 4, 0.5), 2: (True, 0, 2, 2, 1.0), 3: (True, 0, 1, 0, 0.0)}


def test_requests_name_their_parts(spark):
    df = spark.createDataFrame([("A", "p", 1999, "")], "n string, p string, y int, c string")
    made = df.select(consistency.act_request(F.col("n"), F.col("p"), "Go.", F.col("y"), None, F.col("c")).alias("a"), consistency.act_request(F.col("n"), F.col("p"), "Go.", None, F.lit(None), F.lit("boom")).alias("b")).first()
    assert made.a == "ACT: A\nYEAR: 1999\n\nPASSAGES FROM ORIGINAL SOURCES:\np\n\nGo." and "DATE SIGNED" not in made.b.split("ECONOMIC")[1] and "ECONOMIC CONTEXT: boom" in made.b
    prompt = df.select(consistency.few_shot_prompt("Do.", [{"input": "i", "output": {"k": 1}}], F.col("p"))).first()[0]
    assert prompt.startswith("Do.\n\n# Examples\n\nExample 1:\nInput:\ni") and rule_model.task_text(prompt) == "p"


THREE = {
    **BOOK, "output_instructions": "Answer TAX, TAXES or OTHER.",
    "classes": [
        {"label": "TAX", "label_definition": 'Texts with "tax".', "clarification": ["c"], "negative_clarification": ["n"], "positive_examples": [{"text": "a tax", "reasoning": "r"}], "negative_examples": [{"text": "a duty", "reasoning": "r"}]},
        {"label": "TAXES", "label_definition": 'Texts with "duty".', "clarification": ["c2"], "negative_clarification": []},
        {"label": "OTHER", "label_definition": "The rest.", "clarification": [], "negative_clarification": []},
    ],
}
TEXTS = [(1, "a tax", "TAX", 1), (2, "a duty", "TAXES", 2), (3, "no such thing", "OTHER", 1), (4, "an elephant and a tax", "TAX", 2), (5, "The Big Act of 1990 is a tax", "TAX", 1)]


def labelled(spark):
    return spark.createDataFrame(TEXTS, "id int, text string, truth string, tier int")


def test_codebooks_are_changed_as_named():
    generic, originals = behaviour.with_generic_labels(THREE)
    assert generic["output_instructions"] == "Answer LABEL_1, LABEL_2 or LABEL_3." and originals["LABEL_2"] == "TAXES"
    swapped = behaviour.with_swapped_definitions(THREE)
    assert [c["label_definition"] for c in swapped["classes"]] == ['Texts with "duty".', "The rest.", 'Texts with "tax".'] and codebooks.labels(swapped) == codebooks.labels(THREE)
    orders = [[p for p in sorted(codebooks.labels(THREE), key=lambda x: v.prompt.index(f"## {x}\n"))] for v in behaviour.order_variants(THREE)]
    assert orders[0] == ["TAX", "TAXES", "OTHER"] and orders[1] == orders[0][::-1] and orders[2] not in orders[:2]
    assert behaviour.EXCLUSION in behaviour.exclusion_variants(THREE)[2].prompt and behaviour.EXCLUSION not in behaviour.exclusion_variants(THREE)[1].prompt
    assert [(c[0], c[1]) for c in rule_model.classes_of(codebooks.prompt(THREE))] == [("TAX", 'Texts with "tax".'), ("TAXES", 'Texts with "duty".'), ("OTHER", "The rest.")]
    with pytest.raises(ValueError, match="two classes"):
        behaviour.with_swapped_definitions({**THREE, "classes": THREE["classes"][:1]})


def test_a_model_that_follows_the_codebook_passes(spark):
    got = behaviour.before_evaluation(labelled(spark), THREE, rule_client(), "id", "text")
    rows = {r.test: (r.metric, r.n_total, r.passed) for r in got["summary"].collect()}
    assert rows == {"I_legal_outputs": (1.0, 5, True), "II_definition_recovery": (1.0, 3, True), "III_example_recovery": (1.0, 2, True), "IV_order_invariance": (0.0, 5, True)}
    assert got["order_summary"].first().kappa_degree == "Near-perfect agreement"
    late = behaviour.error_analysis(labelled(spark), THREE, rule_client(), "id", "text", "truth", "tier")
    combos = {r.combo: r.n_correct for r in late["combos"].collect()}
    # text 4 has an elephant of its own, so the rule alone makes it negative; a duty stays a duty
    assert combos == {"normal_doc_normal_cb": 5, "modified_doc_normal_cb": 5, "normal_doc_modified_cb": 4, "modified_doc_modified_cb": 4}
    whole = late["exclusion"].first()
    assert (whole.overall_consistency, whole.all_combos_correct_rate) == (18 / 20, 3 / 5)
    generic, swapped = late["generic"].first(), late["swapped"].first()
    assert (generic.original_accuracy, generic.generic_accuracy, generic.change_rate, generic.f1_difference) == (1.0, 1.0, 0.0, 0.0)
    assert (swapped.follows_definitions_rate, swapped.follows_names_rate, swapped.swapped_accuracy, swapped.relies_on_names) == (1.0, 0.0, 0.0, False)
    drops = {r.condition: (r.accuracy, round(r.accuracy_drop, 9), r.tier1_recall) for r in late["ablation"].collect()}
    assert drops["full"] == drops["no_clarifications"] == (1.0, 0.0, pytest.approx(2 / 3)) and drops["no_label_def"] == (0.6, 0.4, 1.0)


def test_models_that_must_fail(spark):
    texts = labelled(spark)
    biased = behaviour.order_changes(behaviour.classified(texts, behaviour.order_variants(THREE), rule_client("order"), "id", "text"), "id")
    found = behaviour.order_summary(biased, "id").first()
    assert not found.passed and found.change_rate_reversed > 0.05 and found.kappa < 0.8
    words = (("TAX", ("tax",)), ("TAXES", ("duty",)))
    named = behaviour.classified(texts, behaviour.label_variants(THREE), rule_client("names", words=words), "id", "text", "truth")
    assert behaviour.swapped_summary(named, "id", "truth", THREE).first().relies_on_names
    generic = behaviour.generic_summary(named, "id", "truth", "TAX").first()
    assert generic.generic_accuracy < generic.original_accuracy and generic.change_rate > 0
    deaf = behaviour.classified(texts, behaviour.exclusion_variants(THREE), rule_client(obeys_rules=False), "id", "text", "truth")
    combos = {r.combo: r.accuracy for r in behaviour.exclusion_combos(behaviour.exclusion_details(deaf, "id", "truth", "OTHER")).collect()}
    assert combos["normal_doc_normal_cb"] == 1.0 and combos["modified_doc_modified_cb"] == 0.2

    def forgets(request):
        if "Name the label" in request["prompt"]:
            return '{"label": "TAX"}'
        return ["{", '{"label": "UNKNOWN"}', '{"label": "TAX", "measures": []}'][len(request["prompt"]) % 3]

    got = behaviour.before_evaluation(texts, THREE, Client(forgets, tries=1, sleep=no_wait), "id", "text", positive="TAX")
    assert {r.test: r.passed for r in got["summary"].collect()} == {"I_legal_outputs": False, "II_definition_recovery": False, "III_example_recovery": False, "IV_order_invariance": r_passed(got)}
    assert [r.correct for r in got["recovery"].orderBy("kind", "class").collect()].count(True) == 2  # its own definition and example


def r_passed(got):
    return got["order_summary"].first().passed


def test_a_codebook_without_examples_skips_the_third_test(spark):
    bare = {**THREE, "classes": [{k: v for k, v in c.items() if "examples" not in k} for c in THREE["classes"]]}
    found = behaviour.recovered(behaviour.recovery_requests(spark, bare), bare, rule_client())
    rows = {r.test: (r.metric, r.n_total, r.passed) for r in behaviour.recovery_summary(found).collect()}
    assert rows == {"II_definition_recovery": (1.0, 3, True), "III_example_recovery": (1.0, 0, True)}


def test_measures_and_under_listing(spark):
    fine = {"name": "n", "country": "US", "discusses_motivation": True, "discusses_timing": False, "discusses_magnitude": True}
    cases = [("TAX", [fine], True), ("TAX", [], False), ("OTHER", [], True), ("OTHER", [fine], False), ("TAX", [fine | {"country": "FR"}], False), ("TAX", [{"name": "n", "country": "US"}], False), ("TAX", [fine | {"name": ""}], False), (None, [], False)]
    rows = [(i, json.dumps({"label": label, "measures": m})) for i, (label, m, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, reply string").select("id", "reply", replies.parsed(F.col("reply"), behaviour.REPLY).alias("b"))
    got = behaviour.legal_outputs(df.select("id", "reply", F.col("b.label").alias("label"), F.col("b.label").alias("raw_label"), "b.measures"), "id", "TAX")
    assert [r.valid_schema for r in got.orderBy("id").collect()] == [x for *_, x in cases]
    texts = spark.createDataFrame([(1, "The Tax Reform Act of 1986 and The Big Act of 1990", ["tax reform act of 1986", "Lost Act", "The Big Act of 1990, as amended"]), (2, "none", ["A"])], "id int, text string, acts array<string>")
    listed = behaviour.under_listing(behaviour.classified(texts, [behaviour.plain_variant(THREE)], rule_client(), "id", "text", "acts"), "id", "acts")
    assert {r.id: (r.n_expected, r.n_measures, r.n_acts_found, round(r.per_act_recall, 6)) for r in listed.collect()} == {1: (3, 2, 2, 0.666667), 2: (1, 0, 0, 0.0)}


def test_evidence_under_every_order(spark):
    texts = spark.createDataFrame([(1, "even"), (2, "odd"), (3, ""), (4, None)], "id int, text string")
    passages = spark.createDataFrame([(1, "a plain quote"), (2, "")], "id int, text string")
    client = Client(rule_model.ordered_evidence, {"model": "e"}, tries=1, sleep=no_wait)
    got = behaviour.evidence_tests(texts, passages, THREE, client, "id", "text")
    assert {r.id: (r.original, r.reversed, r.changed_reversed) for r in got["order"].collect()} == {1: ("even|TAX", "even|OTHER", True), 2: ("odd|s", "odd|s", False), 3: ("EMPTY", "EMPTY", False), 4: (None, None, False)}
    rows = {r.test: (r.metric, r.n_total, r.passed) for r in got["summary"].collect()}
    assert rows["I_legal_outputs"] == (0.75, 4, False) and rows["II_instruction_recovery"] == (0.5, 2, False) and rows["IV_order_invariance"][:2] == (0.25, 4)
    fine = Client(lambda r: json.dumps({"evidence": [{"quote": "q", "signal": "s"}, {"quote": "a", "signal": "s"}], "enacted_signals": [], "timing_signals": []}), tries=1, sleep=no_wait)
    done = behaviour.evidence_tests(texts.filter("text <> ''"), passages.limit(1), THREE, fine, "id", "text")
    assert all(r.passed for r in done["summary"].collect()) and done["order"].first().original == "a|s||q|s"
    broken = Client(lambda r: "no json", tries=1, sleep=no_wait)
    assert {r.invalid for r in behaviour.evidence_tests(passages, passages, THREE, broken, "id", "text")["legal"].collect()} == {"JSON parse error"}


def test_variants_shuffle_texts_once_and_call_equal_requests_once(spark, tmp_path):
    calls = str(tmp_path)

    def model(request):
        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        return json.dumps({"label": str(len(request["prompt"]))})

    end = "\n\n(elephants.*"
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a" + end), (4, None), (5, "a" + end + end), (6, "b"), (7, "")], "id int, t string").repartition(3)
    variants = [("s", ""), ("s", end), ("u", end)]
    rows = model_calls.answered_variants(df, model_calls.Client(model), "t", variants, lambda t: F.concat(F.lit("say "), t))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
    found = {(r["_text_key"], r.ask): r.reply for r in rows.collect()}
    texts = {t for _, t in df.collect() if t is not None}
    assert found == {(hashlib.sha256(t.encode()).hexdigest(), i): json.dumps({"label": str(len(t + e) + 4)}) for t in texts for i, (_, e) in enumerate(variants)}
    assert len(os.listdir(calls)) == len({(s, t + e) for t in texts for s, e in variants}) < len(found)
