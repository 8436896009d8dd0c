"""Self-consistency: several replies of a model to one request, and what they agree on.

Replies are rows of an item and a sample; a reply that failed or cannot be read
stays as a row without an answer, so that the number of samples is known.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import normalize_name
from factloom.operators import metrics
from factloom.operators.model_calls import Client, answered
from factloom.operators.replies import json_body
from factloom.operators.shaping import apart

#: Motivations that are exogenous.
EXOGENOUS = ("Long-run", "Deficit-driven")
#: Fixed value: how many samples a request gets.
SAMPLES = 5

DETECTION = "contains_act string, act_name string, reasoning string"
MOTIVATION = "motivation string, reasoning string, review_reason string, needs_expert_review boolean, evidence array<string>"
CHANGE = "struct<timing_quarter:string,magnitude_billions:double,present_value_quarter:string,present_value_billions:double,confidence:double,source:string>"
CHANGES = f"changes array<{CHANGE}>, reasoning string"
EXTRACTION = "acts array<struct<act_name:string,year:int,passages:array<string>,reasoning:string>>"


def few_shot_prompt(instructions: str, examples: list[dict], text: Column) -> Column:
    """The prompt of one text: instructions, examples of input and output, then the text as the task."""
    shown = [f"Example {n}:\nInput:\n{x['input']}\n\nOutput:\n{json.dumps(x['output'], indent=2, ensure_ascii=False)}\n\n" for n, x in enumerate(examples, 1)]
    head = f"{instructions}\n\n" + (f"# Examples\n\n{''.join(shown)}" if shown else "")
    return F.concat(F.lit(f"{head}# Your Task\n\nNow analyze this passage:\n\nInput:\n"), text, F.lit("\n\nOutput:\n"))


def act_request(name: Column, passages: Column, task: str, year: Column | None = None, date: Column | None = None, context: Column | None = None) -> Column:
    """The text of a request about one act: its name, year or date of signing, context of the economy and passages.

    A null or empty context is left out; other nulls are empty.
    """
    def line(title: str, value: Column) -> Column:
        return F.concat(F.lit(f"{title}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"))

    parts = [line("ACT", name)]
    if year is not None:
        parts.append(line("YEAR", year))
    if date is not None:
        parts.append(line("DATE SIGNED", date))
    if context is not None:
        parts.append(F.when(F.length(context) > 0, F.concat(F.lit("\n"), line("ECONOMIC CONTEXT", context))).otherwise(""))
    return F.concat(*parts, F.lit("\nPASSAGES FROM ORIGINAL SOURCES:\n"), F.coalesce(passages, F.lit("")), F.lit(f"\n\n{task}"))


def sampled(rows: DataFrame, client: Client, prompt: str = "prompt", samples: int = SAMPLES, system: str | None = None) -> DataFrame:
    """Each row with each of its ``samples`` replies: ``sample`` from 1, ``reply``, ``error``, ``n_calls``."""
    each = rows.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return answered(each, client, prompt, system, sample="sample")


def read_replies(replies: DataFrame, schema: str, reply: str = "reply", *keep: str) -> DataFrame:
    """The replies as a struct ``body``; null for no reply and for what is no JSON object."""
    body = json_body(F.col(reply))
    is_object = F.try_parse_json(body).isNotNull() & F.startswith(F.ltrim(body), F.lit("{"))
    return replies.select(*keep, F.when(is_object, F.from_json(body, schema, {"mode": "PERMISSIVE"})).alias("body"))


def vote(rows: DataFrame, by: str, sample: str, answer: str) -> DataFrame:
    """For each item the most frequent answer (the first in order on ties), its share of the samples that have one, and both numbers of samples.

    Without any answer the vote is null and its agreement 0.
    """
    counts = rows.groupBy(by).agg(F.countDistinct(sample).alias("n_samples"), F.count(answer).alias("n_valid"))
    won = metrics.majority(rows, [by], answer)
    return counts.join(won, by, "left").select(by, F.col("majority").alias("prediction"), F.coalesce("agreement", F.lit(0.0)).alias("agreement_rate"), "n_samples", "n_valid")


def _first_by(sample: str, value: Column, holds: Column) -> Column:
    """The value of the first sample where it holds."""
    return F.min_by(F.when(holds, value), F.when(holds, F.col(sample)))


def detected(bodies: DataFrame, by: str, sample: str) -> DataFrame:
    """Detection of acts: whether a passage has one by vote, the most frequent name and the first reasoning.

    ``contains_act`` is text, as models write true, "true" or "TRUE"; any other is no answer.
    """
    said = F.lower("body.contains_act")
    rows = bodies.select(by, sample, F.when(said.isin("true", "false"), said).alias("answer"), "body")
    names = metrics.majority(rows.select(by, F.col("body.act_name").alias("name")), [by], "name").select(by, F.col("majority").alias("act_name"))
    why = rows.groupBy(by).agg(_first_by(sample, F.col("body.reasoning"), F.col("body.reasoning").isNotNull()).alias("reasoning"))
    won = vote(rows, by, sample, "answer").withColumn("contains_act", F.col("prediction") == "true").drop("prediction")
    return won.join(names, by, "left").join(why, by).select(by, "contains_act", "act_name", "agreement_rate", "reasoning", "n_samples", "n_valid")


def motivated(bodies: DataFrame, by: str, sample: str) -> DataFrame:
    """Motivation by vote, exogenous or not by that, whether any sample asks for review and its first reason, first evidence and reasoning."""
    rows = bodies.select(by, sample, F.col("body.motivation").alias("answer"), "body")
    body = F.col("body")
    flags = rows.groupBy(by).agg(
        F.coalesce(F.bool_or(body["needs_expert_review"]), F.lit(False)).alias("needs_expert_review"),
        _first_by(sample, body["review_reason"], F.length(body["review_reason"]) > 0).alias("review_reason"),
        F.coalesce(_first_by(sample, body["evidence"], F.size(body["evidence"]) > 0), F.array().cast("array<string>")).alias("evidence"),
        _first_by(sample, body["reasoning"], body["reasoning"].isNotNull()).alias("reasoning"),
    )
    won = vote(rows, by, sample, "answer").withColumnRenamed("prediction", "motivation").withColumn("exogenous", F.col("motivation").isin(*EXOGENOUS))
    return won.join(flags, by).select(by, "motivation", "exogenous", "agreement_rate", "needs_expert_review", "review_reason", "evidence", "reasoning", "n_samples", "n_valid")


def agreed_changes(bodies: DataFrame, by: str, sample: str) -> DataFrame:
    """Changes by quarter: medians of both amounts, first quarter of the present value and first source (by sample and place), mean confidence, and how many changes say so."""
    rows = bodies.select(by, sample, F.posexplode("body.changes").alias("_at", "c")).filter("c.timing_quarter IS NOT NULL")
    place = F.struct(F.col(sample), F.col("_at"))

    def first(c: Column) -> Column:
        return F.min_by(c, F.when(c.isNotNull(), place))

    return rows.groupBy(by, F.col("c.timing_quarter").alias("timing_quarter")).agg(
        F.median("c.magnitude_billions").alias("magnitude_billions"), first(F.col("c.present_value_quarter")).alias("present_value_quarter"),
        F.median("c.present_value_billions").alias("present_value_billions"), F.avg("c.confidence").alias("confidence"), first(F.col("c.source")).alias("source"),
        F.count(F.lit(1)).alias("n_samples_agree"),
    )


def _apart(threshold: float):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def kept(lists: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else [x[i] for i in apart(list(x), threshold)] for x in lists], dtype=object)

    return kept


def agreed_acts(bodies: DataFrame, by: str, sample: str, share: float = 0.5, near: float = 0.8) -> DataFrame:
    """Extracted acts that enough valid samples name: votes, agreement, name, year, passages and first reasoning.

    A sample is valid if its reply is a JSON object, even without acts. Acts are
    one if their normalised names (P05) are; every mention is a vote, and
    max(1, floor(share * valid samples)) are enough. Name and year are the most
    frequent (first in order on ties), passages (texts, or objects with a text)
    those that are not near another one (C10). Acts without a name are left out.
    """
    valid = bodies.filter("body IS NOT NULL")
    n = valid.groupBy(by).agg(F.countDistinct(sample).alias("n_valid"))
    acts = valid.select(by, sample, F.posexplode("body.acts").alias("_at", "a")).filter(F.length("a.act_name") > 0)
    acts = acts.withColumn("_name", normalize_name(F.col("a.act_name"))).withColumn("_place", F.struct(sample, "_at"))
    texts = F.transform(F.filter("a.passages", lambda p: p.isNotNull()), lambda p: F.coalesce(F.when(F.startswith(p, F.lit("{")), F.get_json_object(p, "$.text")), p))
    why = F.col("a.reasoning")
    merged = acts.groupBy(by, "_name").agg(
        F.count(F.lit(1)).alias("votes"), F.mode("a.act_name", True).alias("act_name"), F.mode("a.year", True).alias("year"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_place", texts.alias("texts")))), lambda x: x["texts"])).alias("_texts"),
        F.min_by(F.when(F.length(why) > 0, why), F.when(F.length(why) > 0, F.col("_place"))).alias("reasoning"),
    )
    kept = merged.join(n, by).filter(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("n_valid") * share)))
    rate = F.col("votes") / F.col("n_valid")
    return kept.select(by, "act_name", "year", _apart(near)(F.col("_texts")).alias("passages"), "reasoning", "votes", "n_valid", rate.alias("agreement_rate"))


def extraction_agreement(bodies: DataFrame, agreed: DataFrame, by: str, sample: str, share: float = 0.5) -> DataFrame:
    """For each item whether no act was agreed on, and how far its samples agree: the mean over its acts, or, without one, the share of samples without acts (0 if too few)."""
    none = F.coalesce(F.size("body.acts") <= 0, F.lit(True))
    counts = bodies.groupBy(by).agg(F.countDistinct(sample).alias("n_samples"), F.count("body").alias("n_valid"), F.count_if(none).alias("_none"))
    acts = agreed.groupBy(by).agg(F.count(F.lit(1)).alias("n_acts"), F.avg("agreement_rate").alias("_mean"))
    met = counts.join(acts, by, "left")
    enough = F.col("_none") >= F.greatest(F.lit(1), F.floor(F.col("n_valid") * share))
    rate = F.coalesce("_mean", F.when(enough, F.try_divide(F.col("_none").cast("double"), F.col("n_valid").cast("double"))), F.lit(0.0))
    return met.select(by, F.col("n_acts").isNull().alias("no_acts_found"), F.coalesce("n_acts", F.lit(0)).alias("n_acts"), "n_samples", "n_valid", rate.alias("agreement_rate"))
