"""Replies of models as typed rows: parsing, validation and repair.

The call itself is a parameter: any function from a prompt to a reply text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs and degrees of confidence that a reply may name.
SIGNS = ("increase", "decrease", "no_change")
CONFIDENCE = ("low", "medium", "high")
#: Signs as they are written in tables.
SIGN_MARKS = {"increase": "+", "decrease": "-", "no_change": "0"}

QUOTES = "array<struct<quote:string,signal:string>>"
EVIDENCE = f"evidence {QUOTES}, enacted_signals {QUOTES}, timing_signals {QUOTES}"
VERDICT = "label string, enacted boolean, sign string, confidence string, reasoning string"
ASSIGNMENTS = "array<struct<id:string,cluster:string>>"


def json_body(reply: Column) -> Column:
    """The JSON of a reply: what stands in its first fenced block, else the whole reply, trimmed."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*\n(.+?)\n\s*```", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(reply))


def parsed(reply: Column, schema: str) -> Column:
    """The reply as a struct; null if it is no JSON. Fields of another type are null."""
    body = json_body(reply)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def _first_of(rules: list[tuple[Column, Column]]) -> Column:
    """Reason of the first rule that is broken, null if all hold."""
    out = F.when(rules[0][0], rules[0][1])
    for broken, why in rules[1:]:
        out = out.when(broken, why)
    return out


def evidence_reason(body: Column) -> Column:
    """Why a reply of evidence is not valid, null if it is; fields and entries are tried in order."""
    rules = [(body.isNull(), F.lit("JSON parse error"))]
    for field in ("evidence", "enacted_signals", "timing_signals"):
        items = body[field]
        rules.append((items.isNull(), F.lit(f"Missing or non-list '{field}' field")))
        lacks = F.transform(items, lambda x: x["quote"].isNull() | x["signal"].isNull())
        at = F.array_position(lacks, F.lit(True)).cast("int")
        part = F.when(F.get(items, at - 1)["quote"].isNull(), "quote").otherwise("signal")
        rules.append((at > 0, F.format_string(f"{field}[%d]: missing or non-character '%s'", at, part)))
    return _first_of(rules)


def verdict_reason(body: Column, labels: list[str] | None = None) -> Column:
    """Why a verdict is not valid, null if it is. Without ``labels`` any label that is not empty holds."""
    rules = [(body.isNull(), F.lit("JSON parse error")), (F.coalesce(body["label"], F.lit("")) == "", F.lit("Invalid 'label' field"))]
    if labels is not None:
        rules.append((~body["label"].isin(labels), F.lit("Invalid 'label' field")))
    rules.append((body["enacted"].isNull(), F.lit("Missing or non-logical 'enacted' field")))
    rules.append((~F.coalesce(body["sign"].isin(*SIGNS), F.lit(False)), F.lit("Invalid 'sign' field")))
    rules.append((~F.coalesce(body["confidence"].isin(*CONFIDENCE), F.lit(False)), F.lit("Invalid 'confidence' field")))
    rules.append((body["reasoning"].isNull(), F.lit("Missing or non-character 'reasoning' field")))
    return _first_of(rules)


def sign_mark(sign: Column) -> Column:
    """P09: '+', '-' or '0'; null for anything else."""
    return F.create_map(*[F.lit(x) for pair in SIGN_MARKS.items() for x in pair])[sign]


def graceful_verdict(body: Column, labels: list[str]) -> dict[str, Column]:
    """Label, sign and raw sign of a verdict; a sign out of range alone leaves the label standing."""
    why = verdict_reason(body, labels)
    keep = why.isNull() | (why == "Invalid 'sign' field")
    return {"pred_label": F.when(keep, body["label"]), "pred_sign": F.when(why.isNull(), sign_mark(body["sign"])), "pred_sign_raw": body["sign"]}


def repaired_clusters(names: DataFrame, answers: DataFrame, by: str, key: str, cluster: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Assignments of a model made whole, and a row of counts for each group.

    ``names`` has all keys of each group; ``answers`` (group, key as text,
    cluster, order) what the model said. Keys that are no integers are dropped,
    of repeated keys the first answer counts, unknown keys are dropped, and
    missing keys become clusters of their own. Cluster ids are the places of
    the names of clusters in order within the group.
    """
    given = answers.withColumn(key, F.col(key).try_cast("long")).filter(F.col(key).isNotNull() & F.col(cluster).isNotNull())
    once = given.groupBy(by, key).agg(F.min_by(cluster, order).alias("_raw"))
    whole = names.select(by, key).join(once, [by, key], "left").withColumn("_known", F.col("_raw").isNotNull())
    raw = F.coalesce("_raw", F.concat(F.lit("__singleton_"), F.col(key).cast("string")))
    ids = F.dense_rank().over(Window.partitionBy(by).orderBy(raw))
    clusters = whole.select(by, key, ids.alias("cluster_id"), F.count(F.lit(1)).over(Window.partitionBy(by, raw)).alias("n_members"))
    expected = whole.groupBy(by).agg(F.count(F.lit(1)).alias("n_expected"), F.count_if(~F.col("_known")).alias("n_missing"))
    extra = once.join(names.select(by, key), [by, key], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("n_extra"))
    returned = once.groupBy(by).agg(F.count(F.lit(1)).alias("n_returned"))
    integrity = expected.join(returned, by, "left").join(extra, by, "left").na.fill(0, ["n_returned", "n_extra"])
    return clusters, integrity


def flattened_acts(batches: DataFrame, acts: str, *keep: str) -> DataFrame:
    """A row for each act of a batch: passages joined, pages distinct and sorted, mean confidence (0.9 if none)."""
    a = batches.select(*keep, F.explode(acts).alias("_a"))
    said = F.filter(F.transform("_a.passages", lambda p: p["confidence"]), lambda c: c.isNotNull())
    mean = F.try_divide(F.aggregate(said, F.lit(0.0), lambda s, c: s + c), F.size(said))
    return a.select(
        *keep, F.col("_a.act_name").alias("act_name"), F.col("_a.year").alias("year"),
        F.array_join(F.transform("_a.passages", lambda p: p["text"]), "\n\n---\n\n").alias("passages_text"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_a.passages", lambda p: p["pages"])))).alias("pages"),
        F.coalesce(mean, F.lit(0.9)).alias("confidence"),
    )


def sign_metrics(rows: DataFrame, predicted: str, actual: str, called: str, exogenous: str) -> DataFrame:
    """Among truly exogenous rows the share of right signs, and of right signs called exogenous.

    A null or UNCLEAR sign is wrong; without such rows both are null.
    """
    right = F.coalesce((F.col(predicted) != "UNCLEAR") & (F.col(predicted) == F.col(actual)), F.lit(False))
    true_ones = rows.filter(F.col(exogenous).eqNullSafe(True))
    return true_ones.agg(
        F.count(F.lit(1)).alias("n_true_exogenous"), F.avg(right.cast("double")).alias("sign_accuracy"),
        F.avg((right & F.col(called).eqNullSafe(True)).cast("double")).alias("signed_precision"),
    )


def ask(rows: DataFrame, prompt: str, call: Callable[[str], str], tries: int = 3) -> DataFrame:
    """The row with the model's reply and error; a call that keeps failing gives a null reply, never an exception.

    ``call`` is shipped to the executors; each batch of rows is asked where it lies.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, "no prompt"
        why = None
        for _ in range(tries):
            try:
                return call(text), None
            except Exception as e:  # noqa: BLE001
                why = str(e)
        return None, why

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [one(x) for x in f[prompt]]
            yield f.assign(reply=[r for r, _ in said], error=[e for _, e in said])

    return rows.mapInPandas(batch, schema)
