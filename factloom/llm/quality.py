"""Operator 10: text quality by positive-unlabelled learning.

A linear model on hashed byte n-grams (square roots of the counts, normed)
minimises the non-negative unbiased risk of the squared loss: prior * loss on
trusted positives, plus what the loss as negatives of unlabelled texts exceeds
that of the positives' share of them, which isn't let below zero. With this loss
the unlabelled part depends on the texts' first and second moments alone, so
that it is that of all learning texts, summed where they lie. The class prior is
estimated from the unlabelled texts: the share at which the labelled classes'
means mix to theirs, along the direction that parts the classes best. Scores are
calibrated (a logistic curve in the model's output) on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fold, give_back, map_arrow, partitions_for
from factloom.llm.ngrams import hashed_counts

#: Tasks whose sums of one row meet in one group of the first round.
FAN_IN = 256
ORDERS = (1, 2, 3)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def output(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, at: np.ndarray, n: np.ndarray) -> float:
        x = np.sqrt(n / max(n.sum(), 1))
        return float(1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights[at] + self.bias) + self.shift, -40, 40))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Moments:
    """Number, mean and mean of outer products of rows that end with a constant 1."""

    n: int
    mean: np.ndarray
    outer: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        x = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(np.float64)
        return cls(len(x), x.mean(axis=0), x.T @ x / len(x))


def risk(w: np.ndarray, pos: Moments, unl: Moments, prior: float) -> tuple[float, float]:
    """Positive part and negative part (may be below zero) of the unbiased risk of weights, by the loss (1 - y f)^2 / 4."""

    def loss(of: Moments, y: int) -> float:
        return float(w @ of.outer @ w - 2 * y * (of.mean @ w) + 1) / 4

    return prior * loss(pos, 1), loss(unl, -1) - prior * loss(pos, -1)


def fit_pu(pos: Moments, unl: Moments, prior: float, penalty: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights (the last is the bias) of least non-negative risk, with a ridge penalty on all but the bias.

    That risk is the greatest of positive part + t * negative part for t from 0
    to 1. For one t it is quadratic and has one least point; t is 1 if the
    negative part isn't below zero there, and else, by bisection, the greatest t
    of those that keep it from falling below.
    """
    ridge = 2 * penalty * np.eye(len(unl.mean))
    ridge[-1, -1] = 1e-9

    def least(t: float) -> np.ndarray:
        curve = t * unl.outer + prior * (1 - t) * pos.outer
        return np.linalg.solve(curve / 2 + ridge, (prior * (1 + t) * pos.mean - t * unl.mean) / 2)

    w = least(1.0)
    if risk(w, pos, unl, prior)[1] >= 0:
        return w
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if risk(least(mid), pos, unl, prior)[1] >= 0 else (lo, mid)
    return least(lo)


def estimate_prior(pos: Moments, neg: Moments | None, unl: Moments, otherwise: float) -> float:
    """Share of positives among the unlabelled rows; ``otherwise`` where the classes can't be told apart."""
    if neg is not None:
        spread = unl.outer - np.outer(unl.mean, unl.mean)
        apart = (pos.mean - neg.mean)[:-1]
        along = np.linalg.solve(spread[:-1, :-1] + 1e-4 * np.eye(len(apart)), apart)
        if along @ apart > 1e-12:
            otherwise = float(along @ (unl.mean - neg.mean)[:-1] / (along @ apart))
    return min(0.95, max(0.05, otherwise))


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least log loss, by Newton steps; targets are smoothed."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target = np.where(y > 0, hi, lo)
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * z + c)
        h = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-6 * a, (p - target).sum()])
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    return float(max(a, 1e-6)), float(c)


def _matrix(rows: list, bits: int) -> np.ndarray:
    out = np.zeros((len(rows), 1 << bits), np.float32)
    for i, r in enumerate(rows):
        at, n = np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.float32)
        out[i, at] = np.sqrt(n / max(n.sum(), 1))
    return out


def moments_of(texts: DataFrame, bits: int, part_bytes: int) -> Moments | None:
    """Moments of all ``texts`` (text): each task sums its own, rows of the matrix meet by number."""
    size = 1 << bits
    bytes_ = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, total, n = np.zeros((size, size)), np.zeros(size), 0
        x, i = np.zeros((512, size), np.float32), 0
        for b in batches:
            for at, c in hashed_counts(b, bits, ORDERS, False):
                x[i, at] = np.sqrt(c / max(c.sum(), 1))
                i += 1
                if i == len(x):
                    outer, total, n = outer + x.T @ x, total + x.sum(axis=0), n + i
                    x[:], i = 0, 0
        outer, total, n = outer + x.T @ x, total + x.sum(axis=0), n + i
        if n:
            task = TaskContext.get().partitionId()
            rows = [outer[k, k:].tobytes() for k in range(size)] + [total.tobytes(), np.array([n], float).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2, dtype=np.int32)), pa.array([task] * (size + 2), pa.int32()), pa.array(rows, pa.binary())], names=["row", "task", "sums"])
        give_back()

    def summed(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("task").to_numpy())  # the same sum in every run
        total = sum(np.frombuffer(t.column("sums")[i].as_py()) for i in order.tolist())
        return pa.table({"row": t.column("row").slice(0, 1), "task": t.column("task").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    # a task's sums are a matrix, so there are no more tasks than the texts are worth
    parts = texts.coalesce(partitions_for(texts.sparkSession, bytes_, part_bytes)).mapInArrow(add, "row int, task int, sums binary")
    schema = "row int, task int, sums binary"
    # two rounds, so that no group holds a row's sums of all tasks
    some = parts.withColumn("_g", F.floor(F.col("task") / FAN_IN)).groupBy("row", "_g").applyInArrow(lambda t: summed(t.drop_columns(["_g"])), schema)
    # 2^bits rows
    got = {r["row"]: np.frombuffer(bytes(r["sums"])) for r in some.groupBy("row").applyInArrow(summed, schema).collect()}
    if not got:
        return None
    n = int(got[size + 1][0])
    outer = np.zeros((size + 1, size + 1))
    for k in range(size):
        outer[k, k:size] = outer[k:size, k] = got[k]
    outer[:size, size] = outer[size, :size] = got[size]
    outer[size, size] = n
    return Moments(n, outer[size] / n, outer / n)


def learn(
    docs: DataFrame, labels: DataFrame, most: int = 2000, bits: int = 10, part_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> QualityModel | None:
    """A model from at most ``most`` labelled ids, chosen by a hash, and the moments of all ``docs``.

    Labels of one id are one row, the least of them; null labels are none. Of
    rows that repeat these ids, twice ``most`` are taken at most, by a hash.
    None if no labelled row has a document.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("y"))
    drawn = known.orderBy(F.xxhash64("_id", F.lit("labelled")), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        both = [(at.astype(np.int32).tobytes(), n.astype(np.float32).tobytes()) for at, n in hashed_counts(b, bits, ORDERS, False)]
        return pa.RecordBatch.from_arrays([b.column("y"), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["y", "at", "n"])

    # the drawn labels have at most ``most`` rows
    labelled = rows.join(F.broadcast(drawn), "_id").select("_id", "text", F.col("y").cast("int").alias("y"))
    labelled = labelled.orderBy(F.xxhash64("_id", "text"), "_id").limit(2 * most).select("text", "y")
    labelled = map_arrow(labelled, counted, "y int, at binary, n binary").collect()
    if not labelled:
        return None
    labelled.sort(key=lambda r: (bytes(r["at"]), bytes(r["n"]), r["y"]))
    y = np.array([r["y"] for r in labelled])
    x = _matrix(labelled, bits)
    unl = moments_of(rows.select("text"), bits, part_bytes)
    pos = Moments.of(x[y > 0] if (y > 0).any() else x)
    prior = estimate_prior(pos, Moments.of(x[y == 0]) if 0 < (y > 0).sum() < len(y) else None, unl, (y.sum() + 1) / (len(y) + 2))
    w = fit_pu(pos, unl, prior)
    slope, shift = calibrate(x @ w[:-1] + w[-1], y)
    return QualityModel(w[:-1], float(w[-1]), slope, shift, bits)


def predict(docs: DataFrame, model: QualityModel | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on; columns of these names are replaced); null texts count as empty. Without a model: 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        if m is None or not len(texts):
            return pd.Series([0.5] * len(texts), dtype="float64")
        out = []
        for lo in range(0, len(texts), 256):  # copies of few texts at a time
            batch = pa.RecordBatch.from_arrays([pa.array(list(texts.iloc[lo : lo + 256]), pa.string())], names=["text"])
            out += [m.score(at, n) for at, n in hashed_counts(batch, m.bits, ORDERS, False)]
        give_back()
        return pd.Series(out)

    scored = docs.withColumn("score", score(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Learns from documents and labels of the other folds. Repeated rows are
    scored each, a null id is in the fold of the empty text, other columns are
    not carried; an empty table gives no rows. A very long text is read whole by
    one task, which takes some ten times its size.
    """
    out = fold(doc_id, folds) == held
    model = learn(docs.filter(~out), labels.filter(~out), doc_id=doc_id, text=text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text).cast("string").alias("text"))
    return predict(rows, model, threshold).select("doc_id", "held_out", "score", "predicted")
