"""Vectors reduced to their principal axes, and density clusters of the reduced ones.

The axes are those of a principal component analysis, fitted by second moments:
a stated substitute for a stochastic reduction that no two runs repeat. Each
task sums its own rows; the driver gets one matrix of the vectors' dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.density import density_grid
from factloom.operators.vectors import unit

#: Tasks whose sums meet in one group of the first round.
FAN_IN = 64
#: Dimension up to which the driver takes the moments' matrix.
WIDEST = 8192


def second_moments(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of the vectors; they are of one length and hold no nulls."""
    size, least = rows.agg(F.max(F.size(vector)), F.min(F.size(vector))).first()
    if size is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    if size != least or size > WIDEST:
        raise ValueError(f"vectors of one length up to {WIDEST} are needed, there are lengths {least} to {size}")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        if total[size, size]:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array([task] * (size + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["row", "task", "sums"])

    def summed(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("task").to_numpy(), kind="stable")  # the same sum in every run
        out = sum(np.frombuffer(t.column("sums")[i].as_py()) for i in order.tolist())
        return pa.table({"row": t.column("row").slice(0, 1), "task": t.column("task").slice(0, 1), "sums": pa.array([out.tobytes()], pa.binary())})

    schema = "row int, task int, sums binary"
    parts = rows.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(add, schema)
    # two rounds, so that no group holds the sums of all tasks
    first = parts.withColumn("_g", F.floor(F.col("task") / FAN_IN)).groupBy("row", "_g").applyInArrow(lambda t: summed(t.drop_columns(["_g"])), schema)
    got = {r["row"]: np.frombuffer(bytes(r["sums"])) for r in first.groupBy("row").applyInArrow(summed, schema).collect()}
    whole = np.array([got[i] for i in range(size + 1)])
    return int(round(whole[size, size])), whole[size, :size], whole[:size, :size]


def principal_axes(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean, the first ``k`` axes as columns and the variances along all axes, greatest first; of each axis the greatest component is above 0."""
    n, total, outer = second_moments(rows, vector)
    if n < 2:
        return total, np.eye(len(total))[:, :k], np.zeros(len(total))
    mean = total / n
    spread, axes = np.linalg.eigh((outer - n * np.outer(mean, mean)) / (n - 1))
    axes, spread = axes[:, ::-1], np.maximum(spread[::-1], 0.0)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(axes))] < 0, -1.0, 1.0)
    return mean, axes[:, :k], spread


def reduced(rows: DataFrame, vector: str, k: int, normalise: bool = True) -> DataFrame:
    """The rows with ``vector`` as its ``k`` principal coordinates, of unit vectors with ``normalise``. Null vectors and those holding nulls are left out."""
    whole = rows.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    whole = whole.withColumn(vector, unit(F.col(vector)) if normalise else F.col(vector).cast("array<double>"))
    mean, axes, _ = principal_axes(whole, vector, k)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def placed(v: pd.Series) -> pd.Series:
        return pd.Series(((np.array(v.tolist()) - mean) @ axes).tolist()) if len(v) else pd.Series([], dtype=object)

    return whole.withColumn(vector, placed(F.col(vector)))


def reduced_grid(rows: DataFrame, key: str, vector: str, dimensions: list[int], sizes: list[int], windows: list[int | None], year: str | None = None, **how) -> DataFrame:
    """Density clusters by Euclidean distance of the vectors reduced to each number of dimensions, for each smallest size and year window."""
    out = None
    for k in dimensions:
        part = density_grid(reduced(rows, vector, k), key, vector, sizes, windows, year, measure="euclidean", **how).withColumn("dimensions", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
