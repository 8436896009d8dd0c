"""Operator 9: exact top-k inner product search by ball trees.

Candidates are dealt into shards and queries into blocks of bounded size; each
pair of a shard and a block is one group. A shard's vectors form a ball tree.
The bound of a node for a query is q.c + |q| r; of two children the one with
the higher bound goes first, for each query, and a node is left when its bound
is under the query's kth score. Every query first searches one shard; its kth
score there goes with it to the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import partitions_for, written

LEAF = 128


class BallTree:
    """Balls over the rows of a matrix; leaves have at most ``LEAF`` rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.ids = x.copy(), ids.copy()
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        if len(x):
            self._build(0, len(x))

    def _build(self, lo: int, hi: int) -> int:
        part = self.x[lo:hi]
        c = part.mean(axis=0)
        d = np.sqrt(((part - c) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append((c, float(d.max()), lo, hi, -1, -1))
        if hi - lo > LEAF:
            a = part[d.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            order = np.argsort(part @ (b - a), kind="stable")
            self.x[lo:hi], self.ids[lo:hi] = part[order], self.ids[lo:hi][order]
            mid = (lo + hi) // 2
            left = self._build(lo, mid)
            right = self._build(mid, hi)
            self.nodes[me] = (c, self.nodes[me][1], lo, hi, left, right)
        return me

    def bound(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        c, r = self.nodes[node][:2]
        slack = 1e-9 * norm * (np.sqrt((c**2).sum()) + r) + 1e-6
        return q @ c + norm * r + slack


class TopK:
    """The best ``k`` (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int, kth: np.ndarray) -> None:
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.shared = kth

    def kth(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[at, -1], self.shared[at])

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score.max(axis=1) >= self.kth(at)
        at, score = at[good], score[good]
        if not len(at):
            return
        s = np.concatenate([self.score[at], score], axis=1)
        i = np.concatenate([self.id[at], np.broadcast_to(ids, score.shape)], axis=1)
        i = np.where(np.isneginf(s), np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at] = np.take_along_axis(s, order, 1)
        self.id[at] = np.take_along_axis(i, order, 1)


def search(tree: BallTree, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> TopK:
    """Top k of the tree for each query row, without rows that have its own id."""
    best = TopK(len(q), k, kth)
    norm = np.sqrt((q**2).sum(axis=1))

    def visit(node: int, at: np.ndarray) -> None:
        if not len(at):
            return
        _, _, lo, hi, left, right = tree.nodes[node]
        if left < 0:
            s = q[at] @ tree.x[lo:hi].T
            s[own[at][:, None] == tree.ids[None, lo:hi]] = -np.inf
            best.add(at, s, tree.ids[lo:hi])
            return
        bl, br = tree.bound(left, q[at], norm[at]), tree.bound(right, q[at], norm[at])
        first = bl >= br
        for child, who, b in ((left, first, bl), (right, ~first, br), (left, ~first, bl), (right, first, br)):
            here = who & (b >= best.kth(at))
            visit(child, at[here])

    if tree.nodes:
        visit(0, np.arange(len(q)))
    return best


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    col = t.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 1))


def _group(k: int):
    def run(cand: pa.Table, quer: pa.Table) -> pa.Table:
        q, x = _matrix(quer, "v"), _matrix(cand, "v")
        own, found = quer.column("query_id").to_numpy(), []
        if len(q) and len(x):
            if max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * q.shape[1] >= 2**53:
                raise OverflowError("scores don't fit the exact range of double arithmetic (2^53)")
            best = search(BallTree(x, cand.column("vec_id").to_numpy()), q, own, k, quer.column("kth").to_numpy())
            row, col = np.nonzero(~np.isneginf(best.score))
            found = [quer.column("_q").take(pa.array(row)), pa.array(own[row]), pa.array(best.id[row, col]), pa.array(best.score[row, col].astype(np.int64))]
        else:
            found = [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())]
        return pa.Table.from_arrays(found, names=["_q", "query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, per_shard: int = 16_384, per_block: int = 2_048, id_col: str = "vec_id", vector: str = "v"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query.

    ``vector`` holds whole numbers as array<double>; both tables may have any
    number of rows. A query meets the vectors of its own dimension that have
    another id; equal query rows count once; repeated vectors count each. Rows
    with a null id or vector take no part. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    here = F.col(vector)
    cand = vectors.filter(F.col(id_col).isNotNull() & here.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), here.alias("v"), F.size(here).alias("dim"))
    quer = queries.filter(F.col(id_col).isNotNull() & here.isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), here.alias("v"), F.size(here).alias("dim"))
    quer = quer.withColumn("_q", F.concat_ws(":", "query_id", F.md5(F.to_json(F.struct("v"))))).dropDuplicates(["_q"])
    shards, blocks = partitions_for(spark, cand.count(), per_shard), partitions_for(spark, quer.count(), per_block)
    cand = cand.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    quer = quer.withColumn("block", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int"))
    schema = "_q string, query_id long, vec_id long, score long"
    key = ["dim", "shard", "block"]

    def searched(c: DataFrame, q: DataFrame) -> DataFrame:
        """Blocks of queries against shards; c: with the block column, q: with the shard column."""
        return c.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_group(k), schema)

    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    near = quer.withColumn("shard", home).withColumn("kth", F.lit(float("-inf")))
    with_blocks = cand.select("*", all_blocks)
    first = written(searched(with_blocks.filter(F.col("shard") == home), near), "topk-first")
    found = first
    if shards > 1:
        kth = first.groupBy("_q").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("s"))
        bound = kth.select("_q", F.when(F.col("n") >= k, F.col("s")).otherwise(float("-inf")).alias("kth"))
        far = quer.join(bound, "_q", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        far = far.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).filter(F.col("shard") != home)
        found = first.unionByName(searched(with_blocks.filter(F.col("shard") != home), far))
    w = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows whose vector has neither null nor non-finite components, with ``v``: floor(scale * x) of each."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("double"))
    return df.filter(F.col(vector).isNotNull()).filter(fine).withColumn("v", v)
