"""Operator 7: consistent-hash sharding with virtual nodes and bounded loads.

DataFrame functions only. The ring has ``cells`` equal cells; a key's cell and
its order within it come from its 64-bit hash. Every shard has ``vnodes``
virtual nodes on the ring and takes the keys up to each of them clockwise. A
shard takes rows up to its bound; what is over goes on to the next virtual node.
Which rows go on depends on the counts of the cells alone, so that the driver
settles it for ranges of ranks (a table bounded by cells and virtual nodes,
whatever the corpus has), and rows look up the range that their rank is in.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A row that occurs more often than this is dealt to several tasks.
COPIES = 8192


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's nodes don't depend on the number of shards."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at, k = zlib.crc32(f"{s}/{v}".encode()) * cells >> 32, 0
            while at in taken:
                k += 1
                at = zlib.crc32(f"{s}/{v}/{k}".encode()) * cells >> 32
            taken[at] = s
    return sorted(taken.items())


def bounds(n: int, shards: int, epsilon: float) -> list[int]:
    """Rows that each shard takes at most: (1 + epsilon) times the mean; with 0, counts at most one apart."""
    if epsilon <= 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [int(-(-n * (1 + epsilon) // shards))] * shards


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], cells: int, limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (cell, rank_lo, rank_hi, shard, first_slot) after overflow has gone clockwise."""
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    v = 0
    for cell in sorted(counts):
        while v < len(nodes) and nodes[v][0] < cell:
            v += 1
        waiting[v % len(nodes)].append((cell, 0, counts[cell]))
    load = [0] * len(limit)
    plan = []
    while any(waiting):
        passed: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for i, (_, shard) in enumerate(nodes):
            for cell, lo, hi in waiting[i]:
                took = min(hi - lo, limit[shard] - load[shard])
                if took:
                    plan.append((cell, lo, lo + took, shard, load[shard]))
                    load[shard] += took
                if took < hi - lo:
                    passed[(i + 1) % len(nodes)].append((cell, lo + took, hi))
        waiting = passed
    return plan


def assign_shards(rows: DataFrame, columns: list[str], shards: int = 8, vnodes: int = 128, epsilon: float = 0.0, cells: int = 1 << 14) -> DataFrame:
    """``columns`` of every row, its shard and its slot there (from 0, without gaps).

    The columns together are the key; equal rows count one by one, wherever
    they are, and the same rows give the same result. Null values take part
    like any other; other columns are not carried; an empty table gives no
    rows. With epsilon 0 the shards' counts are at most one apart.
    """
    spark = rows.sparkSession
    if cells < 4 * shards * vnodes:
        raise ValueError("the ring needs at least four cells for each virtual node")
    h = F.xxhash64(*columns)
    # one row for each distinct row and count of copies: a key with a third of all rows is a number here
    distinct = rows.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    placed = distinct.select("*", h.alias("_h"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(cells)).cast("int").alias("_cell"))
    counts = {r["_cell"]: int(r["n"]) for r in placed.groupBy("_cell").agg(F.sum("_copies").alias("n")).collect()}
    plan = settle(counts, ring(shards, vnodes, cells), cells, bounds(sum(counts.values()), shards, epsilon))
    table = spark.createDataFrame(plan or [], "_at int, _lo long, _hi long, shard int, _slot long")
    order = Window.partitionBy("_cell").orderBy("_h", *columns).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_to", F.sum("_copies").over(order)).withColumn("_from", F.col("_to") - F.col("_copies"))
    begin = F.greatest("_from", "_lo")
    # bounded by cells and virtual nodes
    met = ranked.join(F.broadcast(table), (F.col("_cell") == F.col("_at")) & (F.col("_from") < F.col("_hi")) & (F.col("_to") > F.col("_lo"))).select(
        *columns, "shard", (F.col("_slot") + begin - F.col("_lo")).alias("_first"), (F.least("_to", "_hi") - begin).alias("_n")
    )
    parts = met.select(*columns, "shard", "_first", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))).alias("_part"))
    slots = F.sequence(F.col("_first") + F.col("_part"), F.col("_first") + F.least(F.col("_part") + COPIES, F.col("_n")) - 1)
    return parts.repartition("shard", (F.col("_first") + F.col("_part"))).select(*columns, "shard", F.explode(slots).alias("slot"))
