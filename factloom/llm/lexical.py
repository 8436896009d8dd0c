"""Operator 13: ranked lexical search over inverted treaps.

Documents are dealt into shards of about ``SHARD`` bytes of text. In a shard
each term has a treap of its postings: in search order by document, in heap
order by impact, so that the root of any subtree has its greatest impact. A
query goes through the treaps of its terms at once, over ranges of documents,
the range with the greatest bound first: the bound is the sum of the weighted
impacts of the roots, and a range whose bound cannot enter the best k is left
with all its subtrees. The best k of a task's earlier shards count in its later
ones. Small ranges are added up posting by posting.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import give_back, partitions_for, written
from factloom.llm.terms import DIGIT_TABLE, plain

#: Bytes of texts of a shard; a longer text is a shard of its own.
SHARD = 32 << 20
#: Ranges of at most so many documents are added up posting by posting.
RANGE = 512
#: Pairs of an item and a term that go to every task at a time.
PAIRS = 500_000

_SHARD = pa.schema([
    ("docs", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("place", pa.binary()), ("tf", pa.binary()),
    ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])
_SHARD_DDL = "docs array<long>, lengths binary, terms array<int>, df array<int>, place binary, tf binary, n_docs long, n_terms long"


@F.pandas_udf(T.ArrayType(T.StringType()))
def distinct_terms(texts: pd.Series) -> pd.Series:
    """The distinct terms of each text, in order."""
    return pd.Series([sorted(t.decode() for t in set(plain(x, DIGIT_TABLE).split())) for x in texts], dtype=object)


def _gatherer(vocabulary: list[str]):
    """Shards of postings of the vocabulary: for each term (its number) the places of its documents, by id, and its occurrences there."""

    def shard(docs: list[int | None], lengths: list[int], ids: list[list[int]], tfs: list[list[int]]) -> pa.RecordBatch:
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i] or 0))
        term = np.array([t for i in order for t in ids[i]], np.int32)
        tf = np.array([c for i in order for c in tfs[i]], np.int64)
        place = np.repeat(np.arange(len(order), dtype=np.int32), [len(ids[i]) for i in order])
        by_term = np.argsort(term, kind="stable")
        terms, df = np.unique(term, return_counts=True)
        n = np.array([lengths[i] for i in order], np.int64)
        values = [
            [[docs[i] for i in order]], [n.tobytes()], [terms], [df.astype(np.int32)], [place[by_term].tobytes()], [tf[by_term].tobytes()],
            [int((n > 0).sum())], [int(n.sum())],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SHARD)], schema=_SHARD)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): i for i, t in enumerate(vocabulary)}
        docs, lengths, ids, tfs, filled = [], [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                body = plain(text.as_py(), DIGIT_TABLE)
                if filled and filled + len(body) > SHARD:
                    yield shard(docs, lengths, ids, tfs)
                    docs, lengths, ids, tfs, filled = [], [], [], [], 0
                filled += len(body) + 1
                words = body.split()
                counts = Counter(words)
                known = [(number[t], c) for t, c in counts.items() if t in number]
                docs.append(doc)
                lengths.append(len(words))
                ids.append([t for t, _ in known])
                tfs.append([c for _, c in known])
        if docs:
            yield shard(docs, lengths, ids, tfs)
        give_back()

    return gather


def heap_children(impact: list[int]) -> tuple[list[int], list[int], int]:
    """Left and right children and the root of the treap of postings in order of documents: of equal impacts the earlier is above."""
    left, right, path = [-1] * len(impact), [-1] * len(impact), []
    for i, x in enumerate(impact):
        below = -1
        while path and impact[path[-1]] < x:
            below = path.pop()
        left[i] = below
        if path:
            right[path[-1]] = i
        path.append(i)
    return left, right, path[0] if path else -1


class Treaps:
    """The treaps of a shard's terms; nodes are numbers of postings."""

    def __init__(self, lengths: np.ndarray, terms: list[int], df: list[int], place: np.ndarray, tf: np.ndarray, n: int, total: int) -> None:
        m = np.array([10 + 90 * x * n // total for x in lengths.tolist()], np.int64) if total else np.zeros(len(lengths), np.int64)
        self.n = len(lengths)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[place]) if len(tf) else tf
        self.places = place
        self.place, self.impact = place.tolist(), self.impacts.tolist()
        self.left, self.right = [], []
        self.span: dict[int, tuple[int, int]] = {}
        self.root: dict[int, int] = {}
        at = 0
        for t, k in zip(terms, df):
            left, right, root = heap_children(self.impact[at : at + k])
            self.left += [x + at if x >= 0 else -1 for x in left]
            self.right += [x + at if x >= 0 else -1 for x in right]
            self.span[t], self.root[t] = (at, at + k), root + at
            at += k

    def split(self, node: int, lo: int, hi: int, pivot: int) -> tuple[int, int, int]:
        """Roots of a treap's parts in [lo, pivot) and (pivot, hi), and the pivot's impact; -1 and 0 where there are none."""
        before = after = -1
        while node >= 0:
            p = self.place[node]
            if p == pivot:
                return (before if before >= 0 else self._within(self.left[node], lo, pivot)), (after if after >= 0 else self._within(self.right[node], pivot + 1, hi)), self.impact[node]
            if p < pivot:
                if before < 0 and p >= lo:
                    before = node
                node = self.right[node]
            else:
                if after < 0 and p < hi:
                    after = node
                node = self.left[node]
        return before, after, 0

    def _within(self, node: int, lo: int, hi: int) -> int:
        while node >= 0 and not lo <= self.place[node] < hi:
            node = self.right[node] if self.place[node] < lo else self.left[node]
        return node

    def added(self, weights: list[tuple[int, int]], lo: int, hi: int) -> np.ndarray:
        """Scores of all documents of a range."""
        out = np.zeros(hi - lo, np.int64)
        for t, w in weights:
            a, b = self.span[t]
            i, j = bisect_left(self.place, lo, a, b), bisect_left(self.place, hi, a, b)
            if i < j:
                out[self.places[i:j] - lo] += w * self.impacts[i:j]
        return out

    def search(self, weights: list[tuple[int, int]], k: int, floor: int) -> list[tuple[int, int]]:
        """Score and place of the best ``k`` documents with a score above 0 and not under ``floor``, ties to the smaller place."""
        weights = [(t, w) for t, w in weights if w > 0 and t in self.root]
        best: list[tuple[int, int]] = []  # a heap of (score, -place)

        def offer(score: int, place: int) -> None:
            if score > 0 and score >= floor:
                if len(best) < k:
                    heapq.heappush(best, (score, -place))
                else:
                    heapq.heappushpop(best, (score, -place))

        def hopeless(bound: int, lo: int) -> bool:
            return bound < floor or len(best) == k and (bound, -lo) < best[0]

        nodes = [(t, w, self.root[t]) for t, w in weights]
        ranges = [(-sum(w * self.impact[r] for _, w, r in nodes), 0, self.n, nodes)] if nodes else []
        while ranges:
            bound, lo, hi, nodes = heapq.heappop(ranges)
            if hopeless(-bound, lo):
                continue
            if hi - lo <= RANGE:
                scores = self.added([(t, w) for t, w, _ in nodes], lo, hi)
                for i in np.flatnonzero(scores >= max(1, floor, best[0][0] if len(best) == k else 0)).tolist():
                    offer(int(scores[i]), lo + i)
                continue
            pivot = self.place[max(nodes, key=lambda x: x[1] * self.impact[x[2]])[2]]
            score, sides = 0, ([], [])
            for t, w, node in nodes:
                before, after, impact = self.split(node, lo, hi, pivot)
                score += w * impact
                for side, child in zip(sides, (before, after)):
                    if child >= 0:
                        side.append((t, w, child))
            offer(score, pivot)
            for side, a, b in ((sides[0], lo, pivot), (sides[1], pivot + 1, hi)):
                if side and not hopeless(most := sum(w * self.impact[c] for _, w, c in side), a):
                    heapq.heappush(ranges, (-most, a, b, side))
        return [(s, -p) for s, p in best]


def _searcher(items: list[list[tuple[int, int]]], names: list[int], k: int, n: int, total: int):
    """Each item's best documents of the shards of a task, under the item's name."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in items]
        for b in batches:
            for row in range(b.num_rows):
                docs, lengths, terms, df, place, tf = (b.column(c)[row].as_py() for c in ("docs", "lengths", "terms", "df", "place", "tf"))
                treaps = Treaps(np.frombuffer(lengths, np.int64), terms, df, np.frombuffer(place, np.int32), np.frombuffer(tf, np.int64), n, total)
                for i, weights in enumerate(items):
                    floor = best[i][-1][0] if len(best[i]) == k else 0
                    found = best[i] + [(s, docs[p]) for s, p in treaps.search(weights, k, floor)]
                    best[i] = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        rows = [(name, d, s) for name, found in zip(names, best) for s, d in found]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3)], names=["_item", "doc_id", "score"])
        give_back()

    return search


def _ranked(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """_item, doc_id, score: the best documents of a bounded block of ``_item, term``."""
    rows = [(r["_item"], r["term"]) for r in items.collect()]
    vocabulary = sorted({t for _, t in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    shards = written(docs.mapInArrow(_gatherer(vocabulary), _SHARD_DDL), "search-shards")
    sums = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    n, total = sums["n"] or 0, sums["t"] or 0
    held = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
    df = {r["terms"]: r["df"] for r in held.collect()}
    names = sorted({i for i, _ in rows})
    at = {x: i for i, x in enumerate(names)}
    weighted: list[list[tuple[int, int]]] = [[] for _ in names]
    for item, term in rows:
        t = number[term]
        if t in df:
            weighted[at[item]].append((t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))))
    return shards.mapInArrow(_searcher(weighted, names, k, n, total), "_item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of each item with the highest scores above 0.

    Terms are runs of letters, digits and all that is not ASCII, A-Z lower-cased.
    Every row of ``docs`` is a document, whatever its id: repeated rows rank
    each, null ids come last among ties; null and empty texts match nothing and
    do not count in N. Rows of ``items`` with one id (null too) are one item
    with the terms of all its rows; an item without terms gives no rows, nor
    does an empty table. Other columns are not read. A very long text is a shard
    of its own.

    About ``pairs`` pairs of an item and a term go to the tasks at a time (one
    item's own terms always together); more items are searched block by block,
    each against all documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    listed = items.select("item_id", F.explode(distinct_terms("text")).alias("term")).distinct()
    ids = listed.select("item_id").distinct()
    numbered = written(ids.withColumn("_item", F.monotonically_increasing_id()), "search-items")
    listed = written(listed.join(numbered.withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id"))).select("_item", "term"), "search-terms")
    blocks = partitions_for(spark, listed.count(), pairs)
    found = None
    for b in range(blocks):
        part = _ranked(texts, listed.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b), k)
        part = part if blocks == 1 else written(part, "search-found")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered, "_item").select("item_id", "rank", "doc_id", "score")
