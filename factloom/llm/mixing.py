"""Operator 4: mixing sources to target weights.

Each source is laid out as one stream of words, in an order drawn by hash, and
cut into blocks of ``block_words`` words (the last may be shorter). A source's
target in words becomes whole passes over its blocks and one partial pass.
Output shards hold a fixed number of slots. How many slots of each source a
shard gets is a multinomial draw, conditioned on the totals: the range of shards
is halved again and again and the counts of a half are drawn without
replacement, with a generator seeded by the range, so that a shard finds its
counts alone in a logarithmic number of draws and the totals come out exactly.
Slot number j of a source maps to a block through a pseudorandom permutation
of the block numbers (one for each source and pass), and blocks are joined by
number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import draws
from factloom.llm import textbytes as tb
from factloom.llm.common import doc_runs, keyed_rows, map_arrow, text_column, written

#: Weights of the sources in the order of their names' code points, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: Sources are a dimension: their table is held by the driver. More than this many are refused.
MAX_SOURCES = 1_000_000


def word_counts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source and the number of words of each text (null: 0)."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text_column(b)
        n = np.zeros(b.num_rows, np.int64)
        for lo, hi in doc_runs(offs):
            _, _, first = tb.word_spans(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            n[lo:hi] = np.diff(first)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n)], names=["doc_id", "source", "size"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, count, "doc_id long, source string, size long")


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    out = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes)) if sizes[i] > 0], float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        held = set(over)
        open_ = [i for i in open_ if i not in held]
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``i``: a Feistel network with cycle walking."""
    if n <= 1:
        return np.zeros_like(i)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        a, b = y >> np.uint64(half), y & low
        for r in range(4):
            k = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1342543DE82EF95) & (1 << 64) - 1)
            a, b = b, a ^ (tb.mix64(b ^ k) & low)
        x[todo] = (a << np.uint64(half)) | b
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def shard_draw(counts: np.ndarray, shards: int, per_shard: int, shard: int, seed: int, known: dict[tuple[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and how many of each lie in the shards before it.

    ``known`` keeps the draws of large ranges, which are dear and which the
    shards of a task have in common.
    """
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    before = np.zeros_like(counts)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = min(total, mid * per_shard) - min(total, lo * per_shard)
        got = known.get((lo, hi)) if known is not None else None
        if got is None:
            got = draws.split_draw(np.random.Generator(np.random.PCG64([seed, lo, hi])), counts, left)
            if known is not None and (hi - lo) * per_shard >= draws.NUMPY_LIMIT:
                known[lo, hi] = got
        if shard < mid:
            counts, hi = got, mid
        else:
            before, counts, lo = before + got, counts - got, mid
    return counts, before


def mix_spans(
    docs: DataFrame,
    block_words: int = 64,
    most: float = 3.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 7,
    slots_per_shard: int = 4096,
    rows_per_task: int = 2_000,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The mix as spans of words, and the laid-out documents.

    Spans: shard, slot, source_no, epoch, block, at (the document's place in
    its source's stream), doc_id, first_word, n_words. Documents: doc_id,
    source, size, source_no, at, source_size, target. ``source_no`` and ``at``
    name a row of documents with words, also where ids repeat. Null sources
    are a source of their own, null texts have no words, an empty table gives
    no rows, other columns are not carried. The same rows give the same mix.
    """
    spark = docs.sparkSession
    counted = written(word_counts(docs, doc_id, source, text), "sizes")
    totals = counted.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; their weights are a table of the driver")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in totals]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), most)
    words = [min(int(round(t)), int(most * s)) for t, s in zip(targets, sizes)]
    names = spark.createDataFrame(
        [(r["source"], i, s, t) for i, (r, s, t) in enumerate(zip(totals, sizes, targets))], "_name string, source_no int, source_size long, target double"
    )
    # at most MAX_SOURCES rows
    known = counted.join(F.broadcast(names), counted["source"].eqNullSafe(names["_name"])).drop("_name")
    salts = max(1, -(-max((int(r["n"]) for r in totals), default=1) // rows_per_task))
    known = known.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_salt", F.pmod(F.xxhash64("_h", "size"), F.lit(salts)))
    before = known.groupBy("source_no", "_salt").agg(F.sum("size").alias("_n"))
    before = before.select("source_no", "_salt", (F.sum("_n").over(Window.partitionBy("source_no").orderBy("_salt")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("source_no", "_salt").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_to", F.sum("size").over(order)).join(before, ["source_no", "_salt"])
    laid = written(known.select("doc_id", "source", "size", "source_no", (F.col("_before") + F.col("_to") - F.col("size")).alias("at"), "source_size", "target"), "laid")

    whole = [s // block_words for s in sizes]
    spe = [w + (s % block_words > 0) for w, s in zip(whole, sizes)]
    epochs = [w // s if s else 0 for w, s in zip(words, sizes)]
    rest = [w - e * s for w, e, s in zip(words, epochs, sizes)]
    slots = np.array([e * p + -(-min(r, f * block_words) // block_words) + (r > f * block_words) for e, p, r, f in zip(epochs, spe, rest, whole)] or [0], np.int64)
    shards = max(1, -(-int(slots.sum()) // slots_per_shard))
    table = {"whole": np.array(whole or [0]), "spe": np.array(spe or [0]), "epochs": np.array(epochs or [0]), "rest": np.array(rest or [0]), "tail": np.array([s % block_words for s in sizes] or [0])}

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            for shard in f["id"].tolist():
                n, start = shard_draw(slots, shards, slots_per_shard, shard, seed, known)
                if not n.sum():
                    continue
                no = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(no)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
                epoch, i = j // table["spe"][no], j % table["spe"][no]
                partial = epoch >= table["epochs"][no]
                left = np.where(partial, table["rest"][no] - i * block_words, block_words)
                length = np.minimum(np.where(i < table["whole"][no], block_words, table["tail"][no]), left)
                block = i.copy()
                for s, e in set(zip(no.tolist(), epoch.tolist())):
                    at = np.flatnonzero((no == s) & (epoch == e) & (i < table["whole"][no]))
                    block[at] = permuted(i[at], int(table["whole"][s]), seed * 1_000_003 + s * 4_099 + e)
                place = np.random.Generator(np.random.PCG64([seed, shard, shards, 1])).permutation(len(no))
                yield pd.DataFrame({"shard": shard, "slot": place, "source_no": no.astype(np.int32), "epoch": epoch.astype(np.int32), "block": block, "take": length})

    filled = spark.range(shards).mapInPandas(fill, "shard long, slot long, source_no int, epoch int, block long, take long")
    b = F.lit(block_words)
    pieces = laid.filter("size > 0").select(
        "doc_id", "source_no", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block")
    )
    begin = F.greatest(F.col("at"), F.col("block") * b)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * b + F.col("take"))
    # the slots grow with the corpus, which Spark's estimate for rows made in Python doesn't show: never broadcast them
    spans = (
        filled.hint("merge").join(pieces, ["source_no", "block"])
        .select("shard", "slot", "source_no", "epoch", "block", "at", "doc_id", (begin - F.col("at")).alias("first_word"), (end - begin).alias("n_words"))
        .filter("n_words > 0")
    )
    return spans, laid


def taken_words(spans: DataFrame, laid: DataFrame) -> DataFrame:
    """Laid-out documents with ``taken``: the words of theirs that the mix holds, repeats counted."""
    sums = spans.groupBy("source_no", "at", "doc_id").agg(F.sum("n_words").alias("taken"))
    with_words = laid.filter("size > 0").join(sums, ["source_no", "at", "doc_id"], "left")
    none = laid.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return with_words.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).unionByName(none)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row of ``docs`` for each document and pass, its text cut to the words taken.

    Rows of a null or repeated ``doc_id`` are documents each. Texts taken whole keep every byte; of others
    the runs of words taken stay, joined by a space where words between them go.
    Documents of which nothing is taken go, those without words too.
    """
    keyed = keyed_rows(docs)
    spans, _ = mix_spans(keyed, doc_id="_key", **options)
    runs = spans.groupBy("doc_id", "epoch").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("_runs"))
    # the whole row in one column, so that no column of the input clashes with one made here
    whole = keyed.select("_key", F.struct(*docs.columns).alias("_row"))
    joined = whole.join(runs.withColumnRenamed("doc_id", "_key"), "_key")

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series, taken: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(text, taken):
            raw = np.frombuffer(t.encode(), np.uint8)
            start, end, _ = tb.word_spans(raw, np.array([0, len(raw)]))
            kept, at = [], -1
            for r in spans_:
                a, n = r["first_word"], r["n_words"]
                if a == at:
                    kept[-1][1] = a + n
                else:
                    kept.append([a, a + n])
                at = a + n
            if kept == [[0, len(start)]]:
                out.append(t)
            else:
                out.append(" ".join(bytes(raw[start[a] : end[z - 1]]).decode() for a, z in kept))
        return pd.Series(out)

    return joined.select(*[cut(F.col("_row")["text"], "_runs").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
