"""Operator 12: how far the sources of a language are from it and from each other.

Two passes over the texts, dealt once into blocks of one language and source.
The first counts in how many documents each term of a block occurs; summed, that
gives each language's kept terms. The second searches each block for those kept
terms that it holds, by an automaton over terms padded with their delimiters,
and counts occurrences. The automaton of a block is bounded by the block, not by
the vocabulary. Counts
summed by source are sparse postings; a term that a source lacks has the same
share as all others that it lacks, so pairs need the postings only.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import give_back, shared_dir, written
from factloom.llm.terms import LETTER_TABLE, plain

#: Fixed value: shares are counted in billionths.
UNIT = 1_000_000_000
#: Bytes of texts of a block, about; a longer text stays whole.
BLOCK = 16 << 20
#: Spark's own limit of buckets.
MOST_BUCKETS = 100_000
#: Rows that a task hands on at a time.
ROWS = 100_000
#: Postings that are compared in one group, about.
PER_GROUP = 16_384
#: Parts that the sources of one language are dealt to, where they meet each other.
SALTS = 16
#: Pairs of postings held at a time.
AT_ONCE = 1 << 20

BLOCK_KEY = ["lang", "source", "salt"]
_HELD = pa.schema([("lang", pa.string()), ("source", pa.string()), ("salt", pa.int32()), ("term", pa.string()), ("docs", pa.int64())])
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
_PAIRED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("shared", pa.int64())])


def lay_out(texts: DataFrame) -> DataFrame:
    """Texts in blocks of about ``BLOCK`` bytes of one language and source, as a table bucketed and sorted by block.

    A group of many bytes is dealt over many blocks row by row, whatever its
    rows are. Both passes read the buckets where they lie.
    """
    spark = texts.sparkSession
    groups = written(texts.groupBy("lang", "source").agg(F.ceil((F.sum(F.octet_length("text")) + 1) / BLOCK).cast("int").alias("_salts")), "audit-sizes")
    blocks = groups.agg(F.sum("_salts").alias("n")).first()["n"] or 1
    dealt = texts.withColumn("_row", F.monotonically_increasing_id()).join(groups, ["lang", "source"]).select("lang", "source", F.pmod("_row", "_salts").cast("int").alias("salt"), "text")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, 2 * blocks))
    name = f"audit_texts_{uuid.uuid4().hex}"
    put = dealt.repartition(buckets, *BLOCK_KEY).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    put.bucketBy(buckets, *BLOCK_KEY).sortBy(*BLOCK_KEY).saveAsTable(name)
    return spark.table(name)


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: documents of each term of a block (a block that two tasks read gives rows in both)."""
    here: tuple | None = None
    found: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        terms = list(found)
        for lo in range(0, len(terms), ROWS):
            part = terms[lo : lo + ROWS]
            columns = [*([x] * len(part) for x in here), [t.decode() for t in part], [found[t] for t in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HELD)], schema=_HELD)

    for b in batches:
        for *block, text in zip(*(b.column(c).to_pylist() for c in BLOCK_KEY), b.column("text")):
            if (block := tuple(block)) != here:
                yield from rows()
                here, found = block, Counter()
            found.update(set(plain(text.as_py(), LETTER_TABLE).split()))
    yield from rows()
    give_back()


def _occurrences(key: tuple, texts: pa.Table, kept: pa.Table) -> pa.Table:
    """Second pass: occurrences of the kept terms in the texts of a block."""
    terms = kept.column("term").to_pylist()
    counts: Counter = Counter()
    if terms:
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        for text in texts.column("text"):
            # neighbours share the delimiter between them: matches overlap there and are all found
            counts.update(map(itemgetter(1), automaton.iter(f" {plain(text.as_py(), LETTER_TABLE).decode()} ")))
    columns = [[key[0].as_py()] * len(counts), [key[1].as_py()] * len(counts), [terms[i] for i in counts], list(counts.values())]
    give_back()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared_terms(rows: pa.Table) -> pa.Table:
    """For ordered pairs of sources, over the terms that both hold: their distance less what it would be if either lacked them.

    Terms are taken by the length of their postings, so many of one length at once.
    """
    lang = rows.column("lang")[0].as_py()
    names, source = np.unique(np.array(rows.column("source").to_pylist(), dtype=object), return_inverse=True)
    _, term = np.unique(np.array(rows.column("term").to_pylist(), dtype=object), return_inverse=True)
    order = np.lexsort((source, term))
    source, term = source[order], term[order]
    p, p0 = (rows.column(c).to_numpy()[order] for c in ("p", "p0"))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    length = np.diff(np.r_[first, len(term)])
    total = np.zeros(len(names) ** 2, np.int64) if len(names) <= 2048 else None
    sums: Counter = Counter()
    for k in np.unique(length[length > 1]).tolist():
        starts = first[length == k]
        for lo in range(0, len(starts), step := max(1, AT_ONCE // (k * k))):
            at = starts[lo : lo + step, None] + np.arange(k)
            a, b = np.repeat(at, k, axis=1).ravel(), np.tile(at, k).ravel()
            apart = a != b
            a, b = a[apart], b[apart]
            value = _distance(p[a], p[b]) - _distance(p[a], p0[b]) - _distance(p0[a], p[b]) + _distance(p0[a], p0[b])
            pair = source[a] * len(names) + source[b]
            if total is not None:
                np.add.at(total, pair, value)
            else:
                which, at_ = np.unique(pair, return_inverse=True)
                each = np.zeros(len(which), np.int64)
                np.add.at(each, at_, value)
                for w, v in zip(which.tolist(), each.tolist()):
                    sums[w] += v
    if total is not None:
        which = np.flatnonzero(total)
        values = total[which]
    else:
        which, values = np.fromiter(sums, np.int64, len(sums)), np.fromiter(sums.values(), np.int64, len(sums))
    one, other = names[which // len(names)], names[which % len(names)]
    return pa.Table.from_arrays([pa.array([lang] * len(which), pa.string()), pa.array(one, pa.string()), pa.array(other, pa.string()), pa.array(values, pa.int64())], schema=_PAIRED)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), 1 where nothing is kept; decimals hold any count."""
    over = (F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 1)).alias("x")
    return 1 + F.coalesce(F.call_function("div", over, F.nullif(total, F.lit(0)).cast("decimal(20,0)")), F.lit(0))


def _away(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def audit_sources(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of language and source its distance from other sources and its most typical terms.

    Terms are runs of letters and of all that is not ASCII, A-Z lower-cased.
    Each language keeps the terms that ``least_docs`` of its documents hold. A
    kept term's share of a group or language is 1 + floor(10^9 (count + 1) /
    (N + V)). Part ``pair`` sums (p - q)^2 div q over all kept terms, against
    each other source of the language; part ``term`` has it against the whole
    language, for terms that the group holds and has more of, to rank
    ``most_terms``. Ranks go by value, ties by item.

    Every row is a document, whatever its id, so repeated rows count each; null
    texts, languages and sources are empty strings. A group without terms has
    pairs all the same; a language that keeps nothing has values of 0. An empty
    table gives no rows. Other columns are not read. A very long text stays whole and
    costs its task a few times its size.
    """
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    laid = lay_out(texts)
    held = laid.mapInArrow(_documents_with, "lang string, source string, salt int, term string, docs long")
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = held.withColumn("_n", in_lang).filter(F.col("_n") >= least_docs).select(*BLOCK_KEY, "term")
    counted = laid.groupBy(*BLOCK_KEY).cogroup(kept.groupBy(*BLOCK_KEY)).applyInArrow(_occurrences, "lang string, source string, term string, n long")
    postings = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "audit-postings")

    vocabulary = postings.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("vocab"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("present"))
    groups = laid.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["held", "present", "vocab"])
    groups = written(groups.select("*", _share(F.lit(0), F.col("held") + F.col("vocab")).alias("p0")), "audit-groups")
    of_lang = groups.groupBy("lang").agg(F.sum("held").alias("_all"))
    shares = postings.join(groups.select("lang", "source", "held", "vocab", "p0"), ["lang", "source"]).join(of_lang, "lang")
    in_lang = F.sum("n").over(Window.partitionBy("lang", "term"))
    shares = shares.select("lang", "source", "term", "p0", _share(F.col("n"), F.col("held") + F.col("vocab")).alias("p"), _share(in_lang, F.col("_all") + F.col("vocab")).alias("q"))
    shares = written(shares, "audit-shares")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_away("p", "q")).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)

    parts = F.pmod(F.xxhash64("term"), F.lit(shares.count() // PER_GROUP + 1))
    both = shares.select("lang", "source", "term", "p", "p0", parts.alias("_part")).groupBy("lang", "_part").applyInArrow(_shared_terms, "lang string, source string, other string, shared long")
    both = both.groupBy("lang", "source", "other").agg(F.sum("shared").alias("shared"))
    spread = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("hist"))
    whole = groups.join(spread, ["lang", "source"], "left").withColumn("hist", F.coalesce("hist", F.array().cast("array<struct<p:bigint,m:bigint>>")))
    a = whole.select("lang", "source", "vocab", F.col("present").alias("an"), F.col("p0").alias("a0"), F.col("hist").alias("ah"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("_salt"))
    b = whole.select("lang", F.col("source").alias("other"), F.col("present").alias("bn"), F.col("p0").alias("b0"), F.col("hist").alias("bh"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    sums = (
        f"aggregate(ah, 0L, (s, x) -> s + x.m * ({_away('x.p', 'b0')})) + aggregate(bh, 0L, (s, x) -> s + x.m * ({_away('a0', 'x.p')}))"
        f" + (vocab - an - bn) * ({_away('a0', 'b0')})"
    )
    met = a.join(b, ["lang", "_salt"]).filter("source <> other").select("lang", "source", "other", F.expr(sums).alias("_apart"))
    pairs = met.join(both, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("_apart") + F.coalesce("shared", F.lit(0))).alias("value"))
    return typical.unionByName(pairs.withColumn("rank", F.row_number().over(order))).select("lang", "source", "part", "item", "value", "rank")
