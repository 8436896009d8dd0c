"""Operator 3: language-model scores by a probabilistic suffix tree.

The tree models the lower-cased text as its bytes: words with one separator
between them, closed by an end symbol. Contexts of up to ``depth`` symbols are
candidates if they occur ``least`` times, so the tree grows with the corpus up
to the distinct strings of ``depth`` symbols that the corpus has. A context is
kept if its next-symbol distribution diverges enough from that of its longest
kept suffix (count times Kullback-Leibler divergence); distributions are
smoothed towards that suffix's.

The tree isn't broadcast. Contexts are parted by their last four symbols, so
that a context and its suffixes of four symbols or more are in one part;
shorter ones are a table of at most the distinct strings of four symbols, which
every part gets. Texts are read once and kept in packed blocks of bounded size.
Each block sends its distinct strings of depth + 1 symbols and its distinct
words to their parts, with the counts of its learning documents; a part sums
the counts of all blocks, grows its contexts and answers each block with the
probabilities of what it sent. Codes travel packed, so that Spark moves a row
for each block and part instead of one for each string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textbytes as tb
from factloom.llm.common import doc_runs, fold, give_back, partitions_for, text_column, written

SPACE, END = 32, 256
BITS = 9
SYMBOLS = 257
#: Last symbols of a context that choose its part.
HEAD = 4
#: Longest context: its symbols and the next one are packed into 64 bits.
DEEPEST = 64 // BITS - 1
#: Bytes of a text from which it is cut into pieces.
PIECE = 1 << 20
#: Bytes of texts whose symbols a task holds at a time, unless one text has more.
RUN = 1 << 18


def symbols(data: np.ndarray, offsets: np.ndarray, pad: int, heads: list[bytes] | None = None, closes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Symbols of all texts, each after ``pad`` end symbols as its context.

    Returns the symbols, where each text's begin (after its pad), how many it
    has, and the word spans. A text without words is the end symbol alone. Of a
    piece of a text ``heads`` has the symbols before it as its context, and one
    that does not close its text (``closes``) ends with a separator.
    """
    start, end, first = tb.word_spans(data, offsets)
    words = np.diff(first)
    last = np.zeros(len(start), bool)
    last[first[1:][words > 0] - 1] = True
    # every solid byte, and the byte after each word but a text's last, which becomes the separator
    shown = tb.LOWER[data]
    keep = tb.solid(data)
    gap = end[~last]
    keep[gap] = True
    shown[gap] = SPACE
    sums = np.concatenate([[0], np.cumsum(end - start + ~last)])
    inner = sums[first[1:]] - sums[first[:-1]]
    count = inner + 1
    begin = np.cumsum(count + pad) - count
    out = np.full(int((count + pad).sum()), END, np.int16)
    body = np.ones(len(out), bool)
    ends = begin + inner
    body[ends] = False
    for i in range(1, pad + 1):
        body[begin - i] = False
    out[body] = shown[keep]
    if heads is not None:
        for i in np.flatnonzero([len(h) > 0 for h in heads]).tolist():
            out[begin[i] - pad : begin[i]] = np.frombuffer(heads[i], np.int16)
        out[ends[~closes]] = SPACE
    return out, begin, count, (start, end, first)


def cut_text(raw: np.ndarray, limit: int, depth: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """Pieces of about ``limit`` bytes, cut after words: where each begins and ends, the ``depth`` symbols before it, and whether it is the last. A longer word stays whole."""
    solid = tb.solid(raw)
    after = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1  # the ends of words, but for one that ends the text
    stop = int(np.flatnonzero(solid)[-1]) + 1 if solid.any() else 0
    at, head = 0, b""
    while stop - at > limit:
        i = max(int(np.searchsorted(after, at + limit, side="right")) - 1, int(np.searchsorted(after, at, side="right")))
        if i >= len(after) or after[i] >= stop:
            break
        cut = int(after[i])
        yield at, cut, head, False
        width = 64
        while True:  # the last symbols, from as many of the last bytes as it takes
            low = max(at, cut - width)
            seen = symbols(raw[low:cut], np.array([0, cut - low]), 0)[0][:-1]
            if len(seen) >= depth or low == at:
                break
            width *= 16
        before = np.frombuffer(head, np.int16) if head else np.full(depth, END, np.int16)
        head = np.concatenate([before, seen, [SPACE]]).astype(np.int16)[-depth:].tobytes()
        at = cut
    yield at, len(raw), head, True


def pieces_of(b: pa.RecordBatch, row: int, limit: int, depth: int) -> pa.RecordBatch:
    """Texts (doc_id, text, held_out) with the number of their row, counted from ``row``; those longer than ``limit`` bytes in pieces, each with its head and whether it is the last."""
    data, offs = text_column(b)
    number = np.arange(row, row + b.num_rows)
    size = np.diff(offs)
    if not (size > limit).any():
        plain = [pa.array(number), pa.array([b""] * b.num_rows, pa.binary()), pa.array(np.ones(b.num_rows, bool))]
        return pa.RecordBatch.from_arrays([*b.columns, *plain], names=[*b.schema.names, "row", "head", "last"])
    at, texts, heads, lasts = [], [], [], []
    for i in range(b.num_rows):
        raw = data[offs[i] : offs[i + 1]]
        for lo, hi, head, last in cut_text(raw, limit, depth) if size[i] > limit else [(0, len(raw), b"", True)]:
            at.append(i)
            texts.append(raw[lo:hi].tobytes())
            heads.append(head)
            lasts.append(last)
    kept = b.take(pa.array(at))
    text = pa.array(texts, pa.binary()).cast(b.schema.field("text").type)
    columns = [text if n == "text" else kept.column(n) for n in b.schema.names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(number[at]), pa.array(heads, pa.binary()), pa.array(np.array(lasts))], names=[*b.schema.names, "row", "head", "last"])


def ngram_codes(sym: np.ndarray, begin: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Code of the ``n`` symbols up to each symbol of the texts."""

    def of(width: int) -> np.ndarray:
        if width == 1:
            return sym.astype(np.int64)
        half = width // 2
        low = of(half)
        high = low if width == 2 * half else of(width - half)
        return (high[: len(sym) - width + 1] << BITS * half) | low[width - half :]

    keep = np.ones(len(sym), bool)
    pad = np.concatenate([[begin[0]], begin[1:] - (begin[:-1] + count[:-1])])
    at = np.repeat(begin - pad - (np.cumsum(pad) - pad), pad) + np.arange(int(pad.sum()))
    keep[at] = False
    return of(n)[keep[n - 1 :]]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of several lists (fastest if each ascends), their sums of counts, and of the joined lists: order and place of each key."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(k, kind="stable")
    k = k[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    at = np.flatnonzero(new)
    return k[at], np.add.reduceat(n[order], at) if len(at) else n, order, np.cumsum(new) - 1


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first two of ``summed``, in less memory."""
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    n = np.concatenate(counts)[order]
    del order
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
    return k[at], np.add.reduceat(n, at) if len(at) else n


def distinct_keys(keys: list[np.ndarray]) -> np.ndarray:
    k = np.concatenate(keys)
    k.sort()
    return k[np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]]


class Tally:
    """Distinct 64-bit keys, ``counted`` or not; about ``most`` keys at a time are sorted, and sorted ones merged before they are twice as many as the distinct."""

    def __init__(self, most: int = 1 << 21, counted: bool = True) -> None:
        self.waiting: list[np.ndarray] = []
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.size, self.most, self.counted = 0, most, counted

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size > self.most:
            self._sort()
            if sum(map(len, self.keys)) > 2 * max(len(self.keys[0]), self.most // 2):
                self._merge()

    def _sort(self) -> None:
        if self.waiting:
            if self.counted:
                k, n = np.unique(np.concatenate(self.waiting), return_counts=True)
                self.counts.append(n)
            else:
                k = distinct_keys(self.waiting)
            self.keys.append(k)
            self.waiting, self.size = [], 0

    def _merge(self) -> None:
        if self.counted:
            k, n = merged(self.keys, self.counts)
            self.counts = [n]
        else:
            k = distinct_keys(self.keys)
        self.keys = [k]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys, ascending, and their counts; none if they are not counted."""
        self._sort()
        if len(self.keys) > 1:
            self._merge()
        return self.keys[0], self.counts[0]


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted code in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


@dataclass
class Level:
    """All contexts of one length: the codes with a next symbol, their counts and probabilities; contexts, their counts, next symbols and whether kept."""

    pair: np.ndarray
    count: np.ndarray
    p: np.ndarray
    context: np.ndarray
    n: np.ndarray
    kinds: np.ndarray
    kept: np.ndarray


def grow_level(key: np.ndarray, number_of: np.ndarray, length: int, up: Level | None, least: int, keep_bits: float) -> Level:
    """Contexts of ``length`` from counts of longer or as long codes; ``up`` has the contexts shorter by one, those of other parts too."""
    code = key & ((1 << BITS * (length + 1)) - 1)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    pair = code[first]
    count = np.add.reduceat(number_of[order], first).astype(float) if len(code) else np.zeros(0)
    if up is None:
        total = count.sum()
        return Level(pair, count, (count + 1) / (total + SYMBOLS), np.zeros(1, np.int64), np.array([total]), np.array([len(pair)]), np.ones(1, bool))
    if not len(pair):
        none = np.zeros(0, np.int64)
        return Level(pair, count, np.zeros(0), none, none, none, np.zeros(0, bool))
    context = pair >> BITS
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    n, kinds = np.add.reduceat(count, at), np.diff(np.append(at, len(pair)))
    before = up.p[np.searchsorted(up.pair, pair & ((1 << BITS * length) - 1))]
    each_n, each_kinds = np.repeat(n, kinds), np.repeat(kinds, kinds)
    gain = np.add.reduceat(count * np.log2(count / each_n / before), at)
    kept = (n >= least) & (gain >= keep_bits)
    p = np.where(np.repeat(kept, kinds), (before * each_kinds + count) / (each_n + each_kinds), before)
    return Level(pair, count, p, context[at], n, kinds, kept)


def probabilities(levels: list[Level], key: np.ndarray) -> np.ndarray:
    """Probability of the last symbol of each code after the longest kept suffix of the symbols before it."""
    root = levels[0]
    at, there = find(root.pair, key & ((1 << BITS) - 1))
    p = np.full(len(key), 1.0 / (root.n[0] + SYMBOLS))
    p[there] = root.p[at[there]]
    for length, level in enumerate(levels[1:], 1):
        code = key & ((1 << BITS * (length + 1)) - 1)
        at, there = find(level.context, code >> BITS)
        some = np.flatnonzero(there)
        some = some[level.kept[at[some]]]
        at = at[some]
        place, seen = find(level.pair, code[some])
        count = np.where(seen, level.count[place], 0.0) if len(place) else np.zeros(0)
        p[some] = (p[some] * level.kinds[at] + count) / (level.n[at] + level.kinds[at])
    return p


def part_of(key: np.ndarray, parts: int, kind: int, depth: int) -> np.ndarray:
    """Part of each turned code, by the last symbols of its context, or of each word."""
    of = tb.mix64((key >> BITS * (depth - HEAD + 1)).view(np.uint64)) if kind == GRAMS else key.view(np.uint64)
    return (of % np.uint64(parts)).astype(np.int32)


def turned(key: np.ndarray, depth: int) -> np.ndarray:
    """Codes of depth + 1 symbols with the last HEAD symbols of their context first, so that those of a part stand together."""
    low, rest = BITS * HEAD, BITS * (depth - HEAD + 1)
    context = key >> BITS
    return ((context & ((1 << low) - 1)) << rest) | ((context >> low) << BITS) | (key & ((1 << BITS) - 1))


def straight(key: np.ndarray, depth: int) -> np.ndarray:
    """The codes that ``turned`` turned."""
    low, rest = BITS * HEAD, BITS * (depth - HEAD + 1)
    old = (key >> BITS) & ((1 << rest - BITS) - 1)
    return (old << low + BITS) | ((key >> rest) << BITS) | (key & ((1 << BITS) - 1))


_ZSTD = pa.Codec("zstd", compression_level=3)


def squeezed(planes: np.ndarray) -> bytes:
    """Rows of bytes, compressed."""
    return _ZSTD.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def spread(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data, n * width, asbytes=True), np.uint8).reshape(width, n)


def packed(number: np.ndarray, differences: bool = False) -> bytes:
    """Whole numbers, or ascending ones as their differences: all lowest bytes, all second bytes and so on."""
    some = np.diff(number, prepend=np.int64(0)) if differences else number
    return squeezed(some.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def unpacked(data: bytes, n: int, differences: bool = False) -> np.ndarray:
    some = np.ascontiguousarray(spread(data, n, 8).T).view("<i8").ravel()
    return np.cumsum(some) if differences else some


def packed_codes(key: np.ndarray, depth: int) -> bytes:
    """Codes by symbol: the low bytes of each of the depth + 1 symbols, then the ninth bits of all."""
    planes = np.empty((depth + 2, len(key)), np.uint8)
    planes[-1] = 0
    for i in range(depth + 1):
        symbol = key >> BITS * (depth - i)
        planes[i] = symbol & 255
        planes[-1] |= ((symbol >> 8) & 1).astype(np.uint8) << i
    return squeezed(planes)


def unpacked_codes(data: bytes, n: int, depth: int) -> np.ndarray:
    planes = spread(data, n, depth + 2)
    key = np.zeros(n, np.int64)
    for i in range(depth + 1):
        key = (key << BITS) | planes[i] | ((planes[-1] >> i & 1).astype(np.int64) << 8)
    return key


#: What a row of the packed table holds: symbol strings or words of a block and part, strings of HEAD symbols of a block, or a block's texts.
GRAMS, WORDS, HEADS, TEXTS = range(4)
#: Fixed by the arrays' types: n counts what ``a`` and ``b`` hold; total the learning tokens of the kind.
PACKED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
PACKED_SQL = "kind int, block long, part int, n long, total long, a binary, b binary"


def packed_texts(t: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


def texts_of(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def block_rows(block: int, t: pa.RecordBatch, depth: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The packed rows of one block of pieces of texts (see ``pieces_of``)."""

    def rows(kind: int, of: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
        part, n, total, a, b = zip(*of)
        return pa.RecordBatch.from_arrays([pa.array([x] * len(of), f) for x, f in ((kind, pa.int32()), (block, pa.int64()))] + [pa.array(x, f.type) for x, f in zip((part, n, total, a, b), list(PACKED)[2:])], schema=PACKED)

    held, last = (t.column(c).to_numpy(zero_copy_only=False) for c in ("held_out", "last"))
    ends = int((~held & last).sum())
    grams, words = [Tally(), Tally(counted=False)], [Tally(), Tally(counted=False)]
    for flag in (False, True):
        some = t.filter(pa.array(held == flag))
        data, offs = text_column(some)
        heads, closes = some.column("head").to_pylist(), some.column("last").to_numpy(zero_copy_only=False)
        for lo, hi in doc_runs(offs, RUN):
            part = data[offs[lo] : offs[hi]]
            sym, begin, count, (start, end, _) = symbols(part, offs[lo : hi + 1] - offs[lo], depth, heads[lo:hi], closes[lo:hi])
            grams[flag].add(turned(ngram_codes(sym, begin, count, depth + 1), depth))
            words[flag].add(tb.word_hashes(part, start, end).view(np.int64))
    for kind, tallies in ((GRAMS, grams), (WORDS, words)):
        (known, n), (other, _) = tallies[0].total(), tallies[1].total()
        tallies.clear()
        if kind == GRAMS:
            heads, sums = merged([straight(known, depth) & ((1 << BITS * HEAD) - 1)], [n])
            yield rows(HEADS, [(-1, len(heads), 0, packed(heads, True), packed(sums))])
        learnt = int(n.sum())
        key, n = merged([known, other], [n, np.zeros(len(other), n.dtype)])
        del known, other
        part = part_of(key, parts, kind, depth)
        order = np.argsort(part, kind="stable")
        key, n = key[order], n[order]
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        found = []
        for p, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if hi > lo or kind == WORDS:  # every part tells every block how many words it has
                found.append((p, hi - lo, 0, packed_codes(key[lo:hi], depth) if kind == GRAMS else packed(key[lo:hi], True), packed(n[lo:hi])))
        yield rows(kind, found)
    yield rows(WORDS, [(-1, 0, learnt + ends, b"", b"")])  # and one end for each text
    yield rows(TEXTS, [(-1, t.num_rows, ends, packed_texts(t), b"")])


def text_blocks(docs: DataFrame, depth: int, parts: int, block_bytes: int) -> DataFrame:
    """Rows of all blocks; a block is a run of a task's texts, long ones in pieces, of about ``block_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, row = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n, b = b.num_rows, pieces_of(b, task << 40 | row, min(PIECE, block_bytes), depth)
            row += n
            size = text_column(b)[1]
            blocks = max(1, -(-int(size[-1]) // block_bytes))
            for lo, hi in doc_runs(size, max(1, -(-int(size[-1]) // blocks))):
                yield from block_rows(task << 32 | seen, b.slice(lo, hi - lo), depth, parts)
                seen += 1
        give_back()

    return docs.mapInArrow(run, PACKED_SQL)


def head_levels(table: DataFrame, least: int, keep_bits: float) -> list[Level]:
    """Contexts shorter than HEAD symbols, of all parts: at most the distinct strings of HEAD symbols reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            for n, x, y in zip(b.column("n").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist()):
                keys.append(unpacked(x, n, True))
                counts.append(unpacked(y, n))
                if len(keys) > 16:
                    k, n, _, _ = summed(keys, counts)
                    keys, counts = [k], [n]
        k, n, _, _ = summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["key", "n"])

    t = table.filter(F.col("kind") == HEADS).select("n", "a", "b").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
    levels: list[Level] = []
    for length in range(HEAD):
        levels.append(grow_level(key, n, length, levels[-1] if levels else None, least, keep_bits))
    return levels


def score_documents(
    docs: DataFrame,
    folds: int = 7,
    held: int = 2,
    depth: int = 6,
    least: int = 4,
    keep_bits: float = 6.0,
    block_bytes: int = 12 << 20,
    part_bytes: int = 12 << 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Scores of every whole text; the model learns from documents of the other folds.

    doc_id, held_out, n_tokens (words and the end), n_known, train_tokens,
    base_score (add-one unigrams of words and the end) and score (the tree's),
    both log10. Null and empty texts are the end alone. Repeated rows count and
    are scored each; a null id is in the fold of the empty text; other columns
    are not carried; an empty table gives no rows. Without learning documents
    every symbol has probability 1/257 and the base score is 0. A text longer
    than ``PIECE`` bytes is read in pieces, each after the last symbols of the
    one before, and its pieces' scores are added up; a word is never cut.
    ``depth``, the longest context, is 4 to 6 symbols: shorter ones could not be
    parted by their last four, longer ones do not fit a packed code.
    """
    if not HEAD <= depth <= DEEPEST:
        raise ValueError(f"contexts of {HEAD} to {DEEPEST} symbols are possible, not {depth}")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), (fold(doc_id, folds) == held).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = partitions_for(spark, size, part_bytes)
    table = written(text_blocks(rows, depth, parts, block_bytes), "lm-blocks")
    shared = spark.sparkContext.broadcast(head_levels(table, least, keep_bits))

    totals = {r["kind"]: r["n"] for r in table.filter("part = -1").groupBy("kind").agg(F.sum("total").alias("n")).collect()}
    train, ends = totals.get(WORDS) or 0, totals.get(TEXTS) or 0

    def answer(t: pa.Table) -> pa.Table:
        out = []
        for kind in (GRAMS, WORDS):
            some = t.filter(pc.equal(t.column("kind"), kind)).combine_chunks()
            sizes = some.column("n").to_pylist()
            if not sizes:
                continue
            keys = [unpacked_codes(x, n, depth) if kind == GRAMS else unpacked(x, n, True) for n, x in zip(sizes, some.column("a").to_pylist())]
            key, n, order, place = summed(keys, [unpacked(x, n) for n, x in zip(sizes, some.column("b").to_pylist())])
            del keys
            distinct = int((n > 0).sum())
            if kind == GRAMS:
                key = straight(key, depth)
                levels, known = list(shared.value), n > 0
                for length in range(HEAD, depth + 1):
                    levels.append(grow_level(key[known], n[known], length, levels[-1], least, keep_bits))
                value = np.log10(probabilities(levels, key)).astype("<f4")
                del levels
            else:
                value = n.astype("<i8")
            mine = np.empty(len(order), value.dtype)
            mine[order] = value[place]
            at = np.cumsum(sizes)
            answers = [squeezed(mine[z - m : z].view(np.uint8).reshape(m, -1).T) if m else b"" for z, m in zip(at.tolist(), sizes)]
            found = some.select(["kind", "block", "part", "n"]).append_column("total", pa.array(np.full(len(sizes), distinct, np.int64)))
            out.append(found.append_column("a", pa.array(answers, pa.binary())))
        give_back()
        return pa.concat_tables(out)

    answered = table.filter((F.col("kind") <= WORDS) & (F.col("part") >= 0)).select("kind", "block", "part", "n", "a", "b")
    answered = answered.groupBy("part").applyInArrow(answer, "kind int, block long, part int, n long, total long, a binary")

    def values(known: pa.Table, key: np.ndarray, part: np.ndarray, dtype: str) -> np.ndarray:
        """The answers to a block's distinct keys, which were sent by part, ascending in each."""
        known = known.filter(pc.greater(known.column("n"), 0))
        width, data, sizes = np.dtype(dtype).itemsize, known.column("a"), known.column("n").to_pylist()
        order = np.argsort(known.column("part").to_numpy()).tolist()
        got = [np.ascontiguousarray(spread(data[i].as_py(), sizes[i], width).T).view(dtype).ravel() for i in order]
        out = np.zeros(len(key), dtype)
        out[np.argsort(part, kind="stable")] = np.concatenate(got) if got else np.zeros(0, dtype)
        return out

    def scored(of: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        of_grams, of_words = (known.filter(pc.equal(known.column("kind"), kind)) for kind in (GRAMS, WORDS))
        del known
        distinct = (ends > 0) + (pc.sum(of_words.column("total")).as_py() or 0)
        cost = np.log10(train + distinct + 1)
        for data_of in of.column("a").to_pylist():
            b = texts_of(data_of)
            data, offs = text_column(b)
            heads, closes = b.column("head").to_pylist(), b.column("last").to_numpy(zero_copy_only=False)

            def runs() -> Iterator[tuple]:
                for lo, hi in doc_runs(offs, RUN):
                    part = data[offs[lo] : offs[hi]]
                    sym, begin, count, (start, end, first) = symbols(part, offs[lo : hi + 1] - offs[lo], depth, heads[lo:hi], closes[lo:hi])
                    yield lo, hi, count, first, turned(ngram_codes(sym, begin, count, depth + 1), depth), tb.word_hashes(part, start, end).view(np.int64)

            grams, words = Tally(counted=False), Tally(counted=False)
            for *_, code, h in runs():
                grams.add(code)
                words.add(h)
            gram, word = grams.total()[0], words.total()[0]
            del grams, words
            logp = values(of_grams, gram, part_of(gram, parts, GRAMS, depth), "<f4")
            count_of = values(of_words, word, part_of(word, parts, WORDS, depth), "<i8")
            # a second reading takes less memory than keeping where each symbol's code is
            for lo, hi, count, first, code, h in runs():
                order = np.argsort(code)
                code = code[order]
                new = np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]
                each = logp[np.searchsorted(gram, code[new])][np.cumsum(new, dtype=np.int32) - 1]
                tree = np.bincount(np.repeat(np.arange(hi - lo, dtype=np.int32), count)[order], weights=each, minlength=hi - lo)
                c = count_of[np.searchsorted(word, h)]  # every one was sent
                n_words, close = np.diff(first), closes[lo:hi]
                in_doc = np.repeat(np.arange(hi - lo), n_words)
                seen = np.bincount(in_doc, weights=c > 0, minlength=hi - lo).astype(np.int64) + (close if ends else 0)
                base = np.bincount(in_doc, weights=np.log10(c + 1) - cost, minlength=hi - lo) + np.where(close, np.log10(ends + 1) - cost, 0.0)
                cols = [b.column(x).slice(lo, hi - lo) for x in ("row", "doc_id", "held_out")]
                cols += [pa.array(x) for x in ((n_words + close).astype(np.int64), seen.astype(np.int64), base, tree)]
                out.append(pa.RecordBatch.from_arrays(cols, schema=scores))
            del gram, logp, word, count_of, data, b
        give_back()
        return pa.Table.from_batches(out, schema=scores)

    scores = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    texts = table.filter(F.col("kind") == TEXTS).select("block", "a")
    pieces = texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(scored, schema)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
