"""Operator 1: best-fit decreasing packing of token sequences.

Best fit decreasing looks at lengths alone, so pieces of one length are
interchangeable and the packing can be planned from the histogram of lengths,
which has at most ``capacity`` entries whatever the corpus has. The plan holds
runs: pieces number a to b of length L go, q to a bin, into the bins from x on.
A segment tree over the remaining capacities finds the tightest level that
still takes a length in logarithmic time. Rows then find their bin by their
rank among the pieces of their length, so nothing but the histogram reaches the
driver and the result is that of one global best-fit decreasing pass.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import doc_runs, give_back, text_column, written

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids binary, row long"
#: Distinct words, and parts of words, that a worker remembers before it forgets those that it has not met again.
WORD_CACHE, PART_CACHE = 400_000, 500_000
#: Bytes of texts whose words are looked up at a time.
RUN_BYTES = 1 << 21
#: Bytes, with those that part words as spaces.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[[9, 10, 13]] = 32


class FitTree:
    """Segment tree over remaining capacities 0..capacity: the smallest open level >= x."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << int(capacity).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, level: int, n: int) -> None:
        """Change the number of open bins at a level by ``n``."""
        i = level + self.size
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """Smallest level >= need with an open bin, or -1."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing of a histogram of lengths.

    Returns runs (length, rank_lo, rank_hi, bin_lo, per_bin, base) and the
    number of bins: the piece of rank r in [rank_lo, rank_hi) goes into bin
    bin_lo + (r - rank_lo) // per_bin at base + (r - rank_lo) % per_bin * length.
    """
    tree = FitTree(capacity)
    levels: dict[int, deque[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(level: int, lo: int, n: int) -> None:
        if n and level:
            levels.setdefault(level, deque()).append((lo, n))
            tree.add(level, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length <= 0 or length > capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while left:
            level = tree.tightest(length)
            if level < 0:
                per = capacity // length
                level, lo, n = capacity, bins, -(-left // per)
                bins += n
            else:
                per = level // length
                lo, n = levels[level].popleft()
                tree.add(level, -n)
            full = min(n, left // per)
            some = left - full * per if full < n else 0
            took = full * per + some
            runs.append((length, rank, rank + took, lo, per, capacity - level))
            rank, left = rank + took, left - took
            put(level - per * length, lo, full)
            if some:
                put(level - some * length, lo + full, 1)
            untouched = n - full - bool(some)
            put(level, lo + full + bool(some), untouched)
    return runs, bins


class _Numbered(dict):
    """Words to numbers; a new word gets the next one and is noted."""

    def __init__(self, words: list[str]) -> None:
        super().__init__(zip(words, range(len(words))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Known:
    """Words by number, from 0, and their ids in one growing array.

    ``numbers`` gives new words numbers, then ``add`` takes the ids of those in
    ``number.new``. ``forget`` drops words not met again, once there are more than ``most``.
    """

    def __init__(self, width: np.dtype, most: int) -> None:
        self.most = most
        self.number = _Numbered([])
        self.ids = np.zeros(1 << 16, width)
        self.ends = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)
        self.n = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.again[at[at < self.n]] = True
        return at

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        at = int(self.ends[self.n - 1]) if self.n else 0
        while at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lens) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[at : at + len(flat)] = flat
        self.ends[self.n : self.n + len(lens)] = at + np.cumsum(lens)
        self.n += len(lens)
        self.number.new = []

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers behind one another, and how many each has."""
        stop = self.ends[at]
        begin = np.where(at > 0, self.ends[at - 1], 0)
        lens = stop - begin
        where = np.repeat(begin - (np.cumsum(lens) - lens), lens)
        where += np.arange(len(where))
        return self.ids[where], lens

    def forget(self) -> None:
        if self.n <= self.most:
            return
        kept = self.again[: self.n].copy()
        if 2 * int(kept.sum()) > self.most:
            kept[:] = False
        words, (flat, lens) = list(itertools.compress(self.number, kept.tolist())), self.take(np.flatnonzero(kept))
        self.__init__(self.ids.dtype, self.most)
        self.number = _Numbered(words)
        self.add(flat, lens)


def _joined(lists: Iterable[list[int]], width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    flat: list[int] = []
    ends = [0]
    for x in lists:
        flat += x
        ends.append(len(flat))
    return np.fromiter(flat, width, len(flat)), np.diff(ends)


#: Marks that may close a word; the apostrophe is left out, since contractions are pre-tokens of their own.
CLOSING = ".,;:!?*$%&|#\"()[]{}<>/+-=_@~^`"


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file, one distinct word at a time.

    Holds for tokenizers whose pre-tokens never span a space, newline, tab or
    carriage return and that put no id for white space; each distinct word is
    encoded once and remembered. Words of letters with closing marks are taken
    apart here and only their parts are given to the file's model: letters and
    marks are pre-tokens of their own in the file named by ``apart``; any other
    file or word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        split = next((x["pattern"].get("Regex", "") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"), "")
        self.apart = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and split.endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        self.tokenize = self.tokenizer.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.byte_level = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

        self.words, self.known_parts = _Known(self.width, WORD_CACHE), _Known(self.width, PART_CACHE)

    def _part(self, text: str) -> list[int]:
        shown = text if text.isascii() else "".join(map(self.byte_level.__getitem__, text.encode()))
        return [t.id for t in self.tokenize(shown)] if text else []

    def _learn(self, words: list[str]) -> None:
        """Words of letters and closing marks as two parts, the others as the whole tokenizer has them."""
        known = self.known_parts
        known.forget()
        column = pa.array(words, pa.large_string())
        core = pc.ascii_rtrim(column, characters=CLOSING)
        ascii_ = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False) if self.apart else np.zeros(len(words), bool)
        size = pc.binary_length(core).to_numpy()
        first, last = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        letters = pc.ascii_lower(core.filter(pa.array(ascii_))).dictionary_encode()
        first[ascii_] = known.numbers(letters.dictionary.to_numpy(zero_copy_only=False).tolist())[letters.indices.to_numpy()]
        apart = ascii_.copy()
        other, whole = [], []
        for i in np.flatnonzero(~ascii_).tolist():
            w = words[i].rstrip(CLOSING)
            if self.apart and w.isalpha() and unicodedata.is_normalized("NFC", w) and "\u03a3" not in w and "\u0130" not in w:
                apart[i] = True
                other.append(w.lower())
            else:
                whole.append(words[i])
        first[apart & ~ascii_] = known.numbers(other)
        bare = pc.binary_length(column).to_numpy() == size
        last[apart] = known.numbers(["" if b else w[len(w.rstrip(CLOSING)) :] for w, b in zip(itertools.compress(words, apart.tolist()), bare[apart].tolist())])
        known.add(*_joined(map(self._part, known.number.new), self.width))
        of_parts, part_lens = known.take(np.stack([first[apart], last[apart]], 1).ravel())
        of_whole, whole_lens = _joined((x.ids for x in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)), self.width)
        lens = np.zeros(len(words), np.int64)
        lens[apart], lens[~apart] = part_lens.reshape(-1, 2).sum(1), whole_lens
        flat = np.zeros(int(lens.sum()), self.width)
        in_parts = np.repeat(apart, lens)
        flat[in_parts], flat[~in_parts] = of_parts, of_whole
        self.words.add(flat, lens)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, given as their bytes and offsets, and where those of each begin and end."""
        self.words.forget()
        data = SPACED[data]
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = data == 32
        ends[offsets[1:]] = True
        ends[0] = False
        bounds = np.concatenate([[0], np.flatnonzero(ends)])
        found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        # a word has the space that ends it
        words = pc.ascii_rtrim(found.dictionary.cast(pa.large_string()), characters=" ").to_numpy(zero_copy_only=False).tolist()
        numbers = self.words.numbers(words)
        if self.words.number.new:
            self._learn(self.words.number.new)
        flat, lens = self.words.take(numbers[found.indices.to_numpy()])
        total = np.concatenate([[0], np.cumsum(lens)])
        return flat, total[np.searchsorted(bounds, offsets, side="right") - 1]


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text (null: empty) and ``end_id``, cut into pieces of at most ``capacity``; ``row`` numbers the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        tail = np.array([end_id], encoder.width)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            data, offsets = text_column(b)
            for lo, hi in doc_runs(offsets, RUN_BYTES):
                flat, cuts = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                rows: list[tuple] = []
                for name, begin, stop in zip(b.column(0).slice(lo, hi - lo).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    ids = np.concatenate([flat[begin:stop], tail])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        cut = ids[at : at + capacity]
                        rows.append((name, k, at, len(cut), cut.tobytes(), row))
                        row += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids", "row"],
                )
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int, tokens_per_group: int = 1 << 23, rows_per_group: int = 1 << 16) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length`` (1..capacity) and ``row`` (a number of their own); ``row`` goes.

    ``pieces`` must give the same rows each time it is read (a written table).
    Ranks are numbered within (length, salt). Each length has as many salts as
    keep a group near ``tokens_per_group`` tokens and ``rows_per_group`` rows, so that a length shared by a
    third of all rows is spread over many tasks. Empty input gives no rows;
    equal rows are packed one by one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    salts = spark.createDataFrame([(n, max(-(-n * m // tokens_per_group), -(-m // rows_per_group))) for n, m in counts.items()] or [], "length int, _salts long")
    # at most ``capacity`` rows
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("row"), F.col("_salts"))).drop("_salts")
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    in_salt = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "row")
    ranked = salted.withColumn("_rank", F.row_number().over(in_salt) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")
    # A run ends where a length or a level does: their number depends on the capacity alone.
    plan = spark.createDataFrame(
        [{"length": a, "_lo": b, "_hi": c, "_bin": d, "_per": e, "_base": f} for a, b, c, d, e, f in runs] or [],
        "length int, _lo long, _hi long, _bin long, _per long, _base long",
    )
    at = F.col("_rank") - F.col("_lo")
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .drop(plan["length"])
        .withColumn("sequence_id", (F.col("_bin") + F.floor(at / F.col("_per"))).cast("long"))
        .withColumn("offset", (F.col("_base") + (at % F.col("_per")) * F.col("length")).cast("long"))
        .drop("row", "_salt", "_rank", "_lo", "_hi", "_bin", "_per", "_base")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids (little-endian, two
    bytes each for vocabularies up to 65,536, else four), sequence_id, offset.
    Null and empty texts are the end id alone; other columns of ``docs`` are
    not carried; repeated rows are packed as often as they occur; an empty
    table gives no rows. Only the ids' table is written, to the shared folder.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, doc_id, text), "pieces")
    return pack_pieces(pieces, capacity)
