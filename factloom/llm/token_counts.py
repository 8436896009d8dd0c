"""Operator 2: token counts of a unigram segmentation, by a shared trie.

The distinct pre-tokens of a task's texts go into a trie. Every node holds the
forward score of its prefix: the best sum of piece scores that spells it, and
the number of pieces of the best spelling. It depends on the prefix alone, so
pre-tokens with a common prefix share it; a pre-token's count is that of its
last node. The trie starts anew at a bounded size, which changes no count, and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Nodes and words that a trie holds before it starts anew.
MOST_NODES, MOST_WORDS = 1_000_000, 300_000


def unigram_pieces(path: str) -> dict[str, float]:
    """Log probabilities of a ``sentencepiece`` file's pieces.

    Files of merges hold ranks instead of probabilities; their pieces get those
    of a Zipf distribution over the ranks.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    total = np.log(sum(1 / (k + 1) for k in range(len(ids))))
    return {m.id_to_piece(i): float(-np.log(k + 1) - total) for k, i in enumerate(ids)}


class ForwardTrie:
    """Forward scores of prefixes. A character in no piece counts as its UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.other = min(pieces.values(), default=0.0) - 10.0
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]
        self.known: dict[str, int] = {}

    def tokens(self, word: str) -> int:
        """Pieces of the best spelling of one pre-token; ties go to fewer pieces."""
        child, path, node = self.child, [0], 0
        for i, ch in enumerate(word):
            key = node << 21 | ord(ch)
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = self._extend(path, word, i + 1)
            path.append(nxt)
            node = nxt
        return self.count[node]

    def _extend(self, path: list[int], word: str, n: int) -> int:
        """The node of the first ``n`` characters, from the nodes of the shorter prefixes."""
        score, count, pieces, ends = self.score, self.count, self.pieces, self.ends
        size = len(word[n - 1].encode("utf-8", "surrogatepass"))
        best, few = score[path[-1]] + size * self.other, count[path[-1]] + size
        for k in range(n - 1, -1, -1):
            tail = word[k:n]
            if tail not in ends:
                break
            p = pieces.get(tail)
            if p is not None:
                s, c = score[path[k]] + p, count[path[k]] + 1
                if s > best or s == best and c < few:
                    best, few = s, c
        score.append(best)
        count.append(few)
        return len(score) - 1

    def text(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text; pre-tokens are words after a mark."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        known, total, n = self.known, 0, 0
        for w in words:
            if w:
                c = known.get(w)
                if c is None:
                    c = known[w] = self.tokens(MARK + w)
                total += c
                n += 1
        if len(self.score) > MOST_NODES or len(known) > MOST_WORDS:
            self.reset()
        return n, total


_tries: dict[str, ForwardTrie] = {}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text.

    Null and empty texts have none; repeated rows are counted each; other
    columns are not carried; an empty table gives no rows. A very long text is
    read whole by one task, word by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _tries:
            _tries[model] = ForwardTrie(unigram_pieces(model))
        trie = _tries[model]
        for b in batches:
            got = [trie.text(t) if t else (0, 0) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
