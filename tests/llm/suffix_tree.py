"""The plain form of the suffix tree, an automaton, against which the levels are tested."""

from dataclasses import dataclass

import numpy as np

from factloom.llm.lm_scoring import BITS, SYMBOLS


@dataclass
class SuffixTree:
    """An automaton over byte symbols: next state and log10 probability of each (state, column)."""

    column: np.ndarray
    follow: np.ndarray
    logp: np.ndarray
    depth: int
    root: int = 0

    def score(self, sym: np.ndarray, begin: np.ndarray, count: np.ndarray, piece: int = 1024) -> np.ndarray:
        """log10 probability of each text.

        Long texts are stepped through in pieces side by side: the state depends
        on the last ``depth`` symbols alone, so a piece starts that far ahead.
        """
        parts = -(-count // piece)
        doc = np.repeat(np.arange(len(count)), parts)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * piece
        size = np.minimum(piece, count[doc] - at)
        order = np.argsort(-size, kind="stable")
        place, size, doc = (begin[doc] + at - self.depth)[order], size[order], doc[order]
        state = np.full(len(doc), self.root, np.int64)
        total = np.zeros(len(doc))
        col = self.column[sym]
        width = self.logp.shape[1]
        follow, logp = self.follow.ravel(), self.logp.ravel()
        for step in range(int(size.max(initial=0)) + self.depth):
            n = len(size) if step < self.depth else int(np.searchsorted(-size, -(step - self.depth), side="left"))
            cell = state[:n] * width + col[place[:n] + step]
            if step >= self.depth:
                total[:n] += logp[cell]
            state[:n] = follow[cell]
        return np.bincount(doc, weights=total, minlength=len(count))


def grow_tree(rows: tuple, depth: int, keep_bits: float) -> SuffixTree:
    """The tree from arrays (length, context, next, count) of all candidate contexts; the empty context has length 0."""
    length, context, symbol, number_of = (np.asarray(x, np.int64) for x in rows)
    order = np.lexsort((symbol, context, length))
    length, context, symbol, number_of = length[order], context[order], symbol[order], number_of[order]
    at_root = length == 0
    seen, root = symbol[at_root], number_of[at_root]
    column = np.full(SYMBOLS, len(seen), np.int64)
    column[seen] = np.arange(len(seen))
    base = np.full(len(seen) + 1, 1.0)
    base[:-1] += root
    dist = {(0, 0): (base / (root.sum() + SYMBOLS)).astype(np.float32)}
    new = np.flatnonzero((np.diff(length) != 0) | (np.diff(context) != 0)) + 1
    edges = np.concatenate([[0], new, [len(length)]]).tolist()

    def suffix(k: tuple[int, int]) -> tuple[int, int]:
        return (k[0] - 1, k[1] & ((1 << BITS * (k[0] - 1)) - 1)) if k[0] else k

    def prefix(k: tuple[int, int]) -> tuple[int, int]:
        return (k[0] - 1, k[1] >> BITS)

    def kept_suffix(k: tuple[int, int]) -> tuple[int, int]:
        while k not in dist:
            k = suffix(k)
        return k

    for lo, hi in zip(edges[:-1], edges[1:]):
        if lo == hi or not length[lo]:
            continue
        k = (int(length[lo]), int(context[lo]))
        up = dist[kept_suffix(suffix(k))]
        counts = number_of[lo:hi].astype(float)
        some, n = column[symbol[lo:hi]], counts.sum()
        if n * float((counts / n * np.log2(counts / n / up[some])).sum()) >= keep_bits:
            p = up * ((hi - lo) / (n + hi - lo))
            p[some] += counts / (n + hi - lo)
            dist[k] = p
    states = {(0, 0)}
    for k in dist:
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in states:
                states.add(x)
                todo += [suffix(x), prefix(x)]
    order = sorted(states)
    number = {k: i for i, k in enumerate(order)}
    follow = np.zeros((len(order), len(seen) + 1), np.int32)
    logp = np.zeros((len(order), len(seen) + 1), np.float32)
    longer: dict[tuple[int, int], list[int]] = {}
    for k in order[1:]:
        longer.setdefault(prefix(k), []).append(number[k])
    for i, k in enumerate(order):  # by length: the suffix's row is complete, and holds where no longer state follows
        logp[i] = np.log10(dist[kept_suffix(k)])
        if k[0]:
            follow[i] = follow[number[suffix(k)]]
        for j in longer.get(k, ()):
            follow[i, column[order[j][1] & ((1 << BITS) - 1)]] = j
    return SuffixTree(column, follow, logp, depth)
