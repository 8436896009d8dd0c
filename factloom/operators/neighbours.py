"""Neighbour probes of labelled vectors (C08 by cosine, C09 by Euclidean distance)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.vectors import cells, dot, lots_for, pair_values, score, sides, slack, unit
from factloom.storage import written

#: Bins of the scores in which a median is looked for.
BINS = 1 << 16
#: Names whose pairs tell where to look for the medians first; all pairs tell whether they lie there.
TRIED = 2048


class _Lot:
    """Names of a lot by label, in blocks."""

    def __init__(self, frame: pd.DataFrame, measure: str, reach: float, block: int):
        frame = frame.sort_values(["_label", "_key"])
        self.keys, self.labels = frame["_key"].to_numpy(dtype=np.int64), frame["_label"].to_numpy()
        self.x = np.stack(frame["_x"].to_list()).astype(float)
        self.left, self.right = sides(self.x, measure, reach)
        self.best, self.near = np.full(len(frame), -np.inf), []
        self.blocks = [slice(lo, min(lo + block, len(frame))) for lo in range(0, len(frame), block)]
        first = np.flatnonzero(np.append(True, self.labels[1:] != self.labels[:-1])).tolist()
        self.runs = [{self.labels[lo]: (max(lo, b.start), min(hi, b.stop)) for lo, hi in zip(first, [*first[1:], len(frame)]) if lo < b.stop and hi > b.start} for b in self.blocks]

    def meet(self, here: slice, there: slice, s: np.ndarray, off: float) -> None:
        """Keeps the pairs that may be the nearest ones of names of a block."""
        top = s.max(axis=1).astype(float)
        rows = np.flatnonzero((top >= self.best[here] - 2 * off) & np.isfinite(top))
        at = here.start + rows
        self.best[at] = np.maximum(self.best[at], top[rows])
        r, c = cells(s[rows] >= (self.best[at] - 2 * off).astype(s.dtype)[:, None])
        self.near.append((at[r], there.start + c, s[rows][r, c].astype(float)))

    def nearest(self, other: _Lot, measure: str, off: float) -> pd.DataFrame:
        """Each name's nearest in the other lot; ties go to the smaller key."""
        r, c, s = (np.concatenate(t) for t in zip(*self.near)) if self.near else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        fine = s >= self.best[r] - 2 * off
        r, c = r[fine], c[fine]
        v = _values(self.x, other.x, r, c, measure)
        order = np.lexsort((other.keys[c], -v, r))
        first = order[np.unique(r[order], return_index=True)[1]]
        return pd.DataFrame({"k": self.keys[r[first]], "l": self.labels[r[first]], "s": v[first], "ok": other.keys[c[first]], "ol": other.labels[c[first]]})


def _values(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, measure: str) -> np.ndarray:
    """Cosines, or distances below 0, so that both rise with the score."""
    v = np.round(pair_values(x, y, r, c, measure), 12)
    return v if measure == "cosine" else -v


def neighbour_probe(rows: DataFrame, key: str, label: str, vector: str, measure: str = "cosine", block: int = 1000) -> DataFrame:
    """C08 (``cosine``) and C09 (``euclidean``): share of names whose nearest neighbour has their label, and medians within and between labels.

    One row. The share is over labels of two names or more, ties go to the
    smaller key; separation is above 0 where labels hold together. All pairs
    are compared, as the medians ask, in blocks of names, twice: scores in single
    precision are counted below and in a range of each median, then the pairs whose
    scores may be the median's are measured exactly. The ranges come from some
    names' pairs; where the counts tell that a median lies elsewhere, it is looked
    for there. Blocks lie in lots of which a task gets two, so a name is sent once
    for each lot. Names without a label or vector, or with nulls in it, take no
    part; fewer than two names give nulls. ``key`` is a whole number, one row
    each; vectors are of one length.
    """
    whole = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    x = unit(F.col(vector)) if measure == "cosine" else F.col(vector).cast("array<double>")
    known = written(whole.select(F.col(key).cast("long").alias("_key"), F.col(label).cast("string").alias("_label"), x.alias("_x")), "names")
    names, reach, width = known.agg(F.count(F.lit(1)), F.max(F.sqrt(dot(F.col("_x"), F.col("_x")))), F.max(F.size("_x"))).first()
    reach = reach or 0.0
    off = slack(width or 0, measure, reach)
    lots = lots_for(names, block)
    low, high = (-1.0 - 4 * off, 1.0 + 4 * off) if measure == "cosine" else (-2 * reach**2 - 4 * off, 4 * off)
    placed = known.withColumn("_b", F.pmod(F.xxhash64("_key"), F.lit(lots)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    pairs = placed.select("_key", "_label", "_x", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")).groupBy("_i", "_j")
    sign = 1.0 if measure == "cosine" else -1.0
    shared = known.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    acts, alike = shared.agg(F.count(F.lit(1)), F.sum(F.expr("_n * (_n - 1) div 2"))).first()
    total = {True: alike or 0, False: names * (names - 1) // 2 - (alike or 0)}
    middle = {same: ((n - 1) // 2, n // 2) for same, n in total.items() if n}

    def met(frame: pd.DataFrame) -> Iterator[tuple]:
        """Two lots, and of every two of their blocks the scores."""
        i, j = frame["_i"].iat[0], frame["_j"].iat[0]
        parts = [frame[frame["_b"] == k] for k in ({i, j} if i == j else (i, j))]
        if not all(map(len, parts)):
            return
        one = _Lot(parts[0], measure, reach, block)
        two = one if i == j else _Lot(parts[1], measure, reach, block)
        numbers = pd.factorize(np.concatenate([one.labels, two.labels]))[0]  # numbers are compared faster than texts
        one.number, two.number = numbers[: len(one.keys)], numbers[len(one.keys) :]
        for p, a in enumerate(one.blocks):
            for q, b in enumerate(two.blocks):
                if not (i == j and q < p):
                    yield one, two, p, q, one.left[a] @ two.right[b].T

    def inside(one: _Lot, two: _Lot, p: int, q: int, s: np.ndarray, ranges: dict) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
        """Of the pairs within and between labels how many scores are below a range, and which pairs are in it; pairs of a block with itself count once."""
        a, b = one.blocks[p], two.blocks[q]
        if one is two and p == q:
            s[np.tril_indices(len(s))] = np.nan
        runs = [(slice(lo - a.start, hi - a.start), slice(two.runs[q][k][0] - b.start, two.runs[q][k][1] - b.start)) for k, (lo, hi) in one.runs[p].items() if k in two.runs[q]]
        for same, (lo, hi) in ranges.items():
            lo, hi = s.dtype.type(lo), s.dtype.type(hi)
            if same:
                for r, c in runs:
                    part = s[r, c]
                    below = part < lo
                    y, z = cells((part < hi) ^ below)
                    yield same, np.count_nonzero(below), y + r.start, z + c.start
            else:
                below = s < lo
                y, z = cells((s < hi) ^ below)
                other = one.number[a.start + y] != two.number[b.start + z]
                yield same, np.count_nonzero(below) - sum(np.count_nonzero(below[r, c]) for r, c in runs), y[other], z[other]

    def surveyed(ranges: dict, nearest: bool):
        columns = ["same", "bin", "n", "k", "l", "s", "ok", "ol"]

        def survey(frame: pd.DataFrame) -> pd.DataFrame:
            """Of a pair of lots the bins of its scores (-1: those below) and each name's nearest there, in rows of their own."""
            bins, out, one, two = {same: np.zeros(BINS + 1, np.int64) for same in ranges}, [], None, None
            for one, two, p, q, s in met(frame):
                a, b = one.blocks[p], two.blocks[q]
                if nearest:
                    if one is two and p == q:
                        np.fill_diagonal(s, -np.inf)
                    one.meet(a, b, s, off)
                    if not (one is two and p == q):
                        two.meet(b, a, s.T, off)
                for same, below, r, c in inside(one, two, p, q, s, ranges):
                    lo, hi = ranges[same]
                    bins[same][0] += below
                    at = np.clip((s[r, c].astype(float) - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(int)
                    bins[same] += np.bincount(at + 1, minlength=BINS + 1)
            if nearest and one is not None:
                out = [one.nearest(two, measure, off)] + ([] if one is two else [two.nearest(one, measure, off)])
            out += [pd.DataFrame({"same": same, "bin": np.flatnonzero(n) - 1, "n": n[n > 0]}) for same, n in bins.items() if n.any()]
            return pd.concat(out).reindex(columns=columns).astype({"bin": "Int32", "n": "Int64", "k": "Int64", "ok": "Int64", "same": "boolean"}) if out else pd.DataFrame({c: [] for c in columns})

        return written(pairs.applyInPandas(survey, "same boolean, bin int, n long, k long, l string, s double, ok long, ol string"), "survey")

    def tried(frame: pd.DataFrame) -> pd.DataFrame:
        lot, out = _Lot(frame, measure, reach, len(frame)), []
        s = (lot.left @ lot.right.T).astype(float)
        up = np.triu_indices(len(s), 1)
        own = (lot.labels[up[0]] == lot.labels[up[1]]).astype(bool)
        for same in (True, False):
            v = s[up][own == same]
            if len(v):
                wide = 0.006 + 3 / math.sqrt(len(v))
                lo, hi = np.quantile(v, [max(0.0, 0.5 - wide), min(1.0, 0.5 + wide)])
                out.append((same, max(low, lo - 2 * off), min(high, hi + 2 * off)) if wide < 0.5 else (same, low, high))
        return pd.DataFrame(out, columns=["same", "lo", "hi"])

    some = known.orderBy(F.xxhash64("_key"), "_key").limit(TRIED)
    guess = {r["same"]: (r["lo"], r["hi"]) for r in some.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(tried, "same boolean, lo double, hi double").collect()}
    ranges, found, survey = {same: guess.get(same, (low, high)) for same in middle}, {}, None
    for turn in itertools.count():
        got = surveyed(ranges, turn == 0)
        survey = got if survey is None else survey
        counts = got.filter("bin IS NOT NULL").groupBy("same", "bin").agg(F.sum("n").alias("n")).collect()  # at most 2 * BINS + 2 rows
        todo = {}
        for same, (lo, hi) in ranges.items():
            n = np.zeros(BINS + 1, np.int64)
            for r in counts:
                if r["same"] is same:
                    n[r["bin"] + 1] = r["n"]
            upto = np.cumsum(n)
            first, last = (int(np.searchsorted(upto, m, side="right")) for m in middle[same])
            if first == 0 or last > BINS:  # it lies below or above the range, or on both sides of an end
                wider = (low if first == 0 else lo, high if last > BINS else hi)
                if wider != (lo, hi):  # else some scores are no numbers, and there is no median
                    todo[same] = wider
            else:
                step = (hi - lo) / BINS
                found[same] = (lo + (first - 1) * step - 2 * off - step / 2, lo + last * step + 2 * off + step / 2)
        ranges = todo
        if not ranges:
            break

    def exact(frame: pd.DataFrame) -> pd.DataFrame:
        out, under = [], dict.fromkeys(found, 0)
        for one, two, p, q, s in met(frame):
            a, b = one.blocks[p], two.blocks[q]
            for same, below, r, c in inside(one, two, p, q, s, found):
                under[same] += below
                v, n = np.unique(_values(one.x, two.x, a.start + r, b.start + c, measure), return_counts=True)
                lo, hi = found[same]
                at = np.clip((score(-v, "euclidean") if measure != "cosine" else v) - lo, 0, hi - lo) / (hi - lo) * (BINS - 1)
                out.append(pd.DataFrame({"same": same, "bin": at.astype(int), "v": v, "n": n}))
        out += [pd.DataFrame({"same": [same], "bin": [-1], "v": [0.0], "n": [n]}) for same, n in under.items()]
        return pd.concat(out).groupby(["same", "bin", "v"], as_index=False)["n"].sum() if out else pd.DataFrame({"same": [], "bin": [], "v": [], "n": []})

    medians = {True: None, False: None}
    if found:
        measured = written(pairs.applyInPandas(exact, "same boolean, bin int, v double, n long"), "measured")
        counts = measured.groupBy("same", "bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
        for same in found:
            bins = [(r["bin"], r["n"]) for r in counts if r["same"] is same]
            upto = np.cumsum([n for _, n in bins])
            first, last = (int(np.searchsorted(upto, m, side="right")) for m in middle[same])
            values = measured.filter((F.col("same") == same) & F.col("bin").between(bins[first][0], bins[last][0])).groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").collect()  # of one bin, or the two ends' of neighbouring ones
            before = int(upto[first - 1]) if first else 0
            ends = before + np.cumsum([r["n"] for r in values])
            medians[same] = float(np.mean([abs(values[int(np.searchsorted(ends, m, side="right"))]["v"]) if measure != "cosine" else values[int(np.searchsorted(ends, m, side="right"))]["v"] for m in middle[same]]))
    first = survey.filter("k IS NOT NULL").groupBy("k", "l").agg(F.max_by("ol", F.struct("s", -F.col("ok"))).alias("ol"))
    rate = first.join(shared.filter("_n >= 2"), F.col("l") == F.col("_label")).agg(F.avg((F.col("l") == F.col("ol")).cast("double")).alias("top1_nn_same_act_rate"))
    within, between = (F.lit(medians[s]).cast("double") for s in (True, False))
    kind = "cosine" if measure == "cosine" else "distance"
    acts = acts if names >= 2 else 0
    return rate.select(
        "top1_nn_same_act_rate", within.alias(f"median_within_act_{kind}"), between.alias(f"median_between_act_{kind}"),
        (F.lit(sign) * (within - between)).alias("separation"), F.lit(names).cast("long").alias("n_eval_names"), F.lit(acts).cast("long").alias("n_eval_acts"),
    )
