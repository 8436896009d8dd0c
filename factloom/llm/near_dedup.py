"""Operator 8: near-duplicates by a chosen-path set similarity join.

Documents with one shingle set form a class; classes are joined. Each of
several independent trees branches classes by minwise tokens: a node picks one
or two of the signature's coordinates (1/threshold on average, so that a pair
at the threshold is expected to stay together in one child), and classes that
agree there go to the same child. Nodes larger than ``largest`` branch on.
Within a node, signatures tell which pairs can be links; every link is
confirmed on the full sets. First each class meets one hub, the member most
like its node; then all pairs that are still in different components are
compared. Pairs within a component need no comparing, so large groups of copies
cost a star, not all their pairs; and a pair that meets in several crowded nodes
is compared in the largest of them and in no other node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textbytes as tb
from factloom.llm.common import doc_runs, give_back, map_arrow, text_column, written

SIG = 64
_MULT = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, SIG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature_table(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (set size), f1 and f2 (fingerprints of the set), sig (minwise tokens)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = text_column(b)
        ids = b.column("doc_id")
        for lo, hi in doc_runs(offs):
            part = data[offs[lo] : offs[hi]]
            start, end, first = tb.word_spans(part, offs[lo : hi + 1] - offs[lo])
            sets = tb.shingle_sets(tb.word_hashes(part, start, end), first, words)
            n = np.array([len(s) for s in sets], np.int64)
            sig = np.zeros((len(sets), SIG), np.uint32)
            f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                at = np.cumsum(n[some]) - n[some]
                f1[some] = tb.mix64(np.add.reduceat(tb.mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), at))
                f2[some] = np.add.reduceat(tb.mix64(flat + np.uint64(0x14057B7EF767814F)), at)
                for k in range(SIG):
                    sig[some, k] = np.minimum.reduceat(flat * _MULT[k], at) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "n", "f1", "f2", "sig"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, f1 long, f2 long, sig binary")


def _sigs(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, SIG)


def branch(path: np.ndarray, owner: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (path, owner): the node's choice of coordinates depends on the path alone."""
    h = tb.mix64(path)
    twice = (h >> np.uint64(40)) % np.uint64(1000) < np.uint64(round(1000 * (1 / threshold - 1)))
    out_p, out_o = [], []
    for pick, who in ((h % np.uint64(SIG), np.arange(len(h))), ((h >> np.uint64(20)) % np.uint64(SIG), np.flatnonzero(twice))):
        c = pick[who]
        value = sig[owner[who], c.astype(np.int64)].astype(np.uint64)
        out_p.append(tb.mix64(path[who] * np.uint64(0x9E3779B97F4A7C15) + (value << np.uint64(8)) + c))
        out_o.append(owner[who])
    return np.concatenate(out_p), np.concatenate(out_o)


def node_table(classes: DataFrame, trees: int, levels: int, threshold: float) -> DataFrame:
    """(node, v) of every class after ``levels`` levels in each tree."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sig, v = _sigs(b.column("sig")), b.column("v").to_numpy()
        nodes, owners = [], []
        for t in range(trees):
            path = np.full(len(v), tb.mix64(np.array([t + 1], np.uint64))[0])
            owner = np.arange(len(v))
            for _ in range(levels):
                path, owner = branch(path, owner, sig, threshold)
            nodes.append(path)
            owners.append(owner)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(v[np.concatenate(owners)])], names=["node", "v"])

    return map_arrow(classes.select("v", "sig"), run, "node long, v long")


def _branch_on(members: DataFrame, threshold: float) -> DataFrame:
    """One more level for (node, v, sig)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        path, owner = branch(b.column("node").to_numpy().view(np.uint64), np.arange(b.num_rows), _sigs(b.column("sig")), threshold)
        at = pa.array(owner)
        return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column("v").take(at), b.column("sig").take(at)], names=["node", "v", "sig"])

    return map_arrow(members.select("node", "v", "sig"), run, "node long, v long, sig binary").dropDuplicates(["node", "v"])


def crowded(members: DataFrame) -> DataFrame:
    """Members of nodes with at least two, of equal nodes one, with the node's size."""
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("v").cast("decimal(20,0)")).alias("_sum")).filter("size > 1")
    once = sizes.groupBy("size", "_sum").agg(F.min("node").alias("node"))
    return members.join(once.select("node", "size"), "node")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates in which each row of a and each row of b agree."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _in_nodes(kind: str, floor: int):
    """Candidate pairs of the nodes in a group of rows (part, node, v, side, label, homes, sig)."""

    def star(v, sig, label, side, before):
        if len(np.unique(label)) < 2:
            return None
        score = np.zeros(len(v), np.int64)
        for k in range(SIG):
            _, back, n = np.unique(sig[:, k], return_inverse=True, return_counts=True)
            score += n[back]
        hub = np.lexsort((v, -score))[0]
        like = (sig == sig[hub]).sum(axis=1)
        ok = (like >= floor) & (label != label[hub])
        return np.column_stack([v[ok], np.full(ok.sum(), v[hub]), like[ok]])

    def needed(v, sig, label, side, before):
        if len(np.unique(label)) < 2:
            return None
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        want = np.zeros(len(v), bool)
        for lo in range(0, len(left), 256):
            i = left[lo : lo + 256]
            ok = (label[i][:, None] != label[right][None, :]) & (before[i] @ before[right].T == 0)
            if not ok.any():
                continue
            ok &= _alike(sig[i], sig[right]) >= floor
            want[i] |= ok.any(axis=1)
            want[right] |= ok.any(axis=0)
        return want

    def run_star(t: pa.Table) -> pa.Table:
        found = [x for _, o in _nodes_of(t) if (x := star(*o)) is not None]
        rows = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)
        give_back()
        return pa.table({"a": np.maximum(rows[:, 0], rows[:, 1]), "b": np.minimum(rows[:, 0], rows[:, 1]), "of": rows[:, 0], "like": rows[:, 2]})

    def run_needed(t: pa.Table) -> pa.Table:
        keep = np.zeros(len(t), bool)
        for at, o in _nodes_of(t):
            if (x := needed(*o)) is not None:
                keep[at] = x
        give_back()
        return t.filter(pa.array(keep)).select(["_g", "part", "v", "side", "label"])

    return run_star if kind == "star" else run_needed


def _nodes_of(t: pa.Table) -> Iterator[tuple[np.ndarray, tuple]]:
    """Rows of each part with two members or more: their places, and v, sig, label, side and which crowded nodes before this one they are in."""
    part, v, side, label, node = (t.column(c).to_numpy() for c in ("part", "v", "side", "label", "node"))
    sig = _sigs(t.column("sig"))
    lists = t.column("homes").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    order = np.argsort(part, kind="stable")
    for o in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(o) > 1:
            size = ends[o + 1] - ends[o]
            row = np.repeat(np.arange(len(o)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            home = flat[np.repeat(ends[o], size) + place]
            here = home == node[o[0]]
            own = np.full(len(o), np.iinfo(np.int64).max)
            own[row[here]] = place[here]
            some = place < own[row]
            names, col = np.unique(home[some], return_inverse=True)
            before = np.zeros((len(o), len(names)), np.float32)
            before[row[some], col] = 1
            yield o, (v[o], sig[o], label[o], side[o], before)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 1024) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices."""
    n = np.array([len(s) for s in sets])
    ids, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], number[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(col, [lo, lo + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _links_in_nodes(percent: int):
    """Links between members of different labels, one for each two labels of a node, by full sets."""

    def run(t: pa.Table) -> pa.Table:
        part, v, side, label = (t.column(c).to_numpy() for c in ("part", "v", "side", "label"))
        lists = t.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        order = np.argsort(part, kind="stable")
        a_out, b_out = [], []
        for o in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            left, right = np.flatnonzero(side[o] <= 0), np.flatnonzero(side[o] >= 0)
            if len(o) < 2 or not len(left) or not len(right):
                continue
            sets = [flat[ends[i] : ends[i + 1]] for i in o]
            n = np.array([len(x) for x in sets])
            both = common_counts(sets, left, right)
            linked = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (label[o][left][:, None] != label[o][right][None, :])
            i, j = np.nonzero(linked)
            if len(i):
                la, lb = label[o][left[i]], label[o][right[j]]
                _, once = np.unique(np.column_stack([np.minimum(la, lb), np.maximum(la, lb)]), axis=0, return_index=True)
                a_out.append(v[o][left[i[once]]])
                b_out.append(v[o][right[j[once]]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))
        give_back()
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def _spread_rows(members: DataFrame, labels: DataFrame | None, leaf: int, group_rows: int) -> DataFrame:
    """Rows (_g, part, node, v, side, label, homes, sig) of the nodes' chunks of about ``leaf`` members.

    Without labels every member is in one chunk. With labels only nodes that
    hold more than one label come, and a pair of two members of a node's main
    label needs no comparing: the other members, ``leaf`` at a time, go to every
    chunk. They stand left there (side -1), the chunk's own members right (1),
    those that are both on both sides (0). So rows grow with the members and
    with the few others, not with the square of a node.
    """
    if labels is None:
        here = members.withColumn("label", F.col("v"))
    else:
        here = members.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        parts = here.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("_main"), F.max("n").alias("_most"), F.count(F.lit(1)).alias("_labels")).filter("_labels > 1")
        here = here.join(main.select("node", "_main", "_most"), "node")
    here = here.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("size") / leaf)).cast("int"))
    here = here.withColumn("_c", F.pmod(F.xxhash64("v", "node"), F.col("_n")).cast("int"))
    if labels is None:
        here = here.withColumn("part", F.xxhash64("node", "_c")).withColumn("side", F.lit(0))
    else:
        other = F.col("label") != F.col("_main")
        groups_of = F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("_most")) / leaf)).cast("int")
        here = here.withColumn("_m", groups_of).withColumn("_o", F.when(other, F.pmod(F.xxhash64("node", "v", F.lit("other")), F.col("_m")).cast("int")))
        right = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda o: F.struct(F.col("_c").alias("c"), o.alias("o")))
        left = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda c: F.struct(c.alias("c"), F.col("_o").alias("o")))
        here = here.withColumn("_at", F.explode(F.when(other, F.array_union(right, left)).otherwise(right)))
        here = here.withColumn("part", F.xxhash64("node", "_at.c", "_at.o"))
        is_right, is_left = F.col("_at.c") == F.col("_c"), F.coalesce(F.col("_at.o") == F.col("_o"), F.lit(False))
        here = here.withColumn("side", F.when(is_right & is_left, 0).when(is_left, -1).otherwise(1))
    groups = max(1, -(-members.count() // group_rows))
    return here.select(F.pmod("part", F.lit(groups)).alias("_g"), "part", "node", "v", "side", "label", "homes", "sig")


def _floor(threshold: float) -> int:
    """Signature agreements below which a pair is no link, by 3.5 standard deviations."""
    return int(np.floor((threshold - 3.5 * (threshold * (1 - threshold) / SIG) ** 0.5) * SIG))


def hub_pairs(members: DataFrame, threshold: float, leaf: int, group_rows: int = 8192) -> DataFrame:
    """Each class with the hub most like it: pairs (a > b)."""
    rows = _spread_rows(members, None, leaf, group_rows)
    found = rows.groupBy("_g").applyInArrow(_in_nodes("star", _floor(threshold)), "a long, b long, of long, like long")
    best = F.max_by(F.struct("a", "b"), F.struct("like", "b")).alias("p")
    return found.groupBy("of").agg(best).select("p.a", "p.b").distinct()


def remaining_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, leaf: int, group_rows: int = 2048) -> DataFrame:
    """Links (a > b) between different labels: within nodes all pairs are compared on full sets.

    Only members whose signature comes near that of a member with another
    label bring their sets.
    """
    rows = _spread_rows(members, labels, leaf, group_rows)
    schema = "_g long, part long, v long, side int, label long"
    needed = written(rows.groupBy("_g").applyInArrow(_in_nodes("needed", _floor(percent / 100)), schema), "needed")
    # equal parts of several trees are compared once
    shape = needed.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64("v", "side").cast("decimal(20,0)")).alias("_s"))
    once = shape.groupBy("_n", "_s").agg(F.min("part").alias("part"))
    needed = needed.join(once.select("part"), "part", "left_semi")
    return needed.join(sets, "v").groupBy("_g").applyInArrow(_links_in_nodes(percent), "a long, b long").distinct()


def set_table(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(v, shingles) of the classes in ``wanted`` (v, rep)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = text_column(b)
        for lo, hi in doc_runs(offs):
            part = data[offs[lo] : offs[hi]]
            start, end, first = tb.word_spans(part, offs[lo : hi + 1] - offs[lo])
            sets = tb.shingle_sets(tb.word_hashes(part, start, end), first, words)
            n = np.array([len(s) for s in sets], np.int64)
            f1 = [tb.mix64(np.add.reduce(tb.mix64(s ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True))[0] if len(s) else np.uint64(0) for s in sets]
            flat = np.concatenate(sets).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(f1, np.uint64).view(np.int64)), lists], names=["v", "shingles"])

    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text")).join(wanted.select("rep").distinct(), "rep", "left_semi")
    sets = map_arrow(rows.select("text"), run, "v long, shingles array<long>")
    return sets.join(wanted.select("v"), "v", "left_semi").dropDuplicates(["v"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("v").alias("a"), F.col("shingles").alias("_sa"))
    b = sets.select(F.col("v").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - F.col("_both")
    return pairs.join(a, "a").join(b, "b").withColumn("_both", both).filter(100 * F.col("_both") >= percent * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of (a, b): label is the smallest vertex it reaches.

    Smallest labels spread along the edges and then jump to their label's
    label, so that long chains end in a logarithmic number of rounds; labels only
    ever fall, so that the rounds end. Every round is written to the shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("_near"))
        spread = labels.join(around, F.col("v") == F.col("a")).select("v", "label", F.least("label", "_near").alias("_new"))
        jump = spread.join(labels.select(F.col("v").alias("_v"), F.col("label").alias("_far")), F.col("_new") == F.col("_v"), "left")
        step = written(jump.select("v", F.least("_new", "_far").alias("label"), (F.least("_new", "_far") < F.col("label")).alias("moved")), "labels")
        labels = step.select("v", "label")
        if step.filter("moved").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    trees: int = 12,
    levels: int = 4,
    deepest: int = 12,
    leaf: int = 1024,
    largest: int = 4096,
    crowded_from: int = 64,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Links are pairs with 100 * intersection >= percent * union of their sets of
    ``words``-word shingles, all confirmed on the full sets. A pair at a
    threshold of 0.8 meets in a node of at least one of the 12 trees with
    probability 0.9999 at 4 levels, 0.999 at 7, 0.998 at 8 and 0.99 at 12; only
    classes whose nodes hold more than ``largest`` come below level 4. Of the
    pairs that meet, the signatures lose less than 0.0005. component_id is the
    smallest doc_id of the component. Null and empty texts and those without
    words have no shingles and are linked with nothing. A row with a null
    doc_id stands alone: component_id null, kept. Rows that repeat a doc_id are
    judged each by its text. Other columns are not carried; an empty table
    gives no rows. A very long text is read whole by one task; its set, eight
    bytes a shingle, travels as one row.
    """
    threshold = percent / 100
    table = written(signature_table(docs, words, doc_id, text), "signatures")
    known = table.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy(F.col("f1").alias("v"), "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    members = written(crowded(node_table(classes, trees, levels, threshold).distinct()), "nodes")
    kept, depth = members.filter(F.col("size") <= largest), levels
    large = members.filter(F.col("size") > largest)
    if not large.isEmpty():
        large = large.join(classes.select("v", "sig"), "v")
        while depth < deepest and not large.isEmpty():
            below = written(crowded(_branch_on(large, threshold)), "nodes")
            kept = kept.unionByName(below.filter(F.col("size") <= largest).drop("sig"))
            large, depth = below.filter(F.col("size") > largest), depth + 1
        kept = kept.unionByName(large.drop("sig"))

    # a class is in at most 2^depth nodes of a tree; largest nodes first
    crowd = F.sort_array(F.collect_list(F.when(F.col("size") > crowded_from, F.struct("size", "node"))), asc=False)
    wanted = classes.select("v", "rep", "sig").join(kept.groupBy("v").agg(F.transform(crowd, lambda x: x["node"]).alias("homes")), "v")
    members = written(kept.join(wanted.select("v", "sig", "homes"), "v"), "members")
    sets = written(set_table(docs, wanted.select("v", "rep"), words, doc_id, text), "sets")
    first = written(confirmed(hub_pairs(members, threshold, leaf), sets, percent), "links")
    labels = components(first)
    second = written(remaining_links(members, labels, sets, percent, leaf), "links")
    labels = components(first.unionByName(second))

    named = classes.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select(F.col("v").alias("f1"), "f2", "n", "component_id")
    linked = known.drop("sig").join(named, ["f1", "f2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = table.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
