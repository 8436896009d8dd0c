"""The similarity join against all pairs."""

import random
import re

import pytest

from factloom.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, v long, label string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)), d is None or d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, bases=12, copies=25):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for b in range(bases):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


EDGES = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, "ONE"), (9006, "one two"), (None, "one"), (9004, "one"), (9004, "something else"), (9007, "a b c d e"), (9008, "x " * 5000)]


@pytest.mark.parametrize("seed,k,leaf", [(1, 4, 1024), (2, 5, 1024), (3, 4, 8)])
def test_against_all_pairs(spark, seed, k, leaf):
    rows = corpus(seed) + EDGES
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    got = nd.near_duplicates(df, words=k, percent=80, leaf=leaf).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, 80)


@pytest.mark.parametrize("leaf,largest,least", [(64, 4096, 0.999), (64, 128, 0.99)])
def test_recall_in_a_crowded_node(spark, leaf, largest, least):
    """One family of near copies around the threshold, in chunks of a node and in nodes that branch on: of all linked pairs, those found in one component."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocab) for _ in range(100)]
    rows = []
    for d in range(600):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((d, " ".join(t)))
    found = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, leaf=leaf, largest=largest).collect()}
    sets = [shingles(t, 4) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 10_000
    assert sum(found[i] == found[j] for i, j in links) >= least * len(links)


def test_rows_of_a_node_grow_with_its_others_only(spark):
    """A node of 400 members with one main label and five others in chunks of 50: the others alone meet every chunk."""
    members = spark.range(400).selectExpr("7L as node", "400L as size", "id as v", "array(7L) as homes", "cast('' as binary) as sig")
    labels = spark.range(395).selectExpr("id as v", "0L as label")
    rows = nd._spread_rows(members, labels, 50, 1000).collect()
    assert len(rows) == 395 + 5 * 8
    met = {(left["v"], right["v"]) for left in rows for right in rows if left["part"] == right["part"] and left["side"] <= 0 <= right["side"]}
    assert all((o, v) in met for o in range(395, 400) for v in range(400))


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 499)], "a long, b long")
    assert {r["v"]: r["label"] for r in nd.components(edges).collect()} == {**{i: 0 for i in range(101)}, 499: 499, 500: 499}
