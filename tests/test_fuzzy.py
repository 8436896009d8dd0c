"""Banded pairs of names at a low threshold against brute force over all pairs."""

import random
from itertools import combinations

import pytest

from factloom import plans
from factloom.operators import fuzzy

SF = "/root/testdata/sf0.001"


def plain_jaro(a, b):
    """Jaro by explicit positions; half of the matched places that differ are transpositions, not rounded."""
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = {}, []
    for i, ch in enumerate(a):
        spots = [j for j in range(len(b)) if abs(i - j) <= max(reach, 0) and b[j] == ch and j not in taken]
        if spots:
            taken[spots[0]] = i
            left.append(ch)
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    m, t = len(left), sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_pairs_at_a_low_threshold(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_name", "p_size").na.drop()
    rows = sorted({(r.p_name, r.p_size) for r in part.collect()})
    want = {(a, b) for (a, x), (b, y) in combinations(rows, 2) if a < b and abs(x - y) <= 2 and plain_jaro(a, b) >= 0.8}
    names = spark.createDataFrame(rows, "name string, year int")
    got = {(r.a, r.b) for r in fuzzy.similar_pairs(names, 0.8, year="year", window=2).collect()}
    assert got == want and want


def test_standard_values():
    assert round(plain_jaro("martha", "marhta"), 6) == 0.944444 and round(plain_jaro("dixon", "dicksonx"), 6) == 0.766667


def test_whole_grid_of_clusters(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_name", "p_size").collect()
    years = {}
    for r in part:
        years[r.p_name] = min(r.p_size, years.get(r.p_name, r.p_size))
    pairs = [(a, b, plain_jaro(a, b), abs(years[a] - years[b])) for a, b in combinations(sorted(years), 2)]
    want = set()
    for distance in (0.10, 0.15, 0.20, 0.25, 0.30):
        for window in (None, 2):
            label = {n: n for n in years}
            edges = [(a, b) for a, b, s, gap in pairs if s >= 1 - distance and (window is None or gap <= window)]
            moved = True
            while moved:
                moved = False
                for a, b in edges:
                    low = min(label[a], label[b])
                    if label[a] != label[b]:
                        label[a] = label[b] = low
                        moved = True
            want |= {(f"jw_t{distance:.2f}_{'unblocked' if window is None else 'yw2'}", n, x) for n, x in label.items()}
    got = [tuple(r) for r in plans.queries()["name_grid_all"](spark, SF).select("variant_id", "measure_name", "label").collect()]
    assert len({v for v, *_ in got}) == 10 and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("least", [0.4, 0.7, 0.85, 0.95])
def test_letters_lose_no_pair(spark, least):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("aabcdeé 語", k=rng.randint(0, 9))) for _ in range(130)} | {"", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 40})
    want = {(a, b) for a, b in combinations(names, 2) if a and plain_jaro(a, b) >= least}
    df = spark.createDataFrame([(n,) for n in [*names, None, names[3]]], "name string")
    assert [tuple(r) for r in fuzzy.similar_pairs(df, least).select("a", "b").collect() if (r.a, r.b) not in want] == []
    assert {(r.a, r.b) for r in fuzzy.similar_pairs(df, least).collect()} == want


def test_best_matches_of_random_names(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choices("abcdef ", k=rng.randint(0, 8))) for _ in range(60)})
    other = sorted({n[1:] + rng.choice("abc") for n in names} | {""})
    a = spark.createDataFrame([(n, 1990 + i % 5) for i, n in enumerate(names)], "name string, y int")
    b = spark.createDataFrame([(n, 1990 + i % 4) for i, n in enumerate(other)], "candidate string, z int")
    for bonus in (None, ("y", "z")):
        want = set()
        for i, n in enumerate(names):
            def rank(j, c):
                s = 1.0 if n == c else plain_jaro(n, c) if n and c else 0.0
                return s + (0.05 if bonus and abs(i % 5 - j % 4) <= 1 else 0), s
            best = max(enumerate(other), key=lambda x: (rank(*x)[0], [-ord(ch) for ch in x[1]] + [1]))
            top = max(rank(*x)[0] for x in enumerate(other))
            best = min(c for j, c in enumerate(other) if rank(j, c)[0] == top)
            if rank(other.index(best), best)[1] >= 0.8:
                want.add((n, best))
        got = {(r["name"], r["candidate"]) for r in fuzzy.best_matches(a, b, 0.8, bonus_years=bonus).collect()}
        assert got == want


def test_no_nested_loop(spark):
    df = spark.createDataFrame([("abc",), ("abd",)], "name string")
    plans_ = [fuzzy.similar_pairs(df, 0.8), fuzzy.best_matches(df, df.toDF("candidate"))]
    for p in plans_:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
