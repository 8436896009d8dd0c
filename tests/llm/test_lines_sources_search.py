"""Line dedup, source audit and ranked search against plain code and DuckDB."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import divergence, lexical, line_dedup, queries

SF = "/root/testdata/sf0.001"
#: clashing and unused columns beside those that are read
DOC = "doc_id long, text string, lang string, source string, line string, term string, rank int, h1 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", "y", 3, "z") for i, t, lang, s in rows], DOC)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


LONG = "a line that is held by all of them"
LINES = [
    (1, f"{LONG}\nshort\n  {LONG.upper()}\t", "en", "a"),
    (2, f"one\n{LONG}\none", "en", "a"),
    (3, f"\x0b{LONG}\r", "en", "b"),
    (4, "twice is not enough here\nx", "de", "b"),
    (5, "Twice is not enough here\n\n", "de", None),
    (6, None, None, "b"),
    (7, "", "en", "a"),
    (8, "1234567890123456789é\n1234567890123456789", "en", "a"),
    (9, "1234567890123456789É\n1234567890123456789", "en", "a"),
    (10, "1234567890123456789é\n1234567890123456789", "en", "a"),
    (11, "1234567890123456789é\n1234567890123456789", "en", "a"),
    (None, f"{LONG}\n{LONG}", "en", "a"),
    (None, f"nothing else\n{LONG}", "en", "a"),
    (3, f"again\n{LONG}", "en", "b"),
    (3, f"again\n{LONG}", "en", "b"),
]


def plain_dedup(rows, least_chars=20, least_docs=3):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    def place(i):
        return -(1 << 63) if i is None else i

    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(place(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [len(held[key(x)]) >= least_docs and max(held[key(x)]) != place(i) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_lines_against_plain(spark, batches):
    got = line_dedup.dedup_lines(docs(spark, LINES), batches=batches)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert Counter(tuple(r) for r in got.collect()) == plain_dedup(LINES)


def test_lines_of_random_and_long_texts(spark):
    rng = random.Random(5)
    pool = [f"{'common' if i % 3 else 'Common'} sentence number {i // 2} of the pool" for i in range(60)]
    rows = [(i * 7 % 301, "\n".join(rng.choices(pool, k=rng.randint(0, 4))), "en", "a") for i in range(120)]
    rows.append((400, "\n".join(pool[i % 60] + f" {i % 30000}" for i in range(60_000)), "en", "a"))
    rows.append((401, "\n".join(pool[i % 60] + f" {i}" for i in range(20_000)) + "\n" + "w" * 1_000_000, "en", "a"))
    rows.append((402, rows[-1][1], "en", "a"))
    got = line_dedup.dedup_lines(docs(spark, rows), batches=5)
    assert Counter(tuple(r) for r in got.collect()) == plain_dedup(rows)


def test_no_lines(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def test_runs_are_sorted_disjoint_and_levelled(spark):
    runs = line_dedup.LineRuns(spark, buckets=4)
    rng = np.random.default_rng(1)
    seen, counts, top = set(), Counter(), {}
    for b in range(6):
        rows = {(int(h), 0, 1000 - 10 * b - int(d)) for h, d in zip(rng.integers(0, 300, 400), rng.integers(0, 10, 400))}
        fresh = runs.add(spark.createDataFrame(sorted(rows), "h1 long, h2 long, _doc long"))
        keys = {h for h, _, _ in rows}
        assert {r["h1"] for r in fresh.collect()} == keys - seen
        seen |= keys
        for h, _, d in rows:
            counts[h] += 1
            top[h] = max(top.get(h, 0), d)
        stored = [[r["h1"] for r in run.collect()] for run in runs.runs()]
        assert sum(map(len, stored)) == len(seen) and set().union(*stored) == seen  # no key in two runs
        assert [x is not None for x in runs.levels] == [(b + 1) >> i & 1 == 1 for i in range(len(runs.levels))]
    assert {(r["h1"], r["top"]) for r in runs.repeated(9).collect()} == {(h, top[h]) for h, n in counts.items() if n >= 9}


def test_older_runs_are_read_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, buckets=4)
    for b in range(2):
        runs.add(spark.createDataFrame([(h, h, 10 - b) for h in range(b * 5, b * 5 + 20)], "h1 long, h2 long, _doc long"))
    a = spark.createDataFrame([(1, 1, 1)], "h1 long, h2 long, _doc long")
    own = runs._stored(a.select("h1", "h2").repartition(4, "h1", "h2"))
    plan = own.join(runs.runs()[0].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


SOURCES = [
    (1, "Alpha beta beta, gamma! 12 naïve", "en", "a"), (2, "alpha beta\x7fdelta naïve", "en", "b"), (3, "ALPHA beta gamma-gamma naïve", "en", "c"),
    (4, "alpha gamma delta delta", "en", "a"), (4, "alpha gamma delta delta", "en", "a"), (5, None, "en", "d"), (6, "", None, None), (7, "1 2 3", "de", "a"),
    (8, "nur hier", "de", "b"), (None, "alpha", None, "x"), (9, "alpha", None, "y"), (10, "alpha alpha", "", "x"), (11, "日本 日本 語", "ja", "a"), (12, "日本", "ja", "b"), (13, "日本 語 語", "ja", "b"),
]


def plain_audit(rows, least=3, most=200):
    cut = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    texts = [(lang or "", s or "", [lower(w) for w in cut.findall(t or "")]) for _, t, lang, s in rows]
    out = []
    for lang in {x for x, _, _ in texts}:
        here = [(s, w) for x, s, w in texts if x == lang]
        df = Counter(t for _, w in here for t in set(w))
        kept = sorted((t for t, n in df.items() if n >= least), key=lambda t: t.encode())
        count = {s: Counter() for s, _ in here}
        for s, w in here:
            count[s].update(x for x in w if x in set(kept))
        everything = sum(count.values(), Counter())

        def share(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        q, p = share(everything), {s: share(c) for s, c in count.items()}
        for s in count:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found[:last], 1)]
    return sorted(out)


def test_audit_against_plain(spark):
    got = divergence.audit_sources(docs(spark, SOURCES))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(SOURCES)
    assert sorted(tuple(r) for r in divergence.audit_sources(docs(spark, SOURCES), least_docs=1, most_terms=2).collect()) == plain_audit(SOURCES, 1, 2)


def test_audit_of_many_sources_blocks_and_a_long_text(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{'klmno'[i % 5]}" for i in range(120)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{int(rng.random() ** 2 * 40)}") for i in range(400)]
    rows.append((900, " ".join(rng.choices(words, k=200_000)), "en", "s1"))
    monkeypatch.setattr(divergence, "BLOCK", 2000)
    monkeypatch.setattr(divergence, "PER_GROUP", 100)
    got = divergence.audit_sources(docs(spark, rows).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows)


def test_no_sources(spark):
    assert divergence.audit_sources(docs(spark, [])).collect() == []


def plain_search(rows, items, k=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = [(i, [lower(w) for w in cut.findall(t or "")]) for i, t in rows]
    n, total = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= {lower(w) for w in cut.findall(t or "")}
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in words:
            tf, score = Counter(w), 0
            for t in terms & set(w):
                m = 100 - 90 + 90 * len(w) * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta BETA 12"), (2, None), (3, ""), (4, "unheard of"), (5, "naïve 語"), (5, "alpha"), (None, "delta"), (6, "alpha")]


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], "item_id long, text string, rank int, term string, score int")


@pytest.mark.parametrize("pairs", [500_000, 3])
def test_search_against_plain(spark, pairs):
    rows = [(i, t) for i, t, *_ in SOURCES]
    got = lexical.ranked_search(docs(spark, SOURCES), asked(spark, ITEMS), k=3, pairs=pairs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, ITEMS, 3)


def test_search_of_many_shards_and_a_long_text(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(rng.randint(0, 900) if rng.random() < 0.99 else None, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(1500)]
    rows.append((5000, " ".join(rng.choices(words, k=300_000))))
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    monkeypatch.setattr(lexical, "SHARD", 40_000)
    got = lexical.ranked_search(docs(spark, [(i, t, "en", "a") for i, t in rows]).repartition(2), asked(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, items)


def test_no_search(spark):
    assert lexical.ranked_search(docs(spark, []), asked(spark, ITEMS)).collect() == []
    assert lexical.ranked_search(docs(spark, SOURCES), asked(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_treaps_prune_and_find_the_same(seed, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 4)
    rng = np.random.default_rng(seed)
    n, terms = 3000, 6
    lengths = rng.integers(1, 50, n)
    places = [np.sort(rng.choice(n, rng.integers(1, n // 2), replace=False)) for _ in range(terms)]
    tfs = [rng.integers(1, 6 if seed % 2 else 2, len(p)) for p in places]
    treaps = lexical.Treaps(lengths, list(range(terms)), [len(p) for p in places], np.concatenate(places).astype(np.int32), np.concatenate(tfs), n, int(lengths.sum()))
    for t in range(terms):  # heap order above, search order below
        a, b = treaps.span[t]
        for x in range(a, b):
            for child, less in ((treaps.left[x], True), (treaps.right[x], False)):
                if child >= 0:
                    assert treaps.impact[child] <= treaps.impact[x] and (treaps.place[child] < treaps.place[x]) == less
    weights = [(t, int(w)) for t, w in enumerate(rng.integers(0, 9000, terms))]
    scores = treaps.added([x for x in weights if x[1]], 0, n)
    order = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], i))[:10]
    assert sorted(treaps.search(weights, 10, 0), key=lambda x: (-x[0], x[1])) == [(int(scores[i]), i) for i in order]
    visited = []
    monkeypatch.setattr(treaps, "added", lambda w, lo, hi: visited.append(hi - lo) or lexical.Treaps.added(treaps, w, lo, hi))
    treaps.search([(0, 10)], 1, 0)
    assert sum(visited) < n // 2


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_source_audit", "op13_search"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in cur.description)
    want = Counter(tuple(dict(zip([d[0] for d in cur.description], r))[c] for c in names) for r in cur.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names and Counter(tuple(r) for r in got.select(*names).collect()) == want


def test_kept_text_is_digested(spark):
    rows = queries.QUERIES["op11_line_dedup"](spark, SF)
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(r["kept_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows.filter(F.col("n_dropped") > 0).collect())
