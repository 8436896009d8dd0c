"""The suffix tree and the unigram base against plain counting."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from suffix_tree import grow_tree

from factloom.llm import lm_scoring as lm
from factloom.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, n long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def base(rows):
    train = [words(t) + [None] for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = words(t) + [None]
        out.append((d, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def test_query_base_and_held_out(spark):
    rows = queries.op3_lm_score(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for d, n_tokens, known, n, b in base(docs):
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, known, n) and r["base_score"] == pytest.approx(b)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)


def test_held_out_texts_beat_the_unigrams(spark):
    held = queries.op3_lm_score(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert len(held) > 1000
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "a B"), (4, "é\0 x" * 700), (5, "\n\n")]
    got = lm.score_documents(spark.createDataFrame([(d, t, "q", 3) for d, t in rows], SCHEMA)).collect()
    want = sorted(((d, n, k, m, round(b, 6)) for d, n, k, m, b in base(rows)), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def tree_of(texts, depth, keep):
    rows = Counter()
    for t in texts:
        s = [lm.END] * depth + t
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                code = 0
                for x in s[i - d : i]:
                    code = code << lm.BITS | x
                rows[d, code, s[i]] += 1
    return grow_tree(tuple(zip(*((*k, n) for k, n in rows.items()))), depth, keep)


@pytest.mark.parametrize("keep", [0.0, 3.0])
def test_automaton_takes_the_longest_kept_suffix(keep):
    rng = random.Random(4)
    texts = [[rng.choice([97, 98, 99, 32]) for _ in range(rng.randint(0, 40))] + [lm.END] for _ in range(30)]
    tree = tree_of(texts, 3, keep)
    sym = np.array([x for t in texts for x in [lm.END] * 3 + t], np.int16)
    count = np.array([len(t) for t in texts])
    begin = np.cumsum(count + 3) - count
    got = tree.score(sym, begin, count, piece=7)
    assert got == pytest.approx(tree.score(sym, begin, count, piece=1000), rel=1e-5)
    # every state's probabilities sum to one over all 257 symbols
    p = 10.0 ** tree.logp.astype(float)
    rest = lm.SYMBOLS - (p.shape[1] - 1)
    assert p[:, :-1].sum(axis=1) + rest * p[:, -1] == pytest.approx(1.0, rel=1e-4)


def test_symbols_spell_the_words():
    texts = ["Ab  c\n", "", " x", "é"]
    raw = b"".join(t.encode() for t in texts)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    sym, begin, count, _ = lm.symbols(np.frombuffer(raw, np.uint8), offs, 2)
    got = [sym[b : b + c].tolist() for b, c in zip(begin, count)]
    assert got == [[97, 98, 32, 99, 256], [256], [120, 256], [0xC3, 0xA9, 256]]
    assert len(lm.ngram_codes(sym, begin, count, 3)) == count.sum()


def counted(texts, depth):
    codes = Counter()
    for t in texts:
        s = [lm.END] * depth + t
        for i in range(depth, len(s)):
            code = 0
            for x in s[i - depth : i + 1]:
                code = code << lm.BITS | x
            codes[code] += 1
    key = np.array(sorted(codes), np.int64)
    return key, np.array([codes[k] for k in key.tolist()])


@pytest.mark.parametrize("keep", [0.0, 3.0])
def test_levels_have_the_probabilities_of_the_automaton(keep):
    rng = random.Random(5)
    texts = [[rng.choice([97, 98, 99, 32]) for _ in range(rng.randint(0, 40))] + [lm.END] for _ in range(30)]
    levels = []
    for length in range(5):
        levels.append(lm.grow_level(*counted(texts, 4), length, levels[-1] if levels else None, 1, keep))
    other = [[rng.choice([97, 98, 99, 32, 200]) for _ in range(20)] + [lm.END] for _ in range(10)]
    tree = tree_of(texts, 4, keep)
    for t in texts + other:
        sym, n = np.array([lm.END] * 4 + t, np.int16), np.array([len(t)])
        codes = lm.ngram_codes(sym, np.array([4]), n, 5)
        assert np.log10(lm.probabilities(levels, codes)).sum() == pytest.approx(tree.score(sym, np.array([4]), n)[0], rel=1e-4)


def test_a_rare_context_stays_in_a_large_corpus(spark):
    """About ten equal texts among 3,000,000 learning symbols are under a share of 4e-6; the tree still learns them."""
    rng = random.Random(6)
    filler = [(7 * i, " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(500)), "q", 3) for i in range(900)]
    rare = [(10_000_000 + i, "xylophonqz", "q", 3) for i in range(12)]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(filler + rare, SCHEMA)).collect()}
    assert max(got[d] for d, *_ in rare) > -12


def test_pieces_spell_the_whole_text():
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "C", "é", " ", "\n ", "xyz"]) for _ in range(rng.randint(1, 60)))
        raw, depth = np.frombuffer(text.encode(), np.uint8), rng.choice([4, 6])
        whole, begin, count, _ = lm.symbols(raw, np.array([0, len(raw)]), depth)
        got, codes = [], []
        for lo, hi, head, last in lm.cut_text(raw, rng.choice([1, 3, 8]), depth):
            sym, at, n, _ = lm.symbols(raw[lo:hi], np.array([0, hi - lo]), depth, [head], np.array([last]))
            got += sym[at[0] : at[0] + n[0]].tolist()
            codes += lm.ngram_codes(sym, at, n, depth + 1).tolist()
        assert got == whole[begin[0] :].tolist() and codes == lm.ngram_codes(whole, begin, count, depth + 1).tolist()


def test_long_texts_are_scored_as_whole_ones(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([0, 3, 400]))) + rng.choice(["", " \n"]), "q", 3) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r["doc_id"]: r for r in lm.score_documents(df).collect()}
    cut = {r["doc_id"]: r for r in lm.score_documents(df, block_bytes=256).collect()}
    assert whole.keys() == cut.keys() and len(cut) == 60
    for d, r in whole.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (cut[d]["n_tokens"], cut[d]["n_known"], cut[d]["train_tokens"])
        assert (r["base_score"], r["score"]) == pytest.approx((cut[d]["base_score"], cut[d]["score"]))


def test_one_text_of_many_megabytes(spark):
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 24 << 20)).decode()
    rows = [(1, text, "q", 3), (2, "one more", "q", 3)]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["n_tokens"] == len(text.split()) + 1 and got[1]["score"] < 0 and len(got) == 2


@pytest.mark.parametrize("depth", [3, 7])
def test_depths_that_do_not_fit_are_refused(spark, depth):
    with pytest.raises(ValueError, match="4 to 6"):
        lm.score_documents(spark.createDataFrame([], SCHEMA), depth=depth)


@pytest.mark.parametrize("counted", [True, False])
def test_a_tally_holds_little_more_than_its_distinct_keys(counted):
    import tracemalloc

    rng = np.random.default_rng(5)
    some = [rng.integers(0, 60_000, 20_000) for _ in range(60)]
    tracemalloc.start()
    t = lm.Tally(1 << 15, counted=counted)
    for x in some:
        t.add(x)
    keys, counts = t.total()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, n = np.unique(np.concatenate(some), return_counts=True)
    assert (keys == want).all() and (not counted or (counts == n).all())
    assert peak < 150 * len(want)  # bytes; all sorted lots together would take several times that
    assert not len(lm.Tally(counted=counted).total()[0])
