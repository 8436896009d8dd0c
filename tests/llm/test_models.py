"""The classifiers, token counts and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from factloom.llm import langid, quality, queries, token_counts
from factloom.llm.common import read_table

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, at long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", 1, "x", 2) for i, t, la in rows], DOC)


EDGES = [(1, None, "en"), (2, "", "en"), (3, "123 !! 4", "en"), (4, "the and of", None), (4, "the and of", None), (None, "der und die", "de"), (5, "é" * 20000, "fr")]


def test_language_held_out(spark):
    rows = queries.op5_langid(spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = langid.identify(docs(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [(1, "ab", None)])).collect()} == {"und"}


def test_leader_keeps_useless_weights_at_zero():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for i in range(400):
        y = i % 2
        at = np.array([y, 2 + int(rng.integers(50))])
        xs.append((at, np.array([1.0, 0.3])))
        ys.append(y)
    w, _ = langid.follow_leader(xs, ys, 2, 52, 0.5, 1.0, 0.1, 2)
    assert (w[2:] == 0).mean() > 0.8 and w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert langid.best_temperature(5 * z, y) == pytest.approx(5, rel=0.15)


def test_quality_held_out(spark):
    rows = queries.op10_quality(spark, SF).join(read_table(spark, SF, "labels").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (3, 0)], "doc_id long, quality int")
    rows = quality.classify(docs(spark, EDGES), labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.classify(docs(spark, []), labels).count() == 0
    assert quality.classify(docs(spark, EDGES), labels.limit(0)).count() == len(EDGES)


def test_risk_is_kept_from_going_negative():
    rng = np.random.default_rng(2)
    pos = rng.normal(1, 1, (200, 5)).astype(np.float32)
    unl = np.concatenate([rng.normal(1, 1, (160, 5)), rng.normal(-1, 1, (40, 5))]).astype(np.float32)
    p, u = quality.Moments.of(pos), quality.Moments.of(unl)
    w = quality.fit_pu(p, u, 0.8)
    assert quality.risk(w, p, u, 0.8)[1] >= 0
    # the classes part where the calibrated score does, as in predictions
    z = unl @ w[:-1] + w[-1]
    slope, shift = quality.calibrate(z, (np.arange(200) < 160).astype(int))
    assert (slope * z[160:] + shift < 0).mean() > 0.8 and (slope * (pos @ w[:-1] + w[-1]) + shift > 0).mean() > 0.8
    # the risk from moments is that of the rows
    out = pos @ w[:-1] + w[-1]
    assert quality.risk(w, p, u, 0.8)[0] == pytest.approx(0.8 * ((1 - out) ** 2 / 4).mean())


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_is_that_of_the_unlabelled(share):
    """The labelled rows are half and half; the estimate follows the unlabelled ones."""
    rng = np.random.default_rng(3)
    pos, neg = rng.normal(0.3, 0.2, (900, 6)), rng.normal(0, 0.2, (900, 6))
    unl = np.concatenate([rng.normal(0.3, 0.2, (int(8000 * share), 6)), rng.normal(0, 0.2, (int(8000 * (1 - share)), 6))])
    assert quality.estimate_prior(*map(quality.Moments.of, (pos, neg, unl)), 0.5) == pytest.approx(share, abs=0.05)


def test_quality_scores_by_brute_force(spark):
    """The whole computation again, text by text, without Spark's sums."""
    import collections
    import zlib

    from factloom.llm.ngrams import hashed_counts

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect()}
    labels = collections.defaultdict(list)
    for r in read_table(spark, sf, "labels").collect():
        if r["quality"] is not None and r["doc_id"] is not None:
            labels[r["doc_id"]].append(r["quality"])
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in rows}

    def vector(text):
        x, raw = np.zeros(1024), (text or "").encode()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                h = 0
                for c in raw[i : i + n]:
                    h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
                x[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 22] += 1
        return np.sqrt(x / max(x.sum(), 1))

    x = {d: vector(t) for d, t in rows.items()}
    known = [d for d in rows if d in labels and not held[d]]
    y = np.array([min(labels[d]) for d in known])
    one = np.array([x[d] for d in known])
    unl = np.array([x[d] for d in rows if not held[d]])
    m = {k: quality.Moments.of(v) for k, v in (("p", one[y > 0]), ("n", one[y == 0]), ("u", unl))}
    w = quality.fit_pu(m["p"], m["u"], quality.estimate_prior(m["p"], m["n"], m["u"], 0.5))
    slope, shift = quality.calibrate(one @ w[:-1] + w[-1], y)
    for r in queries.op10_quality(spark, sf).collect():
        z = slope * (x[r["doc_id"]] @ w[:-1] + w[-1]) + shift
        assert r["held_out"] == held[r["doc_id"]] and r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-3)


def test_characters():
    from factloom.llm.ngrams import characters

    texts = ["Aé", "", "ŁÓ\U0001f600z", "ß中"]
    raw = [t.encode() for t in texts]
    point, cuts = characters(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert ["".join(map(chr, point[a:b])) for a, b in zip(cuts[:-1], cuts[1:])] == [t.lower() for t in texts]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns_and_without_rows(spark, name, stage):
    """Columns named like a stage's own ones, null and repeated ids, null texts and sources, and empty tables."""
    own = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, lang_pred string, epoch int, size int, component_id string, kept string, length string, row string, _runs string"
    text = read_table(spark, SF, "documents").filter("lang = 'en' AND length(text) > 400").orderBy("doc_id").limit(60).select("doc_id", "text").collect()
    fill = ("1", "2", "3", 4, 5, "6", "7", "8", "9", "0")
    rows = [(r["doc_id"], r["text"], "en", "web" if r["doc_id"] % 3 else None, len(r["text"]), *fill) for r in text]
    rows += [(None, text[0]["text"] + " more", "en", "web", 1, *fill), (text[1]["doc_id"], text[2]["text"] + " other words here", "en", "web", 1, *fill), (10**9, None, "en", "web", 1, *fill), (10**9 + 1, "", None, None, 1, *fill)]
    df = spark.createDataFrame(rows, own)
    for some in (df, df.limit(0)):
        got = stage(spark, some, SF)
        kept = got.collect()
        if name != "pack":
            assert got.columns == df.columns
            assert all((r["score"], r["predicted"], r["lang_pred"], r["epoch"], r["row"]) == ("1", "2", "3", 4, "9") for r in kept)
    assert not kept
    if name == "near_dedup":
        assert sum(r["doc_id"] is None for r in stage(spark, df, SF).collect()) == 1


def plain_count(pieces, word):
    other = min(pieces.values()) - 10
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        options = [(best[i - 1][0] + size * other, best[i - 1][1] + size)]
        options += [(best[j][0] + pieces[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in pieces]
        best[i] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1][1]


def test_token_counts_against_plain_viterbi(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_WORDS", 50)
    pieces = token_counts.unigram_pieces(queries.PIECE_MODEL)
    texts = [r["text"] for r in read_table(spark, "/root/testdata/sf0.001", "documents").limit(25).collect()] + ["", "a\tb\x0bc 日本 ☃", "xx xx"]
    trie = token_counts.ForwardTrie(pieces)
    for t in texts:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", t) if w]
        assert trie.text(t) == (len(words), sum(plain_count(pieces, token_counts.MARK + w) for w in words))
    rows = token_counts.token_counts(docs(spark, EDGES), queries.PIECE_MODEL).collect()
    assert sorted((r["n_words"] for r in rows)) == [0, 0, 1, 3, 3, 3, 3]
    assert token_counts.token_counts(docs(spark, []), queries.PIECE_MODEL).count() == 0


def test_pipeline_stages(spark):
    d = read_table(spark, SF, "documents")
    seen = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == d.columns, name
        before, after = {r["doc_id"] for r in seen.select("doc_id").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        seen = out
    clean = {r["doc_id"] for r in read_table(spark, SF, "labels").filter("quality = 1").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, d, SF).collect()}
    assert len(clean & kept) > 0.9 * len(clean)
    packed = corpus_pipeline.run(spark, SF)
    rows = packed.select("doc_id", "length", "sequence_id", "offset").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in seen.select("doc_id").collect()}
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096


def test_rows_of_null_and_repeated_ids_pass_the_stages(spark):
    d = read_table(spark, SF, "documents")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(60))

    rows = [(1, text(1)), (1, text(2)), (2, text(1)), (None, text(3)), (None, text(4)), (5, text(5)), (5, text(5)), (6, text(2) + " more"), (7, text(7))]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text")})
    made = made.select(*(F.col(c).cast(kinds[c]) for c in d.columns))
    first = corpus_pipeline.keep_first(spark, made, SF)
    want = [(1, text(1)), (1, text(2)), (5, text(5)), (7, text(7)), (None, text(3)), (None, text(4))]
    assert sorted(((r["doc_id"], r["text"]) for r in first.collect()), key=str) == sorted(want, key=str)
    doubled = spark.createDataFrame(want * 30, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text")})
    mixed = corpus_pipeline.mix(spark, doubled.select(*(F.col(c).cast(kinds[c]) for c in d.columns)), SF)
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} >= set(want)
