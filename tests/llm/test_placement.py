"""Packing, mixing, sharding, media and exact search against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from factloom.llm import draws, media, mixing, packing, queries, sharding, topk

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, extra string, shard int, length string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 9, "y") for i, t, s in rows], DOC)


EDGES = [(1, None, "a"), (2, "", "a"), (3, "one two  three\nfour", None), (4, "tie tie", "b"), (4, "tie tie", "b"), (None, "no id", "b"), (5, "w " * 9000, "b")]


def best_fit_decreasing(lengths, capacity):
    """Bins by the plain method: for each piece, look at all open bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 97])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 30, 400]))]
    hist = {n: lengths.count(n) for n in lengths}
    runs, bins = packing.plan_runs(hist, capacity)
    fill = {}
    for length, lo, hi, first, per, base in runs:
        for r in range(lo, hi):
            fill.setdefault(first + (r - lo) // per, []).append((base + (r - lo) % per * length, length))
    assert sum(map(len, fill.values())) == len(lengths) and len(fill) == bins
    for parts in fill.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in fill.values()) == best_fit_decreasing(lengths, capacity)


def test_pack_edges_and_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_TOKENIZER)
    got = packing.pack_documents(docs(spark, EDGES), queries.WORD_TOKENIZER, capacity=64).collect()
    want = sorted(t.encode(x or "", add_special_tokens=False).ids + [1] for _, x, _ in EDGES)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["start"] - 64 * r["piece"]), []).append(r)
    whole = []
    for rows in by.values():
        rows.sort(key=lambda r: r["piece"])
        copies = sum(r["piece"] == 0 for r in rows)
        ids = [i for r in rows[::copies] for i in np.frombuffer(r["ids"], "<u2").tolist()]
        whole += [ids] * copies
    assert sorted(whole) == want
    assert packing.pack_documents(docs(spark, []), queries.WORD_TOKENIZER).count() == 0


def test_words_met_again_are_tokenized_once(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "WORD_CACHE", 60)
    monkeypatch.setattr(packing, "PART_CACHE", 60)
    rng, t, seen = random.Random(4), Tokenizer.from_file(queries.WORD_TOKENIZER), []
    encoder = packing.WordEncoder(queries.WORD_TOKENIZER)
    monkeypatch.setattr(encoder, "tokenize", lambda x, f=encoder.tokenize: seen.append(x) or f(x))
    odd = ["Straße,", "ΟΔΟΣ", "İzmir", "e\u0301t\u00e9", "don't", "x2!", "a\u00a0b", "\u3000", "...", "中文", "", "I", "co-op;", "\x0b", "😀", "É."]
    for _ in range(40):
        words = ["common", "Common,", *rng.sample(odd, 6), *("".join(rng.choices("abcdefgh", k=6)) for _ in range(12))]
        texts = [rng.choice(" \n\t").join(rng.sample(words, k)) for k in (20, 9, 0, 1)] + ["", " ", "end \r"]
        data = [x.encode() for x in texts]
        offsets = np.cumsum([0, *map(len, data)])
        flat, cuts = encoder.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
        assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(encoder.words.number) < 120 and len(seen) > 300
    assert seen.count("common") == 1


def test_pack_query_against_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_TOKENIZER)
    rows = queries.op1_pack(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        part = ids[r["start"] : r["start"] + 4096]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 4096
    assert len(bins) == len(best_fit_decreasing([r["length"] for r in rows], 4096))


def test_fill_targets():
    assert mixing.fill_targets([10, 10, 10], [5, 2, 1], 30, 3) == [18.75, 7.5, 3.75]
    out = mixing.fill_targets([1, 100, 100], [5, 2, 1], 201, 3)
    assert out[0] == 3 and sum(out) == pytest.approx(201) and out[1] == pytest.approx(2 * out[2])
    assert mixing.fill_targets([0, 5], [5, 2], 5, 3) == [0, 5]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))


def test_shard_draws_add_up():
    counts = np.array([1000, 37, 0, 412])
    total = int(counts.sum())
    shards = -(-total // 100)
    seen = np.zeros(4, int)
    for s in range(shards):
        n, before = mixing.shard_draw(counts, shards, 100, s, 3)
        assert n.sum() == min(100, total - 100 * s) and (before == seen).all()
        seen += n
    assert (seen == counts).all()


@pytest.mark.parametrize(("good", "bad", "n"), [(5, 7, 4), (30, 10, 25), (100, 300, 50), (3, 200, 150), (40, 40, 40), (1, 1, 1), (10, 3, 12), (6, 0, 4), (0, 6, 4), (7, 9, 16), (7, 9, 0)])
def test_rejection_has_the_law_of_the_draw(good, bad, n):
    rng, rounds = np.random.default_rng(good + 7 * n), 3000
    low, high = max(0, n - bad), min(good, n)
    law = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(low, high + 1)]
    seen = np.bincount([draws.by_rejection(rng, good, bad, n) - low for _ in range(rounds)], minlength=len(law))
    assert len(seen) == len(law)
    often = [(x, p * rounds) for x, p in zip(seen, law) if p * rounds > 5]
    assert sum((x - e) ** 2 / e for x, e in often) < len(often) + 5 * math.sqrt(2 * len(often)) + 5


def test_draws_beyond_numpys_limit():
    rng = np.random.default_rng(3)
    good, bad, n = 3 * 10**12, 7 * 10**12, 2 * 10**12
    spread = math.sqrt(n * 0.3 * 0.7 * (good + bad - n) / (good + bad - 1))
    z = (np.array([draws.hypergeometric(rng, good, bad, n) for _ in range(1500)]) - n * 0.3) / spread
    assert abs(z.mean()) < 0.12 and abs(z.var() - 1) < 0.2 and abs((z**4).mean() - 3) < 0.9
    counts = np.array([10**11, 0, 5, 4 * 10**10])
    got = draws.split_draw(rng, counts, 10**10)
    assert got.sum() == 10**10 and (got >= 0).all() and (got <= counts).all()


def test_large_ranges_are_drawn_once_for_a_task(monkeypatch):
    monkeypatch.setattr(draws, "NUMPY_LIMIT", 500)
    counts = np.array([1000, 37, 0, 412])
    known, seen = {}, np.zeros(4, int)
    for s in range(15):
        n, before = mixing.shard_draw(counts, 15, 100, s, 3, known)
        fresh, _ = mixing.shard_draw(counts, 15, 100, s, 3)
        assert (n == fresh).all() and (before == seen).all()
        seen += n
    assert (seen == counts).all() and 0 < len(known) < 8


def test_every_pass_takes_each_block_once(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(7 + 13 * (i % 9))), "abc"[i % 3] if i % 3 < 2 or i < 12 else "c") for i in range(60)]
    spans, laid = mixing.mix_spans(docs(spark, rows), block_words=16, slots_per_shard=8)
    place = {(r["source_no"], r["at"]): r for r in laid.collect()}
    sizes, taken = {}, {}
    for (s, at), r in sorted(place.items()):
        assert at == sizes.get(s, 0)  # documents of a source lie one after another
        sizes[s] = at + r["size"]
        taken[s] = r["target"]
    words = {}
    for r in spans.collect():
        at, first, n = r["at"], r["first_word"], r["n_words"]
        assert 0 <= first and n > 0 and first + n <= place[r["source_no"], at]["size"]
        assert (at + first) // 16 == (at + first + n - 1) // 16 == r["block"]
        for w in range(at + first, at + first + n):
            words.setdefault((r["source_no"], r["epoch"]), []).append(w)
    for (s, epoch), found in words.items():
        assert len(found) == len(set(found))  # no word twice in a pass
        if epoch < round(taken[s]) // sizes[s]:
            assert len(found) == sizes[s]
    for s, n in sizes.items():
        assert sum(len(f) for (t, _), f in words.items() if t == s) == min(round(taken[s]), 3 * n)


def test_mix_query(spark):
    rows = queries.op4_mix(spark, SF).collect()
    again = queries.op4_mix(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target = {}, {}
    for r in rows:
        s, size = source[r["doc_id"]]
        assert r["size"] == size and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    for s in taken:
        assert abs(taken[s] - target[s]) <= 1


def test_mix_edges(spark):
    spans, laid = mixing.mix_spans(docs(spark, EDGES), block_words=8)
    rows = mixing.taken_words(spans, laid).collect()
    assert len(rows) == len(EDGES)
    assert sorted(r["size"] for r in rows) == [0, 0, 2, 2, 2, 4, 9000]
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    spans, laid = mixing.mix_spans(docs(spark, []))
    assert mixing.taken_words(spans, laid).count() == 0


def test_mix_documents_texts(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)) + "\n", "ab"[i % 2]) for i in range(40)]
    d = docs(spark, rows)
    out = mixing.mix_documents(d, block_words=16).collect()
    assert out[0].asDict().keys() == set(d.columns)
    spans, laid = mixing.mix_spans(d, block_words=16)
    want = {r["doc_id"]: r["taken"] for r in mixing.taken_words(spans, laid).collect()}
    got = {}
    for r in out:
        words = r["text"].split()
        assert all(w.startswith(f"w{r['doc_id']}x") for w in words)
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
    assert got == {k: v for k, v in want.items() if v}


def test_shards_exact_and_stable(spark):
    rows = queries.op7_shard(spark, SF).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(v) for v in counts.values())[-1] - min(map(len, counts.values())) <= 1 and len(counts) == 8
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sorted(map(str, rows)) == sorted(map(str, queries.op7_shard(spark, SF).collect()))


def test_shard_settling_is_clockwise():
    nodes = sharding.ring(3, 4, 64)
    rng = random.Random(1)
    counts = {c: rng.randint(0, 9) for c in range(64)}
    n = sum(counts.values())
    plan = sharding.settle(counts, nodes, 64, sharding.bounds(n, 3, 0.0))
    got = {}
    for cell, lo, hi, shard, slot in plan:
        got.setdefault(shard, []).extend(range(slot, slot + hi - lo))
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    assert sum(map(len, got.values())) == n
    loose = sharding.settle(counts, nodes, 64, [n] * 3)
    for cell, lo, hi, shard, _ in loose:
        assert shard == next((s for c, s in nodes if c >= cell), nodes[0][1])


def test_shard_edges(spark):
    hot = [(7, "same", "a")] * 20_000 + [(i, "t", "a") for i in range(500)]
    out = sharding.assign_shards(docs(spark, hot + EDGES), ["doc_id", "text"], shards=4)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "shard", "slot"] and len(rows) == len(hot) + len(EDGES)
    for s in range(4):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine))) and abs(len(mine) - len(rows) / 4) < 1
    assert sharding.assign_shards(docs(spark, []), ["doc_id"]).count() == 0


def test_shards_move_little(spark):
    d = docs(spark, [(i, "t", "a") for i in range(4000)])
    a = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(d, ["doc_id"], shards=8, epsilon=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(d, ["doc_id"], shards=9, epsilon=0.25).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


def test_media_round_trip(spark):
    rows = media.read_media(media.encode_media(docs(spark, EDGES)), keep_pcm=True).collect()
    assert len(rows) == len(EDGES)
    for r, (_, text, _) in zip(sorted(rows, key=lambda r: r["n_bytes"]), sorted(EDGES, key=lambda e: len((e[1] or "").encode()))):
        raw = (text or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert bytes(r["payload"]) == want and r["n_bytes"] == len(raw)
        tag, rate, data = media.read_wav(bytes(r["pcm"]))
        assert (tag, rate, len(data)) == (media.PCM, 16000, 4 * len(want))
    assert media.read_media(media.encode_media(docs(spark, []))).count() == 0


def test_media_tables_and_blocks():
    assert media.MULAW_PCM[255] == 0 and media.MULAW_PCM[0] == -32124 and media.MULAW_PCM[128] == 32124
    assert media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM[0xAA] == 32256
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 36)).astype(np.uint8)
    got = media.decode_ima(blocks)
    for row, out in zip(blocks.tolist(), got.tolist()):
        v = int(np.int16(np.uint16(row[0] | row[1] << 8)))
        i, want = min(row[2], 88), [v]
        for byte in row[4:]:
            for code in (byte & 15, byte >> 4):
                s = int(media.IMA_STEPS[i])
                d = (s >> 3) + (s if code & 4 else 0) + (s >> 1 if code & 2 else 0) + (s >> 2 if code & 1 else 0)
                v = max(-32768, min(32767, v - d if code & 8 else v + d))
                i = max(0, min(88, i + int(media.INDEX_STEP[code & 7])))
                want.append(v)
        assert out == want


def test_media_query(spark):
    rows = queries.op6_media(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        raw = texts[r["doc_id"]]
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        m = media.wav(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())


VEC = "vec_id long, embedding array<double>, score int"


def brute(rows, k):
    vecs = [(i, [int(np.floor(256 * x)) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in vecs if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q and len(w) == len(v))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("per_shard,per_block", [(10_000, 1000), (150, 4)])
def test_topk_against_brute_force(spark, per_shard, per_block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(2).tolist(), 0) for i in range(700)] + [(2000 + i, [0.5] * 6, 0) for i in range(300)]
    rows += [(3001, None, 0), (3002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (3003, [float("inf")] * 6, 0), (3050, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (3100, [1.0, 2.0], 0)]
    df = topk.whole_vectors(spark.createDataFrame(rows, VEC))
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, per_shard, per_block).collect()
    assert {tuple(r) for r in got} == brute(rows, 5)
    assert len(got) == len(brute(rows, 5))


def test_topk_empty(spark):
    df = topk.whole_vectors(spark.createDataFrame([], VEC))
    assert topk.top_k(df, df).count() == 0
