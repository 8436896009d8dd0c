"""Operator 5: language of a text.

Multinomial logistic regression on TF-IDF character n-grams (one to three
characters of the lower-cased text, hashed), trained by follow-the-regularised-leader
with elastic-net penalties, so that weights that don't help stay exactly zero.
Confidences are calibrated by a temperature fitted on texts kept from training.
Document frequencies come from all learning texts; the weights from a bounded
sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fold, give_back, map_arrow
from factloom.llm.ngrams import has_letter, hashed_counts

UNKNOWN = "und"
ORDERS = (1, 2, 3)


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, at: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        z = self.logits(at, n) / self.temperature
        p = np.exp(z - z.max())
        return self.langs[int(z.argmax())], float(p.max() / p.sum())


def follow_leader(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], k: int, size: int, alpha: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over sparse rows (places, values)."""
    z, g2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((1.0 + np.sqrt(g2[at])) / alpha + l2)
        return np.where(np.abs(z[at]) > l1, w, 0.0)

    for e in range(epochs):
        for i in np.random.Generator(np.random.PCG64(e)).permutation(len(xs)):
            at, x = np.append(xs[i][0], size), np.append(xs[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[ys[i]] -= 1
            g = x[:, None] * p[None, :]
            more = g2[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(g2[at])) / alpha * w
            g2[at] = more
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """Temperature of least log loss, over a fine grid."""

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(ys)), ys]).mean())

    return min(np.geomspace(0.02, 20, 200).tolist(), key=loss) if len(ys) else 1.0


def learn(
    docs: DataFrame, per_lang: int = 800, bits: int = 14, alpha: float = 0.5, l1: float = 0.05, l2: float = 0.05, epochs: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> LanguageModel | None:
    """A model from rows with a language and a text.

    The weights come from about ``per_lang`` rows of each language, chosen by a
    hash of id and text; of all languages together twice that at most, the first
    by the hash. None without rows.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    size = 1 << bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, langs = np.zeros(size, np.int64), {}
        for b in batches:
            for at, _ in hashed_counts(b, bits, ORDERS, True):
                seen[at] += 1
            for v, n in zip(*(x.to_pylist() for x in b.column("lang").value_counts().flatten())):
                langs[v] = langs.get(v, 0) + n
        at = np.flatnonzero(seen)
        keys = [pa.array([str(i) for i in at.tolist()] + list(langs), pa.string()), pa.array([0] * len(at) + [1] * len(langs), pa.int32())]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([seen[at], list(langs.values())]).astype(np.int64))], names=["key", "kind", "n"])
        give_back()

    # 2^bits cells and the languages: a bounded table
    table = rows.select("text", "lang").mapInArrow(frequencies, "key string, kind int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    langs = {r["key"]: r["n"] for r in table if r["kind"] == 1}
    total = sum(langs.values())
    if not total:
        return None
    df = np.zeros(size)
    for r in table:
        if r["kind"] == 0:
            df[int(r["key"])] = r["n"]
    model = LanguageModel(sorted(langs), np.log((1 + total) / (1 + df)) + 1, np.zeros((size, len(langs))), np.zeros(len(langs)), 1.0, bits)

    share = F.create_map(*[F.lit(x) for k, n in langs.items() for x in (k, min(1.0, per_lang / n))])
    drawn = F.pmod(F.xxhash64("_id", "text", F.lit("langid")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    sample = rows.filter(drawn).orderBy(F.xxhash64("_id", "text"), "_id", "lang").limit(2 * per_lang * len(langs))

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        both = [(at.astype(np.int32).tobytes(), n.astype(np.float32).tobytes()) for at, n in hashed_counts(b, bits, ORDERS, True)]
        return pa.RecordBatch.from_arrays([b.column("lang"), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["lang", "at", "n"])

    got = map_arrow(sample.select("text", "lang"), counted, "lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    order = np.random.Generator(np.random.PCG64(1)).permutation(len(got))
    xs, ys = [], []
    for i in order:
        at, n = np.frombuffer(got[i]["at"], np.int32), np.frombuffer(got[i]["n"], np.float32)
        if len(at):
            xs.append((at, model.vector(at, n)))
            ys.append(model.langs.index(got[i]["lang"]))
    cut = len(xs) - len(xs) // 8
    model.weights, model.bias = follow_leader(xs[:cut], ys[:cut], len(langs), size, alpha, l1, l2, epochs)
    kept = np.array([x @ model.weights[at] + model.bias for at, x in xs[cut:]]).reshape(-1, len(langs))
    model.temperature = best_temperature(kept, np.array(ys[cut:], int))
    return model


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced). Texts that are null or have no letter: ``und``, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits rows, one column for each language

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = [(UNKNOWN, 0.0)] * len(texts)
        if m is not None and len(texts):
            values = [None if t is None else t for t in texts]
            for lo in range(0, len(values), 256):  # copies of few texts at a time
                batch = pa.RecordBatch.from_arrays([pa.array(values[lo : lo + 256], pa.string())], names=["text"])
                for i, (at, n) in enumerate(hashed_counts(batch, m.bits, ORDERS, True), lo):
                    if has_letter(values[i]):
                        out[i] = m.predict(at, n)
            give_back()
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*own, guess(F.col(text).cast("string")).alias("_guess")).select(*own, "_guess.lang_pred", "_guess.score")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Learns from rows of the other folds that have a language; ids, sources and
    languages are no inputs of a prediction. Repeated rows are predicted each,
    a null id is in the fold of the empty text, other columns are not carried;
    an empty table gives no rows. Without learning rows all is ``und``. A very
    long text is read whole by one task, which takes some ten times its size.
    """
    out = fold(doc_id, folds) == held
    model = learn(docs.filter(~out), doc_id=doc_id, text=text, lang=lang)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text).cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
