"""Language identification by sparse multinomial logistic regression on character n-grams.

Letters are lower-cased, everything else is a space; n-grams of one to three characters are hashed into
2^BITS features. A feature's value is its share of the text's n-grams times its inverse document
frequency, which is counted over every training document. The weights are learned by
follow-the-regularised-leader with an elastic-net penalty (L1 sets features to exactly zero, L2 shrinks
the rest) on a sample of about SAMPLE documents per language, drawn by a hash; a part of the sample
is held back to fit one temperature, by which all scores are divided before they become probabilities.

Edge cases: a text that is null or has no letter is `und` with score 0, as is every text when nothing
could be learned. A null lang is never learned. A null doc_id is not held out and not learned from.
Texts are read whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 16
#: Documents per language that the weights are fitted on, about; the bound of what reaches the driver.
SAMPLE = 1000
FOLDS = 5
UNKNOWN = "und"
EPOCHS = 3
#: Scale of the features, so that penalties and steps have their usual size.
SCALE = 100.0

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, one entry each time they occur; empty if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.array([], np.uint32)
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters in a row one space stays
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    mixed = [codes * np.uint32(0x9E3779B1)]
    for n in (2, 3):
        mixed.append((mixed[-1][:-1] ^ np.uint32(n)) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35))
    out = np.concatenate(mixed)
    return ((out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages, with the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        logits = (self.weights[found].sum(axis=0, dtype=np.float64) * (SCALE / len(found)) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_features: int, n_classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs: int = EPOCHS):
    """Weights and bias of a multinomial model. A row has feature numbers, values and its class."""
    z, n = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))

    def weights(at):
        some = z[at]
        return np.where(np.abs(some) > l1, -(some - np.sign(some) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, n_features), np.append(x, 1.0)  # the last feature is the bias
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha * w
            n[at] += g2
    out = weights(np.arange(n_features + 1))
    return out[:-1], out[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        a = logits / np.exp(t)
        a = a - a.max(axis=1, keepdims=True)
        return float((np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(y)), y]).mean())

    low, high, cut = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _document_counts(texts: DataFrame) -> DataFrame:
    """feature, n: documents that hold it, with sums inside each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen = np.zeros(1 << BITS, bool)
                seen[features(text.as_py())] = True
                n += seen
                docs += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[n[at], docs])], ["feature", "n"])

    return texts.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _sample(texts: DataFrame, per_lang: int) -> list:
    """lang and hashed counts of about `per_lang` documents of each language, by a hash of the id."""
    sizes = texts.groupBy("lang").agg(F.count("*").alias("_n"))
    rate = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rates = F.broadcast(sizes.select(F.col("lang").alias("_lang"), (per_lang / F.col("_n")).alias("_rate")))  # one row per language
    some = texts.join(rates, (F.col("lang") == F.col("_lang")) & (rate < F.col("_rate"))).select("doc_id", "lang", "text")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t.as_py()), return_counts=True) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("lang"), pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "at", "counts"])

    rows = some.mapInArrow(convert, "doc_id long, lang string, at binary, counts binary").collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["lang"], bytes(r["at"])))


def train(docs: DataFrame, per_lang: int = SAMPLE) -> Model:
    """A model of the documents with a lang outside fold 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    texts = texts.filter((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["feature"]: r["n"] for r in _document_counts(texts).collect()}  # at most 2^BITS rows
    total = counts.pop(-1, 0)
    idf = np.full(1 << BITS, np.log(total + 1.0) + 1.0)
    for k, n in counts.items():
        idf[k] = np.log((total + 1.0) / (n + 1.0)) + 1.0
    rows = []
    sample = [r for r in _sample(texts, per_lang) if len(r["at"])]
    langs = sorted({r["lang"] for r in sample})
    for r in sample:
        at, n = np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4")
        rows.append((at, n / n.sum() * SCALE * idf[at], langs.index(r["lang"])))
    if not rows:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    back, fit = rows[::5], [r for k, r in enumerate(rows) if k % 5] or rows
    weights, bias = ftrl(fit, 1 << BITS, len(langs))
    logits = np.array([x @ weights[at] + bias for at, x, _ in back])
    temperature = _temperature(logits, np.array([y for *_, y in back]))
    return Model(langs, (weights * idf[:, None]).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # 2^BITS numbers per language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sent.value.predict(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([a for a, _ in said], pa.string()), pa.array([b for _, b in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
