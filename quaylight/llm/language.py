"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text are hashed to ``DIM`` features. Document frequencies
cover every training text. The weights are trained with follow-the-regularised-leader under an elastic net
on a bounded sample (``SAMPLE`` rows, spread evenly over the languages), and one temperature, fitted on a
part of the sample kept aside, turns the scores into probabilities. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.shared import counted, sampled

DIM = 1 << 15
ORDERS = 3
SAMPLE = 5000
_CHUNK = 1 << 20
_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


class Grams:
    """Counts of hashed character n-grams of one text at a time."""

    def __init__(self) -> None:
        self.counts = np.zeros(DIM, np.int64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        text = text.lower()
        counts = self.counts
        for at in range(0, len(text), _CHUNK):
            codes = np.frombuffer(text[at : at + _CHUNK + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            new = min(len(codes), _CHUNK)
            h = np.zeros(len(codes), np.uint32)
            for k in range(ORDERS):
                n = len(codes) - k
                if n <= 0:
                    break
                h = (h[:n] + codes[k:]) * _MULTIPLIERS[k] ^ (h[:n] >> np.uint32(15))
                counts += np.bincount((h[: min(n, new)] ^ (h[: min(n, new)] >> np.uint32(13))) & np.uint32(DIM - 1), minlength=DIM)
        at = np.flatnonzero(counts)
        found = counts[at]
        counts[at] = 0
        return at, found


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = weighted(at, counts, self.idf)
        return self.weights[at].T @ x + self.weights[DIM]

    def predict(self, grams: Grams, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*grams.of(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Per-coordinate FTRL-proximal; the last row of the result is the intercept (not penalised)."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    first = np.full((DIM + 1, 1), l1)
    first[DIM] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        za, pen = z[at], first[at]
        return np.where(np.abs(za) <= pen, 0.0, -(za - np.sign(za) * pen) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    return weights(np.arange(DIM + 1))


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train_language(texts: DataFrame, sample_rows: int = SAMPLE) -> LanguageModel:
    """A model from ``texts`` (doc_id, text, lang). Rows without text, language or a letter teach nothing.

    Languages are ordered by name. With no usable row the model knows no language.
    """
    usable = texts.select("doc_id", "text", "lang").where("text is not null and lang is not null")

    def add(vector: np.ndarray, batch: pa.RecordBatch) -> None:
        local = Grams()
        for text in batch.column("text"):
            text = text.as_py()
            if has_letter(text):
                vector[local.of(text)[0]] += 1
                vector[DIM] += 1

    df = counted(usable.select("text"), add, DIM + 1)
    idf = np.log((1.0 + df[DIM]) / (1.0 + df[:DIM])) + 1.0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Grams()
        for batch in batches:
            rows = []
            for doc, text, lang in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                text = text.as_py()
                if has_letter(text):
                    at, counts = local.of(text)
                    rows.append((doc, lang, at.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["doc_id", "lang", "at", "counts"])

    chosen = sampled(usable.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id", "lang", sample_rows)
    found = sorted(chosen.mapInArrow(features, "doc_id bigint, lang string, at binary, counts binary").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.at, r.counts))
    languages = tuple(sorted({r.lang for r in found}))
    rows = []
    for r in found:
        at, counts = np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4")
        rows.append((at, weighted(at, counts, idf), languages.index(r.lang)))
    if not rows:
        return LanguageModel((), idf, np.zeros((DIM + 1, 0), np.float32), 1.0)
    aside = [row for i, row in enumerate(rows) if i % 5 == 4]
    weights = ftrl([row for i, row in enumerate(rows) if i % 5 != 4], len(languages))
    temperature = 1.0
    if aside and len(languages) > 1:
        scores = np.array([x @ weights[at] + weights[DIM] for at, x, _ in aside])
        temperature = calibrate(scores, np.array([label for *_, label in aside]))
    return LanguageModel(languages, idf, weights.astype(np.float32), temperature)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs`` from the whole text alone.

    ``und`` with score 0 where the text is null, empty or without a letter. Ties go to the first language by
    name. Repeated rows are scored alike; columns of those names are replaced.
    """
    own = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = own.withColumn("lang_pred", F.lit("").cast("string")).withColumn("score", F.lit(0.0)).schema
    names = own.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [shared.value.predict(grams, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return own.mapInArrow(task, shape)
