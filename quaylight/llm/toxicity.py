"""Toxicity from confirmed toxic texts and unlabelled ones: non-negative positive-unlabelled learning.

Texts are seen as sets of hashed letter n-grams within words (4 letters, and 5 of which the first may be the
space before the word). Document frequencies cover all texts; the ``KEPT`` features that most mark the
confirmed ones against all texts (likelihood ratio) enter a linear numpy classifier. Its risk is the
class-prior-corrected one, pi R_p+ + max(0, R_u- - pi R_p-): no text need be known to be clean. The prior is
the share of toxic labels. The fit uses bounded samples (``POSITIVE`` and ``UNLABELLED`` rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.shared import counted

DIM = 1 << 18
KEPT = 1024
POSITIVE, UNLABELLED = 4000, 12000
CUT = 0.7
_CHUNK = 1 << 20
#: a-z, and bytes of letters beyond ASCII, stand for themselves; all else is a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256))
_A, _B = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Hashed n-grams of a lower-cased UTF-8 text, in chunks that overlap enough to lose none."""
    data = b" " + data
    for at in range(0, len(data), _CHUNK):
        c = np.frombuffer(data[at : at + _CHUNK + 4].translate(_LETTERS), np.uint8)
        if len(c) < 4:
            return
        v = c.astype(np.uint32)
        letter = c != 0
        h = v[:-3]
        for k in range(1, 4):
            h = h * _A ^ v[k : len(v) - 3 + k]
        inside = letter[1:-2] & letter[2:-1] & letter[3:]
        yield _slot(h, letter[:-3] & inside, 4)
        if len(c) > 4:
            yield _slot(h[:-1] * _A ^ v[4:], inside[:-1] & letter[4:], 5)


def _slot(h: np.ndarray, where: np.ndarray, order: int) -> np.ndarray:
    h = (h[where] + np.uint32(order)) * _B
    return (h ^ (h >> np.uint32(15))) & np.uint32(DIM - 1)


def lowered(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        text = text.as_py()
        yield text.lower().encode() if text else b""


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # hash slots
    weights: np.ndarray
    bias: float

    def places(self) -> np.ndarray:
        at = np.full(DIM, -1, np.int32)
        at[self.features] = np.arange(len(self.features))
        return at

    def score(self, places: np.ndarray, data: bytes) -> float:
        found: list[np.ndarray] = []
        for h in grams(data):
            p = places[h]
            found.append(p[p >= 0])
        s = self.bias + (float(self.weights[np.unique(np.concatenate(found))].sum()) if found else 0.0)
        return float(1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, s)))))


def _present(texts: DataFrame, chosen: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 per text: which chosen features it has."""
    places = ToxicityModel(chosen, chosen, 0.0).places()
    shared = texts.sparkSession.sparkContext.broadcast(places)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in lowered(batch.column("text")):
                bits = np.zeros(len(chosen), bool)
                for h in grams(data):
                    p = shared.value[h]
                    bits[p[p >= 0]] = True
                rows.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["bits"])

    rows = texts.select("text").mapInArrow(task, "bits binary").collect()
    out = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(chosen)) for r in rows], np.uint8).reshape(len(rows), len(chosen))
    return out[np.lexsort(out.T)] if len(out) else out


def _frequencies(texts: DataFrame) -> np.ndarray:
    def add(vector: np.ndarray, batch: pa.RecordBatch) -> None:
        seen = np.zeros(DIM, bool)
        for data in lowered(batch.column("text")):
            for h in grams(data):
                seen[h] = True
            at = np.flatnonzero(seen)
            vector[at] += 1
            seen[at] = False
            vector[DIM] += 1

    return counted(texts.select("text"), add, DIM + 1)


def likelihood_ratio(k: np.ndarray, n: int, all_k: np.ndarray, all_n: int) -> np.ndarray:
    """G-squared of a feature among n confirmed texts against all texts; 0 where it is not more frequent."""
    a, b = k / max(n, 1), all_k / max(all_n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = k * np.log(a / b) + (n - k) * np.where(a < 1, np.log((1 - a) / np.maximum(1 - b, 1e-12)), 0)
    return np.where((a > b) & (k > 0), np.nan_to_num(g, nan=0.0, posinf=0.0), 0.0)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic loss over all rows of the samples, Adam steps.

    Where the corrected risk of the clean class, R_u- - pi R_p-, falls below zero, its gradient is turned round.
    """
    p, u = positive.astype(np.float32), unlabelled.astype(np.float32)
    w = np.zeros(p.shape[1] + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(len(w)), np.zeros(len(w))

    def gradient(slope: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.append(x.T @ slope, slope.sum()) / len(x)

    for step in range(1, steps + 1):
        sp, su = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        toxic = 1 / (1 + np.exp(-np.clip(sp, -50, 50)))
        clean = gradient(1 / (1 + np.exp(-np.clip(su, -50, 50))), u) - prior * gradient(toxic, p)
        risk = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        g = prior * gradient(toxic - 1, p) + clean if risk >= 0 else -clean
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(np.float64), float(w[-1])


def train_toxicity(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE, unlabelled_rows: int = UNLABELLED) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); only rows with toxic 1 confirm.

    Null labels and ids are left aside; a document with several labels is confirmed if one of them is 1.
    With no confirmed text every score is 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)).alias("k")).first()
    if not counts.k:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -50.0)
    prior = min(0.9, max(0.001, counts.k / counts.n))
    spot = F.pmod(F.xxhash64(F.lit("positive"), "__id"), F.lit(1 << 30)) / float(1 << 30)
    # At most about ``positive_rows`` ids: small enough for every executor whatever the data.
    confirmed = F.broadcast(known.where((F.col("toxic") == 1) & (spot < min(1.0, positive_rows / counts.k))).select("__id"))
    positive = docs.select(F.col("doc_id").cast("bigint").alias("__id"), "text").join(confirmed, "__id", "left_semi")
    everything = _frequencies(docs)
    marked = _frequencies(positive)
    gain = likelihood_ratio(marked[:DIM], int(marked[DIM]), everything[:DIM], int(everything[DIM]))
    chosen = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    chosen = chosen[gain[chosen] > 0]
    share = min(1.0, unlabelled_rows / max(1, int(everything[DIM])))
    spot = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    p, u = _present(positive, chosen), _present(docs.where(spot < share), chosen)
    if not len(p) or not len(u) or not len(chosen):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -50.0)
    return ToxicityModel(chosen, *fit_nnpu(p, u, prior))


def score_toxicity(docs: DataFrame, model: ToxicityModel, cut: float = CUT) -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 at ``cut`` or more) from the whole text alone.

    A null or empty text has no features: its score is that of the intercept. Repeated rows are scored
    alike; columns of those names are replaced.
    """
    own = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = own.withColumn("score", F.lit(0.0)).schema
    names = own.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value.places()
        for batch in batches:
            scores = [shared.value.score(places, data) for data in lowered(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return own.mapInArrow(task, shape).withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
