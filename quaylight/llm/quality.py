"""Document quality: a classifier's evidence and the record of the site, shrunk hierarchically.

Each text gives a few measures (capitals, symbols, repetition, ...) to a logistic model fitted on a bounded
sample of labelled rows (``SAMPLE``). Per path and host the labelled outcomes and, at a lower weight, the
classifier's probabilities of all other texts are summed; a path's rate is shrunk towards its host's and a
host's towards the global one. How strongly is estimated at each level from the spread of its groups, by the
moments of a beta-binomial; the estimate is itself shrunk towards ``STRENGTH``, with the weight of ``PRIOR``
observations, so that a few sites cannot decide it. A labelled document's own label is no part of its site's rate.
The site then shifts the document's log-odds by how far its rate lies from the global rate: a sparse site hardly
does.

Host and path are columns of the caller's choice. ``documents`` has no url, so the query and the pipeline pass
``source`` as host and ``lang`` as path: their path level is a language within a source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.shared import settle, stored
from quaylight.llm.words import INSIDE, PLAIN, text_parts, text_slices, word_hashes

SAMPLE = 8000
SOFT = 0.2
STRENGTH, PRIOR = 20.0, 100.0
WEAKEST, STRONGEST = 1.0, 1000.0
CUT = 0.5

_CLASSES = np.zeros(256, np.int8)  # 1 capital, 2 small letter (and all beyond ASCII), 3 digit, 4 symbol
_CLASSES[[*range(97, 123), *range(128, 256)]] = 2
_CLASSES[65:91] = 1
_CLASSES[48:58] = 3
_CLASSES[[b for b in range(33, 127) if chr(b) in "!#$%&*+/<=>@[]^_`{|}~\\"]] = 4

MEASURES = 7


def measures(column: pa.Array) -> np.ndarray:
    """``MEASURES`` numbers per text; an empty or null one has zeros."""
    out = np.zeros((len(column), MEASURES))
    for begin, stop in text_slices(column):
        data, offsets = text_parts(column.slice(begin, stop - begin))
        kinds = _CLASSES[data]
        of_text = [np.add.reduceat(np.append(kinds == k, 0), np.minimum(offsets[:-1], len(data)), dtype=np.int64) * (np.diff(offsets) > 0) for k in (1, 2, 3, 4)]
        capital, small, digit, symbol = of_text
        size = np.maximum(np.diff(offsets), 1)
        hashes, places = word_hashes(data, offsets, PLAIN, INSIDE)
        n = np.diff(places)
        owner = np.repeat(np.arange(len(n)), n)
        again = np.zeros(len(n))
        if len(hashes) > 1:
            same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            again = np.bincount(owner[1:][same], minlength=len(n))
        order = np.lexsort((hashes, owner))
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[1:] != owner[:-1])
        distinct = np.bincount(owner[fresh], minlength=len(n))
        words = np.maximum(n, 1)
        rows = np.stack([capital / np.maximum(capital + small, 1), digit / size, symbol / size, again / words, np.log1p(words / np.maximum(distinct, 1)), size / words / 10, np.log1p(n)], axis=1)
        rows[n == 0] = 0
        out[begin:stop] = rows
    return out


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def logits(self, x: np.ndarray) -> np.ndarray:
        # Beyond a few deviations a measure says no more: one odd measure cannot outweigh all others.
        return np.clip((x - self.center) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> QualityModel:
    """Ridge logistic regression by Newton steps."""
    if not len(x) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(MEASURES), np.ones(MEASURES), np.append(np.zeros(MEASURES), np.log(rate / (1 - rate))))
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.clip((x - center) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(MEASURES, ridge * len(x) / 100), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-6)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
    return QualityModel(center, scale, w)


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> QualityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1; null ones teach nothing)."""
    known = _known(labels)
    total = known.count()
    spot = F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(1 << 30)) / float(1 << 30)
    # At most about ``sample_rows`` labels, so they may go to every executor.
    chosen = F.broadcast(known.where(spot < min(1.0, sample_rows / max(total, 1))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in measures(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("__label"), pa.array(rows, pa.binary())], names=["label", "row"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("__id"), "text").join(chosen, "__id").select("__label", "text").mapInArrow(task, "label int, row binary").collect()
    rows = sorted(rows, key=lambda r: (r.label, r.row))
    return fit(np.array([np.frombuffer(r.row) for r in rows]).reshape(-1, MEASURES), np.array([r.label for r in rows], float))


def _known(labels: DataFrame) -> DataFrame:
    """One label per document: of several the lowest."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.min("quality").cast("int").alias("__label"))


def evidence(docs: DataFrame, model: QualityModel, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, logit) of each row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = shared.value.logits(measures(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logits, pa.float64())], names=["doc_id", "host", "path", "logit"])
        settle()

    return rows.mapInArrow(task, "doc_id bigint, host string, path string, logit double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame) -> float:
    """The prior strength of a level from its groups' sums ``n`` and ``k`` and their parents' rates ``m``.

    Without groups, or with groups that differ no more than chance, the prior is as strong as ``STRONGEST``
    allows once ``PRIOR`` is outweighed; it always counts at least as ``WEAKEST`` observations.
    """
    spread = F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))
    found = groups.where("m > 0 and m < 1 and n > 0")
    row = found.agg(F.sum(spread).alias("s"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")).first()
    excess = row.s - (row.g - 1) if row.g else 0.0
    free = max(0.0, row.n - row.q / row.n - (row.g - 1)) if row.g else 0.0
    rho = (excess + PRIOR / (1 + STRENGTH)) / (free + PRIOR)
    return min(STRONGEST, max(WEAKEST, (1 - rho) / rho)) if rho > 0 else STRONGEST


def judged(scores: DataFrame, labels: DataFrame, cut: float = CUT, soft: float = SOFT) -> DataFrame:
    """(doc_id, host, path, classifier, site, score, kept) from stored evidence.

    Sums are taken per (host, path) before they are shuffled; hosts are summed from paths. ``site`` is the rate of
    the row's path without the row's own label. A null host or path is an empty one; the columns of ``scores``
    are fixed, so none can clash.
    """
    known = scores.join(_known(labels).withColumnRenamed("__id", "doc_id"), "doc_id", "left")
    p = 1 / (1 + F.exp(-F.col("logit")))
    weight = F.when(F.col("__label").isNotNull(), 1.0).otherwise(soft)
    paths = known.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * F.coalesce(F.col("__label").cast("double"), p)).alias("k"))
    paths = stored(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = min(0.99, max(0.01, whole.k / whole.n)) if whole.n else 0.5
    of_host = strength(hosts.withColumn("m", F.lit(base)))
    hosts = hosts.select("host", F.col("n").alias("hn"), F.col("k").alias("hk"))
    sites = paths.join(hosts, "host").withColumn("m", (F.col("hk") + of_host * base) / (F.col("hn") + of_host))
    of_path = strength(sites)
    joined = known.join(sites.drop("m"), ["host", "path"], "left")
    own, hit = F.when(F.col("__label").isNotNull(), 1.0).otherwise(0.0), F.coalesce(F.col("__label").cast("double"), F.lit(0.0))
    at_host = (F.col("hk") - hit + of_host * base) / (F.col("hn") - own + of_host)
    site = (F.col("k") - hit + F.lit(of_path) * at_host) / (F.col("n") - own + of_path)
    joined = joined.withColumn("site", F.least(F.greatest(site, F.lit(0.0)), F.lit(1.0)))
    logit = F.col("logit") + _logit(F.least(F.greatest("site", F.lit(0.001)), F.lit(0.999))) - float(np.log(base / (1 - base)))
    score = 1 / (1 + F.exp(-logit))
    return joined.select("doc_id", "host", "path", p.alias("classifier"), "site", score.alias("score"), (score >= cut).alias("kept"))


def rate_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """The whole operator: fit, score every text, sum per site, decide; one row per row of ``docs``.

    An empty or null text has zero measures and is judged on them; repeated rows are judged alike.
    """
    model = train_quality(docs, labels)
    return judged(stored(evidence(docs, model, host, path), "quality-evidence"), labels)
