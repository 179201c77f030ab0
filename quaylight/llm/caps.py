"""Near-duplicate vectors by spherical-cap filters.

Filter directions come from a few random product codes: the rotated dimensions are cut into blocks, each block
has its own small codebook of unit vectors, and a direction is one word per block. In each code a vector belongs
to the few directions nearest to it; these are found by list decoding, block by block. Two near vectors share a
filter with high probability, unrelated ones rarely; vectors that share one are compared exactly, in double precision.

The code's size follows the number of distinct vectors, so lists stay short as data grow, and the number of codes
follows the chance that one of them brings a pair at the limit similarity together, in the dimension at hand. Equal
vectors are one. A long list is cut into blocks that are compared pair by pair in separate tasks, and within
them a pair is taken only at its first common filter. Misses are possible: the expected share of missed
links at the limit similarity is below 1 in 100 (tests measure it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.components import components
from quaylight.llm.shared import shuffle_partitions, stored

SIMILARITY = 0.95
CODES = 4  # at least, so that no pair rests on one codebook
MISSED = 0.005  # of pairs at the limit similarity
BESTS = (1, 2, 4, 8, 16)  # filters of a code that a vector is in: the one that needs fewest in all
FILTERS = 96  # of a vector in all codes; above that filters get larger
TRIALS = 1000  # pairs to measure a code on
NEIGHBOURS = 8  # unrelated vectors expected in a filter
BLOCK = 1024  # vectors of a list compared at once
BUNDLE = 8192  # rows of lists handled in one call


def _cap_share(similarity: float, dim: int) -> float:
    """The share of the sphere that is at least so similar to one of its points."""
    if dim < 2:
        return 0.5
    angles = np.linspace(0, math.pi, 200_001)
    weights = np.sin(angles) ** (dim - 2)
    return float(weights[angles <= math.acos(max(-1.0, min(similarity, 1.0)))].sum() / weights.sum())


@dataclass(frozen=True)
class CapCode:
    """Several product codes, each behind its own rotation; a vector is in the ``best`` nearest directions of each."""

    rotations: tuple[np.ndarray, ...]
    books: tuple[tuple[np.ndarray, ...], ...]
    edges: tuple[int, ...]
    best: int

    @staticmethod
    def for_data(n: int, dim: int, similarity: float = SIMILARITY) -> CapCode:
        """The code with the fewest filters a vector whose computed share of missed pairs is at most ``MISSED``.

        A random rotation makes the codes independent, so the chance p that one code brings a pair at the limit
        together (measured on ``TRIALS`` random pairs) says how many are needed. Filters are no smaller than the
        share of vectors that link anyway; where even so many filters do not do, they get larger.
        """
        rng = np.random.default_rng(5)
        share = min(0.25, max(NEIGHBOURS / max(n, 1), _cap_share(similarity, dim)))
        while True:
            fits = [CapCode._fitted(share, best, dim, similarity) for best in BESTS]
            codes, trial = min(fits, key=lambda f: (f[0] * f[1].best, f[0]))
            if codes * trial.best <= FILTERS or share >= 0.25:
                break
            share = min(0.25, 2 * share)
        words = trial.books[0][0].shape[0]
        made = [CapCode._made(rng, words, trial.edges, trial.best) for _ in range(codes)]
        return CapCode(tuple(c.rotations[0] for c in made), tuple(c.books[0] for c in made), trial.edges, trial.best)

    @staticmethod
    def _made(rng: np.random.Generator, words: int, edges: tuple[int, ...], best: int) -> CapCode:
        dim, own = edges[-1], []
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for a, b in zip(edges, edges[1:], strict=False):
            book = rng.standard_normal((words, b - a))
            own.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
        return CapCode((rotation,), (tuple(own),), edges, best)

    @staticmethod
    def _fitted(share: float, best: int, dim: int, similarity: float) -> tuple[int, CapCode]:
        """One code of about best / share directions, and how many such codes are needed."""
        rng = np.random.default_rng(7)
        blocks = 1 if dim < 8 else 2 if best / share < 1e6 else 3
        words = min(4096, max(2, math.ceil((best / share) ** (1 / blocks))))
        trial = CapCode._made(rng, words, tuple(round(k * dim / blocks) for k in range(blocks + 1)), best)
        x = _units(rng.standard_normal((TRIALS, dim)))
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(away, axis=1, keepdims=True)
        level = max(-1.0, min(similarity, 1.0)) if dim > 1 else 1.0
        y = level * x + math.sqrt(1 - level * level) * away / np.where(length > 0, length, 1)
        p = np.mean([len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(trial.decode(x), trial.decode(y), strict=True)])
        needed = math.log(MISSED) / math.log1p(-min(p, 1 - MISSED)) if p > 0 else FILTERS + 1
        return max(CODES, math.ceil(needed)), trial

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters of each unit vector, ascending: the best directions of each code."""
        each = [(k << 48) + self._decoded(x @ r, books) for k, (r, books) in enumerate(zip(self.rotations, self.books, strict=True))]
        return list(np.concatenate(each, axis=1))

    def _decoded(self, x: np.ndarray, books: tuple[np.ndarray, ...]) -> np.ndarray:
        """A word beyond the best of its block is in no best direction, so each block brings its best words only."""
        rows = np.arange(len(x))[:, None]
        sums, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for (a, b), book in zip(zip(self.edges, self.edges[1:], strict=False), books, strict=True):
            part = x[:, a:b] @ book.T
            word = _top(part, self.best)
            total = (sums[:, :, None] + part[rows, word][:, None, :]).reshape(len(x), -1)
            whole = (codes[:, :, None] * len(book) + word[:, None, :]).reshape(len(x), -1)
            at = _top(total, self.best)
            sums, codes = total[rows, at], whole[rows, at]
        return np.sort(codes, axis=1)


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k largest values."""
    n = values.shape[1]
    return np.argpartition(values, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), values.shape)


def _fine(v: Column) -> Column:
    """Vectors with a direction: no null or non-finite component, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _same(v: Column) -> Column:
    """A digest of the components; -0.0 is 0.0."""
    return F.sha2(F.to_json(F.transform(v, lambda x: x + F.lit(0.0))), 256)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is brought to 1 first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


MEMBER = "filter bigint, vec_id bigint, copies bigint, vector binary, filters binary"
FOUND = "vec_id bigint, other bigint, n bigint"


def _members(distinct: DataFrame, code: CapCode) -> DataFrame:
    shared = distinct.sparkSession.sparkContext.broadcast(code)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                x = np.array(batch.column("embedding").to_pylist(), np.float64)
                lists = shared.value.decode(_units(x))
                n = [len(f) for f in lists]
                at = np.repeat(np.arange(len(lists)), n)
                # Components that came as single precision travel as such: half the bytes, the same numbers.
                narrow = x.astype(np.float32)
                raw = pa.array([r.tobytes() for r in (narrow if (narrow == x).all() else x)], pa.binary())
                codes = pa.array([f.tobytes() for f in lists], pa.binary())
                take = pa.array(at)
                columns = [pa.array(np.concatenate(lists) if lists else [], pa.int64()), batch.column("vec_id").take(take), batch.column("copies").take(take), raw.take(take), codes.take(take)]
                yield pa.RecordBatch.from_arrays(columns, names=["filter", "vec_id", "copies", "vector", "filters"])

    return distinct.select("vec_id", "copies", "embedding").mapInArrow(task, MEMBER)


def _first_common(filters: list[bytes], here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of index pairs (a, b), those whose first common filter is ``here``: no smaller filter holds both."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    lists = [np.frombuffer(filters[k], np.int64) for k in used]
    below = [set(f[f < here].tolist()) for f in lists]
    return np.array([below[i].isdisjoint(below[j]) for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)], bool)


def _compare(similarity: float, dim: int):
    """Links within blocks of lists, or between two blocks: counts per vector, and a spanning set of links.

    A bundle holds many short lists, so the cost of a call is shared.
    """

    def task(bundle: pa.Table) -> pa.Table:
        ids, copies, filters, low, high, blocks = (bundle.column(c).to_numpy() for c in ("vec_id", "copies", "filter", "low", "high", "block"))
        raw = bundle.column("vector").to_pylist()
        x = _units(np.array([np.frombuffer(r, np.float64 if len(r) == 8 * dim else np.float32) for r in raw], np.float64))
        lists = bundle.column("filters").to_pylist()
        order = np.lexsort((ids, blocks, high, low, filters))
        cut = np.flatnonzero((np.diff(filters[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows in np.split(order, cut):
            if len(rows) > 1:
                left = rows[blocks[rows] == low[rows[0]]]
                right = left if low[rows[0]] == high[rows[0]] else rows[blocks[rows] == high[rows[0]]]
                found += _links(ids, copies, lists, x, left, right, int(filters[rows[0]]), similarity)
        columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 3)]
        return pa.table({name: c.astype(np.int64) for name, c in zip(("vec_id", "other", "n"), columns, strict=True)})

    return task


def _links(ids, copies, lists, x, left, right, here, similarity) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of two blocks of one list: vectors with links, the smallest id they reach here, and their links."""
    i, j = np.nonzero(x[left] @ x[right].T >= similarity - 1e-9)
    if left is right:
        i, j = i[i < j], j[i < j]
    a, b = left[i], right[j]
    if len(a):
        # Near the limit the order of summation decides: one way for every pair.
        near = np.einsum("ij,ij->i", x[a], x[b]) >= similarity
        a, b = a[near], b[near]
    if len(a):
        taken = _first_common(lists, here, a, b)
        a, b = a[taken], b[taken]
    if not len(a):
        return []
    members, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    n = np.bincount(p, weights=copies[b], minlength=len(members)) + np.bincount(q, weights=copies[a], minlength=len(members))
    return [(ids[members], _spanned(ids[members], p, q), n)]


def _spanned(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each vector the smallest id that the links of this block connect it to."""
    label = ids.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    return label


def cap_links(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows with cosine of at least ``similarity``; ``component_id`` is the smallest
    vec_id that links reach. Vectors that are null, empty, zero or not finite link with nothing, and so do
    vectors of different lengths and rows without a vec_id (component null, not kept). Rows of the same
    vector link with each other; repeated rows of one vec_id count as rows, each with the links of its own
    vector.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = F.col("embedding")
    rows = rows.withColumn("same", F.when(F.col("vec_id").isNotNull() & _fine(v), _same(v)))
    usable = rows.where("same is not null")
    groups = usable.groupBy("same").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding"))
    # A distinct vector is a node of its own, whatever ids its rows have; the number is fixed once written.
    groups = stored(groups.withColumn("vec_id", F.monotonically_increasing_id()), "vectors")
    found = spark.createDataFrame([], FOUND)
    for r in groups.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        part = _found(groups.where(F.size("embedding") == r.dim), r.n, CapCode.for_data(r.n, r.dim, similarity), similarity)
        found = found.unionByName(part)
    found = stored(found, "cap-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("linked"))
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "vec_id")
    known = groups.select("same", "least", "vec_id", "copies").join(counts, "vec_id", "left").join(labels, "vec_id", "left")
    n_links = F.coalesce("linked", F.lit(0)) + F.col("copies") - 1
    known = stored(known.select("same", "least", n_links.alias("n_links"), "label"), "linked-vectors")
    smallest = known.where("label is not null").groupBy("label").agg(F.min("least").alias("smallest"))
    known = known.join(smallest, "label", "left").select("same", "n_links", F.coalesce("smallest", "least").alias("component"))
    joined = rows.select("vec_id", "same").join(known, "same", "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def _found(distinct: DataFrame, n: int, code: CapCode, similarity: float) -> DataFrame:
    # A bundle of short lists has about ``BUNDLE`` rows; a block of a long list is at most 2 * BLOCK rows of one.
    bundles = max(4 * shuffle_partitions(distinct.sparkSession), n * len(code.rotations) * code.best // BUNDLE)
    members = stored(_members(distinct, code), "cap-members")
    sizes = members.groupBy("filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.join(sizes, "filter").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks").cast("bigint")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, block) as low, greatest(k, block) as high))")
    spread = placed.withColumn("pair", F.explode(pairs)).select("filter", "pair.low", "pair.high", "vec_id", "copies", "block", "vector", "filters")
    spread = spread.withColumn("bundle", F.pmod(F.xxhash64("filter", "low", "high"), F.lit(bundles)))
    return spread.groupBy("bundle").applyInArrow(_compare(similarity, code.edges[-1]), FOUND)
