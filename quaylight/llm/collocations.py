"""Collocations: phrases of two to five words whose parts meet more often than chance, per language.

Texts become word ids in shards of about ``SHARD`` words; a shard has one dictionary of (language, word), and
a 0 between pieces, so no phrase leaves its piece or its language. A shard's FM-index is its BWT and that of
its reverse, both sorted as deep as phrases go; the intervals of a phrase in both are extended by a word on
the left in the one or on the right in the other, for all phrases of a length at once. Only counts that can
still reach the minimum are worth extending: words are summed over all shards first, then pairs, and what
stays below is cut out of the shards (as a piece end) before the next index is built; then threes, without which
no longer phrase is extended. Pairs and threes are summed by a 64-bit hash, where a clash can only keep one that is
too rare: the phrases of what is left, pairs included, are summed by their words. No count is dropped or estimated:
a phrase that reaches the minimum is made of words, pairs and threes that do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from quaylight.llm.shared import discard, settle, shuffle_partitions, stored
from quaylight.llm.words import mixed, text_slices

#: Words of a shard, the longest phrase, its least count, and the rows of a language in the result.
SHARD, DEPTH, LEAST, ROWS = 3 << 20, 5, 100, 2000
NO_LANGUAGE = "und"

#: Bytes that end a piece become line ends, tabs become spaces.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_SHARDS = "shard string, lang string, word string, id int, n bigint, ids binary"


def _shard_batch(shard: str, words: dict[str, dict[bytes, int]], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A shard's dictionary with counts, then its ids."""
    flat = np.concatenate(ids)
    counts = np.bincount(flat, minlength=1)
    for lang, known in words.items():
        if not known:
            continue
        places = np.fromiter(known.values(), np.int32, len(known))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * len(known)),
                pa.array([lang] * len(known)),
                pa.array(list(known), pa.binary()).cast(pa.string()),
                pa.array(places),
                pa.array(counts[places], pa.int64()),
                pa.nulls(len(known), pa.binary()),
            ],
            names=["shard", "lang", "word", "id", "n", "ids"],
        )
    row = [pa.array([shard]), *[pa.nulls(1, k) for k in (pa.string(), pa.string(), pa.int32(), pa.int64())], pa.array([flat.tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(row, names=["shard", "lang", "word", "id", "n", "ids"])


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """Dictionaries (shard, lang, word, id, n) and, one row each, the ids of the shards.

    A shard ends after the text in which it reaches ``size`` words: a longer text is a longer shard.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        words: dict[str, dict[bytes, int]] = {}
        ids: list[np.ndarray] = []
        held, places = 0, count(1)

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                place = self[word] = next(places)
                return place

        for batch in batches:
            for begin, stop in text_slices(batch.column("text")):
                part_of = batch.slice(begin, stop - begin)
                for text, lang in zip(part_of.column("text").to_pylist(), part_of.column("lang").to_pylist(), strict=True):
                    if not text:
                        continue
                    known = words.setdefault(lang, Known())
                    found: list[int] = []
                    for piece in text.encode().lower().translate(_PIECES).split(b"\n"):
                        if in_piece := piece.split():
                            found += map(known.__getitem__, in_piece)
                            found.append(0)
                    ids.append(np.array(found, np.int32))
                    held += len(found)
                    if held >= size:
                        yield from _shard_batch(f"{part}-{number}", words, ids)
                        words, ids, held, number, places = {}, [], 0, number + 1, count(1)
        if held:
            yield from _shard_batch(f"{part}-{number}", words, ids)
        settle()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    return rows.mapInArrow(task, _SHARDS)


class PhraseIndex:
    """BWT of a sequence of ids and of its reverse; 0 separates, and suffixes are sorted ``depth`` ids deep.

    The rows of a phrase of up to ``depth`` ids are an interval in each, and extending it needs no deeper order.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids = np.append(ids, 0).astype(np.int32)
        self.n, self.depth = len(self.ids), depth
        self.symbols = int(self.ids.max(initial=0)) + 1
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=self.symbols))])
        self.order, self.bwt, self.back = self._sorted(self.ids)

    @cached_property
    def reverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._sorted(self.ids[::-1])

    def _sorted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix order, BWT and LF map. Ranks of 1, 2, 4.. ids are joined until the depth is reached."""
        ranks, width, order = ids, 1, np.zeros(0, np.int64)
        while width < self.depth:
            key = ranks.astype(np.int64)
            key *= int(ranks.max(initial=0)) + 1
            key[: max(0, self.n - width)] += ranks[width:]
            order = np.argsort(key, kind="stable")
            key = key[order]
            ranks = np.empty(self.n, np.int32)
            ranks[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]], dtype=np.int32)
            width *= 2
        if not len(order):
            order = np.argsort(ranks, kind="stable")
        order = order.astype(np.int32)
        bwt = ids[order - 1]
        back = np.empty(self.n, np.int32)
        back[np.argsort(bwt, kind="stable")] = np.arange(self.n, dtype=np.int32)
        return order, bwt, back

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (forward begin, reverse begin, count) of all phrases of one id."""
        found = np.flatnonzero(np.diff(self.begins))
        found = found[found > 0]
        return self.begins[found], self.begins[found], self.begins[found + 1] - self.begins[found]

    def _extended(self, begins: np.ndarray, others: np.ndarray, counts: np.ndarray, bwt: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All extensions by one id on the side that ``bwt`` tells: intervals there, in the other index, counts.

        In the first index the begin is where the LF map sends the interval's first row with that id; in the
        other, the phrase's own interval is ordered by the id that follows, so smaller ids go before.
        """
        heads = np.cumsum(counts) - counts
        rows = np.arange(int(counts.sum())) + np.repeat(begins - heads, counts)
        key = np.repeat(np.arange(len(counts)), counts) * self.symbols + bwt[rows]
        at = np.argsort(key, kind="stable")
        key = key[at]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(at) else at
        sizes = np.diff(np.append(first, len(at)))
        owners, lead = key[first] // self.symbols, rows[at[first]]
        real = bwt[lead] > 0
        before = first - heads[owners]
        return back[lead][real].astype(np.int64), (others[owners] + before)[real], sizes[real]

    def left(self, begins: np.ndarray, others: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._extended(begins, others, counts, self.bwt, self.back)

    def right(self, begins: np.ndarray, others: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        others, begins, counts = self._extended(others, begins, counts, self.reverse[1], self.reverse[2])
        return begins, others, counts

    def phrases(self, least: int, most: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length, its phrases (rows of ids) and their counts; left and right extension in turn.

        With ``keep``, phrases for which it is false are neither given nor extended.
        """
        found = self.words()
        for length in range(1, most + 1):
            if length > 1:
                found = (self.left if length % 2 == 0 else self.right)(*found)
            if length >= least or keep:
                phrase = self.ids[self.order[found[0]].astype(np.int64)[:, None] + np.arange(length)]
                if keep:
                    kept = keep(phrase)
                    phrase, found = phrase[kept], tuple(x[kept] for x in found)
            if not len(found[0]):
                return
            if length >= least:
                yield phrase, found[2]


def _joined(words: pa.Array, phrase: np.ndarray) -> pa.Array:
    columns = [words.take(pa.array(phrase[:, k])) for k in range(phrase.shape[1])]
    return pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]


def _compact(ids: np.ndarray) -> np.ndarray:
    """Without repeated separators and words that stand alone: they are in no phrase of two."""
    lone = (ids > 0) & (np.r_[0, ids[:-1]] == 0) & (np.r_[ids[1:], 0] == 0)
    ids = np.where(lone, 0, ids)
    return ids[(ids > 0) | (np.r_[1, ids[:-1]] > 0)]


def _placed(places: pa.Array, texts: pa.Array, size: int) -> pa.Array:
    """An array with ``texts`` at ``places``, null elsewhere."""
    spots = np.full(size, -1, np.int64)
    spots[places.to_numpy(zero_copy_only=False)] = np.arange(len(places))
    return texts.take(pa.array(spots, mask=spots < 0))


def _hashed(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """A hash of each row of ids, from the hashes of their words."""
    out = h[phrase[:, 0]]
    for k in range(1, phrase.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[phrase[:, k]])
    return out


@dataclass
class Shard:
    """A shard's ids, cut at what cannot be in a frequent phrase, the hash of each id's word, and its words' rows."""

    ids: np.ndarray
    h: np.ndarray
    rows: pa.Table
    known: dict[int, np.ndarray]  # hashes of candidates by length

    @staticmethod
    def read(shard: pa.Table, kept: pa.Table) -> Shard | None:
        rows = kept.filter(pc.is_valid(kept.column("id"))).combine_chunks()
        if not shard.num_rows or not rows.num_rows:
            return None
        ids = np.frombuffer(shard.column("ids")[0].as_py(), np.int32)
        places = rows.column("id").chunk(0).to_numpy()
        h = np.zeros(max(int(ids.max(initial=0)), int(places.max())) + 1, np.uint64)
        alive = np.zeros(len(h), bool)
        alive[places] = True
        h[places] = rows.column("h").chunk(0).to_numpy().astype(np.int64).view(np.uint64)
        known: dict[int, np.ndarray] = {}
        if "hashes" in kept.schema.names:
            for length in (2, 3):
                own = kept.filter(pc.equal(kept.column("length"), length)).column("hashes").to_pylist()
                known[length] = np.sort(np.frombuffer(b"".join(own), np.uint64))
        ids = _compact(np.where(alive[ids], ids, 0))
        if 2 in known and len(ids):
            # A separator wherever two neighbours are no candidate: words between two of them are in no phrase.
            pairs = Shard._among(known[2], _hashed(h, np.stack([ids[:-1], ids[1:]], axis=1)))
            spread = np.zeros(2 * len(ids), np.int32)
            spread[::2] = ids
            spread[1:-1:2] = np.where(pairs, -1, 0)
            ids = _compact(spread[spread >= 0])
        return Shard(ids, h, rows, known)

    @staticmethod
    def _among(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(hashes), bool)
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes

    def possible(self, phrase: np.ndarray) -> np.ndarray:
        """Whether the first and the last three words are candidates; what lies between came from such phrases."""
        if phrase.shape[1] < 3:
            return np.ones(len(phrase), bool)
        known = self.known[3]
        return self._among(known, _hashed(self.h, phrase[:, :3])) & self._among(known, _hashed(self.h, phrase[:, -3:]))


_BUCKETED = "bucket bigint, shard string, hashes binary, counts binary"


def _counted(length: int, buckets: int, shard: pa.Table, kept: pa.Table) -> pa.Table:
    """Hashes and counts of a shard's phrases of one length, one row per bucket of hashes."""
    rows: dict[str, list] = {"bucket": [], "shard": [], "hashes": [], "counts": []}
    if found := Shard.read(shard, kept):
        name = shard.column("name")[0].as_py()
        for phrase, counts in PhraseIndex(found.ids, length).phrases(length, length):
            hashes = _hashed(found.h, phrase)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows["bucket"].append(int(bucket[part[0]]))
                rows["shard"].append(name)
                rows["hashes"].append(hashes[part].tobytes())
                rows["counts"].append(counts[part].astype(np.int32).tobytes())
    kinds = [("bucket", pa.int64()), ("shard", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())]
    settle()
    return pa.Table.from_pydict(rows, schema=pa.schema(kinds))


def _candidates(length: int, least: int, bucket: pa.Table) -> pa.Table:
    """Per shard the hashes of a bucket whose counts add up to ``least`` or more over all shards."""
    parts = [np.frombuffer(x, np.uint64) for x in bucket.column("hashes").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in bucket.column("counts").to_pylist()])
    known, spot = np.unique(np.concatenate(parts), return_inverse=True)
    enough = (np.bincount(spot, counts, len(known)) >= least)[spot]
    ends = np.cumsum([len(p) for p in parts])
    kept = [p[enough[e - len(p) : e]].tobytes() for p, e in zip(parts, ends, strict=True)]
    out = pa.table({"shard": bucket.column("shard"), "length": pa.array([length] * len(kept), pa.int32()), "hashes": pa.array(kept, pa.binary())})
    return out.filter(pc.greater(pc.binary_length(out.column("hashes")), 0))


_SUMMED = "bucket bigint, langs array<string>, phrases array<string>, counts array<bigint>"


def _phrases(depth: int, buckets: int, shard: pa.Table, kept: pa.Table) -> pa.Table:
    """Phrases of two words and more, all of whose pairs and threes are candidates, with counts: one row per bucket."""
    rows: dict[str, list] = {"bucket": [], "langs": [], "phrases": [], "counts": []}
    if found := Shard.read(shard, kept):
        places = found.rows.column("id").chunk(0)
        words, langs = (_placed(places, found.rows.column(c).chunk(0), len(found.h)) for c in ("word", "lang"))
        for phrase, counts in PhraseIndex(found.ids, depth).phrases(2, depth, found.possible):
            bucket = (_hashed(found.h, phrase) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    rows["bucket"].append(int(bucket[part[0]]))
                    rows["langs"].append(langs.take(pa.array(phrase[part, 0])))
                    rows["phrases"].append(_joined(words, phrase[part]))
                    rows["counts"].append(pa.array(counts[part], pa.int64()))
    settle()

    def lists(arrays: list[pa.Array], kind: pa.DataType) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([pa.array([], kind), *arrays]))

    kinds = {"langs": pa.string(), "phrases": pa.string(), "counts": pa.int64()}
    return pa.table({"bucket": pa.array(rows["bucket"], pa.int64()), **{name: lists(rows[name], kind) for name, kind in kinds.items()}})


def _summed(least: int, bucket: pa.Table) -> pa.Table:
    """Phrases of a bucket that occur ``least`` times or more over all shards."""
    flat = pa.table({name: pc.list_flatten(bucket.column(name)) for name in ("langs", "phrases", "counts")})
    total = flat.group_by(["langs", "phrases"]).aggregate([("counts", "sum")])
    total = total.filter(pc.greater_equal(total.column("counts_sum"), least))
    return pa.table({"lang": total.column("langs"), "phrase": total.column("phrases"), "a": total.column("counts_sum")})


def phrase_counts(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Counts of phrases of 1 to ``depth`` words that occur ``least`` times or more in a language
    (lang, phrase, a, words), and the number of words of each language (lang, n). Both are stored tables."""
    made = stored(shards(docs, size), "phrase-shards")
    dictionary, texts = made.where("ids is null").drop("ids"), made.where("ids is not null").select(F.col("shard").alias("name"), "ids")
    sizes = stored(dictionary.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    # A word has at most one row per shard, so one shuffle both adds up and tells each shard what to keep.
    total = F.sum("n").over(Window.partitionBy("lang", "word"))
    words = dictionary.withColumn("total", total).where(F.col("total") >= least).withColumn("h", F.xxhash64("lang", "word"))
    words = stored(words.select("shard", "lang", "word", "id", "h", "total"), "phrase-words")
    buckets = max(shuffle_partitions(docs.sparkSession), (sizes.agg(F.sum("n")).first()[0] or 0) // (1 << 20))
    candidates: DataFrame | None = None
    for length in (2, 3)[: depth - 1]:
        kept = words.select("shard", "id", "h")
        if candidates is not None:
            kept = kept.unionByName(candidates, allowMissingColumns=True)
        sides = texts.groupBy("name").cogroup(kept.groupBy("shard"))
        found = stored(_frequent(sides, length, buckets, least), "phrase-candidates")
        candidates = found if candidates is None else candidates.unionByName(found)
    kept = words.drop("total").unionByName(candidates, allowMissingColumns=True)
    sides = texts.groupBy("name").cogroup(kept.groupBy("shard"))
    found = sides.applyInArrow(lambda s, k: _phrases(depth, buckets, s, k), _SUMMED)
    found = found.groupBy("bucket").applyInArrow(lambda b: _summed(least, b), "lang string, phrase string, a bigint")
    out = words.select("lang", F.col("word").alias("phrase"), F.col("total").alias("a")).distinct().unionByName(found)
    counts = stored(out.withColumn("words", F.size(F.split("phrase", " "))), "phrase-counts")
    for used in (made, words, candidates):
        discard(used)
    return counts, sizes


def _frequent(sides: PandasCogroupedOps, length: int, buckets: int, least: int) -> DataFrame:
    """Per shard the hashes of its phrases of a length that occur ``least`` times or more in all."""
    hashed = sides.applyInArrow(lambda s, k: _counted(length, buckets, s, k), _BUCKETED)
    return hashed.groupBy("bucket").applyInArrow(lambda b: _candidates(length, least, b), "shard string, length int, hashes binary")


def scored(cuts: DataFrame) -> DataFrame:
    """Adds floor(1000 a n / (l r)), in decimals of 38 digits: exact for counts up to 1e17."""
    a, n, l, r = (F.col(c).cast("decimal(17,0)") for c in ("a", "n", "l", "r"))  # noqa: E741
    whole = cuts.withColumn("__top", (a * n * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn("__base", l * r)
    return whole.withColumn("score", F.expr("__top div __base")).drop("__top", "__base")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, rows: int = ROWS, share: int = 100, size: int = SHARD) -> DataFrame:
    """The first ``rows`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the least over its cuts of ``floor(1000 a n / (l r))`` in exact decimals, the first
    such cut counts. A phrase is left out if a word more on either side keeps ``share`` percent of its count;
    counts only fall with each word, so that covers every longer phrase. Ties go to the
    higher count, then to the phrase (bytes). A null language is ``und``; null and empty texts hold no words; a
    row that repeats counts again; other columns take no part. The empty table gives the empty table.
    """
    counts, sizes = phrase_counts(docs, least, depth, size)
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    # One word more on the left or right: the counts of the phrase's own first and last words less one.
    ends = phrases.where("words > 2").select("lang", "a", F.explode(F.array(F.expr("array_join(slice(w, 1, words - 1), ' ')"), F.expr("array_join(slice(w, 2, words - 1), ' ')"))).alias("phrase"))
    extended = ends.groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    closed = phrases.join(extended, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("more") < share * F.col("a"), F.lit(True)))
    cuts = closed.select("lang", "phrase", "a", "w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("head", F.expr("array_join(slice(w, 1, k), ' ')")).withColumn("tail", F.expr("array_join(slice(w, k + 1, words - k), ' ')"))
    known = counts.select("lang", "phrase", "a")
    cuts = cuts.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "tail", "r"), ["lang", "tail"]).join(sizes, "lang")
    best = scored(cuts).groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.*", "n")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: the first of each of several parts come first.
    parts = best.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    ahead = parts.withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__at") <= rows)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= rows)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
