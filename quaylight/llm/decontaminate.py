"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items (lower-cased, as word numbers) go into one automaton whose states know which items hold their
words. Documents are streamed through it: only runs of words that the items use at all are walked, and at
each word the longest matching length says whether a window of an item ends there. Nothing is shuffled.

Size: an automaton holds at most ``shard_words`` item words (documented bound, about 200 bytes a word). A
larger benchmark is cut into several automata, which follow each other in the same pass over the documents;
an item larger than a shard has one to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
SHARD_WORDS = 1_000_000

#: Words are runs of a-z, 0-9 and all characters beyond ASCII; A-Z become a-z, other ASCII separates.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

HITS = "n_words bigint, spans array<struct<start:int,length:int>>, items array<bigint>"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


class ItemAutomaton:
    """Suffix automaton over all items; transitions are dicts of word numbers."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        self.shortest = window
        ends: list[tuple[int, int, int]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
            if words:
                ends.append((item, len(words), last))
                self.shortest = min(self.shortest, len(words))
        for item, words in items:
            state = 0
            for w in words:
                state = self.next[state][self.vocabulary[w]]
                at = state
                while at > 0 and item not in self.items[at]:
                    self.items[at].add(item)
                    at = self.link[at]
        #: Items shorter than a window: (words, item) at the state of the whole item.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for item, n, state in ends:
            if n < window:
                self.whole[state].append((n, item))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.short_at = [-1] * len(self.next)  # nearest state on the suffix path where a short item ends
        self.window_at = [-1] * len(self.next)  # the state that holds the last ``window`` words
        for s in order:
            self.short_at[s] = s if self.whole[s] else self.short_at[self.link[s]]
            if self.length[s] >= window:
                self.window_at[s] = s if self.length[self.link[s]] < window else self.window_at[self.link[s]]

    def _state(self, follow: dict[int, int], link: int, length: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of ``q`` for the words that end after ``p``."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal spans of hit words, and the items whose windows occur."""
        known = self.vocabulary
        ids = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        spans: list[list[int]] = []
        found: set[int] = set()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for begin, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if stop - begin >= self.shortest:
                self._walk(ids[begin:stop].tolist(), begin, spans, found)
        return [(a, b - a) for a, b in spans], found

    def _walk(self, run: list[int], at: int, spans: list[list[int]], found: set[int]) -> None:
        state = matched = 0
        for i, w in enumerate(run, at + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            hit = 0
            if matched >= self.window:
                hit = matched
                found |= self.items[self.window_at[state]]
            short = self.short_at[state]
            while short > 0:
                for n, item in self.whole[short]:
                    if n <= matched:
                        hit = max(hit, n)
                        found.add(item)
                short = self.short_at[self.link[short]]
            if hit:
                begin = i - hit
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, i])


def _shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in parts of at most ``shard_words`` words (more only for one item alone)."""
    shard: list[tuple[int, list[bytes]]] = []
    total = 0
    for row in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        words = normal_words(row.text)
        if shard and total + len(words) > shard_words:
            yield shard
            shard, total = [], 0
        shard.append((row.item_id, words))
        total += len(words)
    if shard:
        yield shard


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with what each text shares with the items.

    Adds ``n_words``, ``spans`` (start and number of hit words, maximal and ascending) and ``items`` (ids of
    items with occurring windows, ascending); columns of those names in ``docs`` are replaced. A window is
    ``window`` consecutive words of one item, or a whole item of fewer words. A null or empty text has no
    words; null or empty items and items without an id have no windows; items that repeat count once; rows
    that repeat are each judged; with an empty benchmark nothing is hit.
    """
    own = docs.drop("n_words", "spans", "items", "__held", "__found")
    found = _scanned(own, benchmark, window, shard_words)
    spans = F.coalesce("__held", F.expr("array()").cast("array<struct<start:int,length:int>>"))
    return found.select(*own.columns, "n_words", spans.alias("spans"), F.coalesce("__found", F.expr("array()").cast("array<bigint>")).alias("items"))


#: What becomes of a batch once all shards have seen it: its columns and the hit spans, to the columns that stay.
Finish = Callable[[dict[str, pa.Array], list[list[dict] | None], list[int]], dict[str, pa.Array]]


def _scanned(own: DataFrame, benchmark: DataFrame, window: int, shard_words: int, finish: Finish | None = None) -> DataFrame:
    """``own`` with n_words, __held and __found; ``finish`` runs in the pass of the last shard."""
    spark = own.sparkSession
    found = own.withColumn("__held", F.lit(None).cast("array<struct<start:int,length:int>>")).withColumn("__found", F.lit(None).cast("array<bigint>")).withColumn("n_words", F.lit(0).cast("bigint"))
    shards = [spark.sparkContext.broadcast(ItemAutomaton(s, window)) for s in _shards(benchmark, shard_words)] or [spark.sparkContext.broadcast(ItemAutomaton([], window))]
    for shard in shards:
        found = found.mapInArrow(_search(shard, finish if shard is shards[-1] else None), found.schema)
    return found


def _search(shard, finish: Finish | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: ItemAutomaton = shard.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            held, items, counts = [], [], []
            before = zip(columns["text"], columns["__held"].to_pylist(), columns["__found"].to_pylist(), strict=True)
            for text, spans, known in before:
                words = normal_words(text.as_py())
                new, ids = automaton.search(words)
                counts.append(len(words))
                held.append(joined(spans, new) if spans else [{"start": a, "length": n} for a, n in new] or None)
                items.append(sorted({*(known or ()), *ids}) or None)
            columns["n_words"] = pa.array(counts, pa.int64())
            columns["__held"] = pa.array(held, columns["__held"].type)
            columns["__found"] = pa.array(items, columns["__found"].type)
            if finish:
                columns = finish(columns, held, counts)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return task


def joined(spans: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    """The union of two lists of spans."""
    out: list[list[int]] = []
    for a, n in sorted([(s["start"], s["length"]) for s in spans] + list(new)):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [{"start": a, "length": b - a} for a, b in out]


def strip_benchmark(docs: DataFrame, benchmark: DataFrame, min_words: int = 1, drop_share: float = 0.5, window: int = WINDOW) -> DataFrame:
    """``docs`` without benchmark passages: what a training set keeps.

    Hit spans of at least ``min_words`` words are cut out of the text; a document of which more than
    ``drop_share`` of the words are hit is left out. A text that is not hit stays as it
    is, byte for byte; in one that is, what stands between kept words stays. ``n_chars``, where there is
    such a column, follows the text.
    """

    def cut(columns: dict[str, pa.Array], held: list[list[dict] | None], counts: list[int]) -> dict[str, pa.Array]:
        if any(held):
            texts, keep = columns["text"].to_pylist(), []
            sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * len(texts)
            for i, (spans, n) in enumerate(zip(held, counts, strict=True)):
                keep.append(sum(s["length"] for s in spans or ()) <= n * drop_share)
                if spans:
                    texts[i] = _without(texts[i], spans, min_words)
                    sizes[i] = None if sizes[i] is None else len(texts[i])
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            columns = {k: c.filter(pa.array(keep)) for k, c in columns.items()}
        return columns

    names = {c: f"__own_{c}" for c in ("n_words", "spans", "items") if c in docs.columns}
    out = _scanned(docs.withColumnsRenamed(names), benchmark, window, SHARD_WORDS, cut)
    return out.drop("n_words", "__held", "__found").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def _without(text: str, spans: list[dict], min_words: int) -> str:
    data = text.encode()
    flat = np.frombuffer(data.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for s in spans:
        first, last = s["start"], s["start"] + s["length"] - 1
        if s["length"] >= min_words:
            out.append(data[at : starts[first]])
            at = ends[last]
    return b"".join([*out, data[at:]]).decode()


def report(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`find_benchmark`'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["length"])
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
