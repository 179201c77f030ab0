"""Repeated passages: found, compiled into sharded automata, and located in every document.

A window is ``WINDOW`` consecutive words. Documents are dealt into buckets, one shard each. Then

1. anchors: the least hash of the short word runs inside a window. Equal windows have equal anchors, and
   neighbouring windows mostly share one, so few rows say which windows can recur at all;
2. windows under an anchor that several documents have are counted exactly. The smallest document of a
   recurring window owns it;
3. owners cut their recurring windows into passages of running text, one copy for each bucket that needs it;
4. every bucket compiles the passages sent to it into an Aho-Corasick automaton and streams all its
   documents through. Since a window always holds a whole aligned block of ``BLOCK`` words, the automaton holds
   the passages' blocks; each occurrence is then followed to both sides, word by word, to its full length.

A row whose whole text a smaller document has too is one occurrence of that document: it owns nothing, so only
its first copy takes part in the search, and the copies are marked in their buckets.

What decides is the text itself, not hashes. A passage that a third of all documents share has one owner and
reaches each bucket once; rows that repeat a window are reduced in their bucket before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.shared import discard, settle, shuffle_partitions, stored
from quaylight.llm.words import text_parts, window_owner, windows, word_hashes

WINDOW, ANCHOR, BLOCK = 13, 5, 7
BUCKET_BYTES = 2 << 20
LAST = (1 << 63) - 1  # the place of a null doc_id: after all others

Spans = list[list[tuple[int, int]]]


def _sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = np.minimum(a[:-step], a[step:])
        done += step
    return a


def _windows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: hash, anchor, row and place in the row."""
    hashes, places = word_hashes(*text_parts(column))
    owner = window_owner(places, WINDOW, len(hashes))
    inside = np.flatnonzero(owner >= 0)
    row = owner[inside]
    if not len(inside):
        return hashes[:0], hashes[:0], row, row
    anchors = _sliding_least(windows(hashes, ANCHOR), WINDOW - ANCHOR + 1)
    return windows(hashes, WINDOW)[inside], anchors[inside], row, inside - places[row]


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LAST).to_numpy() if isinstance(column, pa.ChunkedArray) else column.fill_null(LAST).to_numpy(zero_copy_only=False)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """Each row's distinct anchors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                _, anchors, row, _ = _windows(batch.column("text"))
                fresh = np.ones(len(row), bool)
                fresh[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                anchors, row = anchors[fresh], row[fresh]
                order = np.lexsort((anchors, row))
                anchors, row = anchors[order], row[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(anchors[fresh].astype(np.int64)), pa.array(buckets[row[fresh]])], names=["anchor", "bucket"])

    return docs.select("bucket", "text").mapInArrow(task, "anchor bigint, bucket int")


CANDIDATES = "w bigint, bucket int, low bigint, high bigint"


def _copies(bucket: pa.Table, marks: pa.Table) -> np.ndarray:
    """Which rows of a bucket are marked as copies."""
    marks = marks.filter(marks.column("copy").is_valid())
    known = set(zip(marks.column("copy").to_pylist(), marks.column("digest").to_pylist(), strict=True))
    return np.array([k in known for k in zip(_ids(bucket.column("doc_id")).tolist(), bucket.column("digest").to_pylist(), strict=True)], bool)


def _candidates(bucket: pa.Table, anchors: pa.Table) -> pa.Table:
    """Windows of a bucket under recurring anchors, each once, with its smallest and largest document."""
    bucket = bucket.filter(pa.array(~_copies(bucket, anchors)))
    w, anchor, row, _ = _windows(bucket.column("text"))
    known = np.sort(anchors.column("anchor").drop_null().to_numpy().astype(np.uint64))
    at = np.minimum(np.searchsorted(known, anchor), max(len(known) - 1, 0))
    take = known[at] == anchor if len(known) else np.zeros(len(w), bool)
    w, doc = w[take], _ids(bucket.column("doc_id"))[row[take]]
    order = np.lexsort((doc, w))
    first = np.ones(len(w), bool)
    first[1:] = w[order][1:] != w[order][:-1]
    last = np.roll(first, -1)
    low, high = doc[order][first], doc[order][last]
    w = w[order][first]
    by = np.argsort(low, kind="stable")  # neighbours of one document compress well
    number = bucket.column("bucket")[0].as_py() if bucket.num_rows else 0
    return pa.table({"w": w[by].astype(np.int64), "bucket": pa.array(np.full(len(by), number), pa.int32()), "low": low[by], "high": high[by]})


PASSAGES = "bucket int, owner bigint, passage string"


def _passages(bucket: pa.Table, wanted: pa.Table) -> pa.Table:
    """The owners' windows as runs of text, for each bucket that wants them."""
    out: dict[str, list] = {"bucket": [], "owner": [], "passage": []}
    if wanted.num_rows and bucket.num_rows:
        ids = _ids(bucket.column("doc_id"))
        w, _, row, place = _windows(bucket.column("text"))
        # Copies come after the owner in the order below, so they need not be left out.
        # The smallest document of a window owns it, so in this bucket its first place is the owner's.
        order = np.lexsort((place, row, ids[row], w))
        at = order[np.searchsorted(w[order], wanted.column("w").to_numpy().astype(np.uint64))]
        dest = wanted.column("dest").to_numpy()
        order = np.lexsort((place[at], row[at], dest))
        at, dest = at[order], dest[order]
        cut = np.flatnonzero((np.diff(dest) != 0) | (np.diff(row[at]) != 0) | (np.diff(place[at]) != 1)) + 1
        words: dict[int, list[bytes]] = {}
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            r, begin, end = int(row[at[a]]), int(place[at[a]]), int(place[at[b - 1]]) + WINDOW
            if r not in words:
                words[r] = bucket.column("text")[r].as_py().encode().split()
            out["bucket"].append(int(dest[a]))
            out["owner"].append(int(ids[r]))
            out["passage"].append(b" ".join(words[r][begin:end]).decode())
    return pa.table([pa.array(out["bucket"], pa.int32()), pa.array(out["owner"], pa.int64()), pa.array(out["passage"], pa.string())], names=list(out))


class PassageAutomaton:
    """The aligned blocks of a shard's passages, and the way from a block to its whole occurrence."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.owners = [owner for owner, _ in passages]
        self.words = [text.split(" ") for _, text in passages]
        blocks: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            for at in range(0, len(words) - BLOCK + 1, BLOCK):
                blocks[f" {' '.join(words[at : at + BLOCK])} "].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for text, found in blocks.items():
            self.automaton.add_word(text, (len(text), found))
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def covered(self, doc: int, words: list[str]) -> list[tuple[int, int]]:
        """Spans (start, words) that windows of smaller documents cover."""
        if self.empty or len(words) < WINDOW:
            return []
        text = f" {' '.join(words)} "
        spaces: np.ndarray | None = None
        hit: np.ndarray | None = None
        done: dict[tuple[int, int], int] = {}
        for end, (size, found) in self.automaton.iter(text):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                hit = np.zeros(len(words) + 1, np.int32)
            at = -1
            for k, offset in found:
                if self.owners[k] >= doc:
                    continue
                if at < 0:
                    at = int(np.searchsorted(spaces, end - size + 1))
                line = (k, at - offset)
                if at < done.get(line, 0):
                    continue
                begin, stop = self._followed(words, self.words[k], at, offset)
                done[line] = stop
                if stop - begin >= WINDOW:
                    hit[begin] += 1
                    hit[stop] -= 1
        if hit is None:
            return []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(hit[:-1]) > 0).view(np.int8), [0]))))
        return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]

    @staticmethod
    def _followed(words: list[str], passage: list[str], at: int, offset: int) -> tuple[int, int]:
        begin, p = at, offset
        while begin and p and words[begin - 1] == passage[p - 1]:
            begin, p = begin - 1, p - 1
        stop, p = at + BLOCK, offset + BLOCK
        while stop < len(words) and p < len(passage) and words[stop] == passage[p]:
            stop, p = stop + 1, p + 1
        return begin, stop


def _located(make: Callable[[pa.Table, list[list[str]], Spans], pa.Table]):
    def task(bucket: pa.Table, passages: pa.Table) -> pa.Table:
        copies = _copies(bucket, passages)
        passages = passages.filter(passages.column("passage").is_valid())
        automaton = PassageAutomaton(sorted(zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist(), strict=True)))
        words = [t.as_py().encode().split() if t.is_valid else [] for t in bucket.column("text")]
        texts = [b"\n".join(w).decode().split("\n") if w else [] for w in words]
        spans = [
            ([(0, len(w))] if len(w) >= WINDOW else []) if copy else automaton.covered(int(d), w)
            for d, w, copy in zip(_ids(bucket.column("doc_id")), texts, copies, strict=True)
        ]
        out = make(bucket.drop_columns(["digest"]), texts, spans)
        del automaton, words, texts, spans
        settle()
        return out

    return task


def _bucketed(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """``docs`` with a bucket of about ``bucket_bytes`` text each, by what a row holds."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(2 * shuffle_partitions(docs.sparkSession), -(-total // bucket_bytes))
    return docs.withColumn("digest", F.xxhash64("text")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n)).cast("int"))


def _marked(rows: DataFrame) -> DataFrame:
    """(bucket, copy, digest) of rows with the text of a smaller doc_id."""
    keys = rows.where("text is not null").select("bucket", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("copy"), "digest", F.xxhash64(F.lit("again"), "text").alias("again"))
    first = keys.groupBy("digest", "again").agg(F.min("copy").alias("first"), F.max("copy").alias("last")).where("first < last").drop("last")
    return keys.join(first, ["digest", "again"]).where("copy > first").select("bucket", "copy", "digest").distinct()


def _with_repeats(docs: DataFrame, make: Callable[[pa.Table, list[list[str]], Spans], pa.Table], schema: str, bucket_bytes: int) -> DataFrame:
    rows = _bucketed(docs, bucket_bytes)
    slim = rows.select("bucket", "digest", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marks = stored(_marked(rows), "copies")
    anchors = _anchor_rows(slim)
    common = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    sought = stored(anchors.join(common, "anchor", "left_semi").distinct().unionByName(marks, allowMissingColumns=True), "anchors")
    found = slim.groupBy("bucket").cogroup(sought.groupBy("bucket")).applyInArrow(_candidates, CANDIDATES)
    found = stored(found, "windows")
    discard(sought)
    owned = found.groupBy("w").agg(F.min(F.struct("low", "bucket")).alias("own"), F.max("high").alias("high")).where("own.low < high")
    owned = owned.select("w", F.col("own.low").alias("owner"), F.col("own.bucket").alias("home"))
    wanted = found.select("w", F.col("bucket").alias("dest"), "high").join(owned, "w").where("high > owner")
    wanted = stored(wanted.select(F.col("home").alias("bucket"), "dest", "w"), "wanted")
    discard(found)
    passages = stored(slim.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_passages, PASSAGES), "passages")
    discard(wanted)
    passages = passages.unionByName(marks, allowMissingColumns=True)
    return rows.groupBy("bucket").cogroup(passages.groupBy("bucket")).applyInArrow(_located(make), schema)


SPANS = "spans array<struct<start:int,length:int>>"
DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _kept(words: list[str], spans: list[tuple[int, int]]) -> list[str]:
    out, at = [], 0
    for start, n in spans:
        out += words[at:start]
        at = start + n
    return out + words[at:]


def repeated_spans(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, spans) of each row: the words that windows of documents with smaller ids cover.

    Words are runs of anything but ASCII white space. Windows are judged on the input, not on what is left.
    A null, empty or short text has no window. A null doc_id comes after all others (so two such rows leave
    each other alone), rows of one doc_id are one document. Columns beyond doc_id and text are not read.
    """

    def make(bucket: pa.Table, words: list[list[str]], spans: Spans) -> pa.Table:
        held = pa.list_(pa.struct({"start": pa.int32(), "length": pa.int32()}))
        rows = [[{"start": a, "length": n} for a, n in s] for s in spans]
        return pa.table([bucket.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(rows, held)], names=["doc_id", "n_words", "spans"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _with_repeats(own, make, f"doc_id bigint, n_words bigint, {SPANS}", bucket_bytes)


def repeat_digest(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row how many words :func:`repeated_spans` removes, and the digest of those kept."""

    def make(bucket: pa.Table, words: list[list[str]], spans: Spans) -> pa.Table:
        kept = [hashlib.sha256(" ".join(_kept(w, s)).encode()).hexdigest() for w, s in zip(words, spans, strict=True)]
        removed = [sum(n for _, n in s) for s in spans]
        return pa.table([bucket.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _with_repeats(own, make, DIGEST, bucket_bytes)


def without_repeats(docs: DataFrame, min_words: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts: what a training set keeps.

    A text without repeats stays as it is, byte for byte; in one with repeats, kept words are joined by one
    space. Texts left with fewer than ``min_words`` words although something was cut go. ``n_chars``, where
    there is such a column, follows the text.
    """
    schema = docs.schema

    def make(bucket: pa.Table, words: list[list[str]], spans: Spans) -> pa.Table:
        table = bucket.drop_columns(["bucket"])
        texts, keep = table.column("text").to_pylist(), np.ones(len(words), bool)
        sizes = table.column("n_chars").to_pylist() if "n_chars" in table.column_names else [None] * len(words)
        for i, (w, s) in enumerate(zip(words, spans, strict=True)):
            if s:
                left = _kept(w, s)
                keep[i] = len(left) >= min_words
                texts[i] = " ".join(left)
                sizes[i] = None if sizes[i] is None else len(texts[i])
        for name, values in (("text", texts), ("n_chars", sizes)):
            if name in table.column_names:
                at = table.schema.get_field_index(name)
                table = table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))
        return table.filter(pa.array(keep))

    hidden = {c: f"__own_{c}" for c in ("bucket", "digest") if c in docs.columns}
    rows = docs.withColumnsRenamed(hidden)
    out = _with_repeats(rows, make, rows.schema, bucket_bytes)
    return out.withColumnsRenamed({v: k for k, v in hidden.items()}).select(*schema.names)
