"""Best-fit packing of token sequences, bulk-synchronously.

Documents become pieces of at most ``size`` tokens. Pieces are range-sorted by (length, id); all pieces of
one length are placed in one superstep, longest first: each takes the smallest gap that holds it (its
successor among the sorted gaps), pieces that want the same gap are served in rank order, gaps shrink, and
the next length follows. Equal gaps behave alike, so the state between supersteps is a list of runs of equal
sequences, at most a few per length, whatever the number of documents: the sweep itself runs on that
run-length form, and its result (which ranks of which length go where) places all rows in one join. Ranks
are taken within (length, salt) cells, so one length that a third of all pieces share is still split.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack as pack_ids
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.shared import settle, shuffle_partitions, stored
from quaylight.llm.words import text_parts

SIZE = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"

#: The letter that stands for a byte in byte-level vocabularies: itself where it prints, else from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_CACHES: dict[str, WordIds] = {}


class WordIds:
    """Token ids of white-space separated words, cached in two generations of ``LIMIT`` words each.

    The tokenizer's words never cross white space, nor the border between a letter or digit and ASCII
    punctuation other than an apostrophe, so a word's ids are those of its body and of its closing marks.
    """

    LIMIT, LONGEST, CHUNK = 250_000, 64, 100_000
    MARKS = b".,!?:;|%$#&*()"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.ids: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def of(self, text: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        words = text.split()
        return b"".join(self._part(words[k : k + self.CHUNK]) for k in range(0, len(words), self.CHUNK))

    def _part(self, words: list[bytes]) -> bytes:
        ids = list(map(self.ids.get, words))
        if None in ids:
            missing = [i for i, c in enumerate(ids) if c is None]
            new = self._coded({words[i] for i in missing})
            for i in missing:
                ids[i] = new[words[i]]
        return b"".join(ids)

    def _coded(self, words: set[bytes]) -> dict[bytes, bytes]:
        whole, known, get, before = {}, {}, self.ids.get, self.before.get
        for w in words:
            if ids := before(w):
                whole[w] = known[w] = ids
                continue
            body, tail = self._split(w)
            whole[w] = ids = (get(body) or known.get(body) or known.setdefault(body, self._ids(body))) + (tail and (get(tail) or known.get(tail) or known.setdefault(tail, self._ids(tail))))
            if len(w) <= self.LONGEST:
                known[w] = ids
        if len(self.ids) + len(known) > self.LIMIT:
            self.before, self.ids = self.ids, {}
        self.ids.update((w, c) for w, c in known.items() if len(w) <= self.LONGEST)
        return whole

    def _ids(self, part: bytes) -> bytes:
        text = part.decode()
        if text.isalpha() and text.lower() == text and is_normalized("NFC", text):
            # Lower-case letters pass the normalizer and the splitter unchanged: only the merges are left.
            ids = [t.id for t in self.model.tokenize(text if part.isascii() else part.decode("latin-1").translate(BYTE_LETTERS))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack_ids("<%dI" % len(ids), *ids)

    def _split(self, word: bytes) -> tuple[bytes, bytes]:
        low = word.lower()
        body = low.rstrip(self.MARKS)
        tail = low[len(body) :]
        if not body or not tail:
            return low, b""
        sure = body[-1] < 128 and body[-1:].isalnum() or body[-1] >= 128 and body.decode()[-1].isalpha()
        return (body, tail) if sure else (low, b"")


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Each text's ids and a closing 0, cut into pieces of ``size``; only the last may be shorter.

    A null or empty text is the closing 0 alone. ``ids`` is filled only on request. A row's pieces are made
    from that row alone, so repeated rows give repeated pieces.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            data, offsets = text_parts(batch.column("text"))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = coder.of(data[offsets[i] : offsets[i + 1]].tobytes()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                held += len(ids) if with_ids else 0
                if held > 16 << 20:
                    yield _piece_batch(rows)
                    rows, held = [], 0
            yield _piece_batch(rows)
        settle()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(task, PIECES)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


@dataclass(frozen=True)
class Run:
    """``count`` sequences filled alike: of each (length, rank), sequence j holds the piece of rank + j."""

    count: int
    held: tuple[tuple[int, int], ...]

    def cut(self, n: int) -> tuple[Run, Run]:
        return Run(n, self.held), Run(self.count - n, tuple((length, rank + n) for length, rank in self.held))

    def filled(self, length: int, rank: int, each: int) -> Run:
        return Run(self.count, self.held + tuple((length, rank + k * self.count) for k in range(each)))


def sweep(lengths: dict[int, int], size: int) -> list[Run]:
    """Best fit, longest first, over run-length classes: ``lengths`` maps a length to its number of pieces."""
    gaps: dict[int, list[Run]] = defaultdict(list)
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            gap = min((g for g, runs in gaps.items() if g >= length and runs), default=0)
            run = gaps[gap].pop() if gap else Run(left, ())
            gap = gap or size
            each = min(gap // length, left)
            full = min(run.count, left // each)
            run, rest = run.cut(full)
            if rest.count and rest.held:
                gaps[gap].append(rest)
            gaps[gap - each * length].append(run.filled(length, rank, each))
            rank, left = rank + full * each, left - full * each
    return [run for runs in gaps.values() for run in runs]


def _slots(runs: list[Run], cells: dict[int, list[int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, salt, from rank, to rank, first sequence, offset): ranks within a cell, cells in order."""
    out, first = [], 0
    for run in runs:
        offset = 0
        for length, rank in run.held:
            at = 0
            for salt, n in enumerate(cells[length]):
                low, high = max(rank, at), min(rank + run.count, at + n)
                if low < high:
                    out.append((length, salt, low - at, high - at, first + low - rank, offset))
                at += n
            offset += length
        first += run.count
    return out


def pack(table: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (doc_id, piece, length, ids_crc32 and any others).

    Offsets are gapless from 0 and no sequence exceeds ``size``. The number of sequences is that of best-fit
    decreasing. Ties are broken by the cell and then by (doc_id, piece, ids_crc32); nulls come first, rows
    that repeat are interchangeable. The empty table gives the empty table. What reaches the driver is one
    count per length and cell: at most ``size`` lengths plus four cells per shuffle partition.
    """
    spark = table.sparkSession
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(256, sum(counts.values()) // (4 * shuffle_partitions(spark)))
    salts = [-(-counts.get(n, 0) // most) or 1 for n in range(size + 1)]
    width = F.element_at(F.lit(np.array(salts, np.int32)), F.col("length").cast("int") + 1)
    salted = table.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), width.cast("bigint")).cast("int"))
    cells: dict[int, list[int]] = {n: [0] * salts[n] for n in counts}
    for r in salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).collect():
        cells[r.length][r["__salt"]] = r.n
    rows = _slots(sweep(counts, size), cells)
    slots = spark.createDataFrame(pa.table([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names=["length", "__salt", "__low", "__high", "__first", "offset"]))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(order) - 1)
    inside = (ranked.length == slots.length) & (ranked["__salt"] == slots["__salt"]) & (ranked["__rank"] >= slots["__low"]) & (ranked["__rank"] < slots["__high"])
    placed = ranked.join(slots, inside)
    return placed.select(*(ranked[c] for c in table.columns), (slots["__first"] + ranked["__rank"] - slots["__low"]).alias("sequence_id"), slots["offset"])


def packed_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """The packing of ``docs``: one row per piece, without ids."""
    return pack(stored(pieces(docs, tokenizer, size).drop("ids"), "pieces"), size)


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ``ids`` (little-endian 32-bit)."""
    made = stored(pieces(docs, tokenizer, size, with_ids=True), "piece-ids")
    placed = pack(made, size)
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(rows, F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))

