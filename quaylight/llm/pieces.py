"""SentencePiece ids of whole texts for merge-type (BPE) vocabularies, and back.

A text's symbols start as its characters; an agenda holds every adjacent pair whose joined text is a piece,
best score first and then leftmost. The top pair is merged, its new neighbours enter, and pairs that a merge
has changed meanwhile are passed over. What no piece covers becomes byte pieces or the unknown id. Where no
piece of the vocabulary has a blank mark after another letter (checked when the model is read), no merge can
cross from a word to the next: each distinct word of a slice of texts is then one agenda, and the agendas of
all short words take their top pairs in the same vector steps. Longer words, and whole texts under other
vocabularies, use a heap. The sentencepiece library normalises the texts, checks the ids in each Arrow batch
and decodes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add
from struct import unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.shared import settle
from quaylight.llm.words import text_parts, text_slices

BLANK = "▁"
#: Kinds of a piece and of a model in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: Bytes of text whose words are told apart together; words up to ``SHORT`` letters are merged in vector steps.
SLICE, SHORT = 1 << 23, 48

_CODERS: dict[str, PieceCoder] = {}
_PLACE = (1 << 32) - 1
_NEVER = np.int64(np.iinfo(np.int64).max)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, message[at : at + size]
        at += size


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` for each (s, n), one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class PieceCoder:
    """The vocabulary of a model file, its pair table, and both forms of the agenda."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.unused: set[str] = set()
        self.bytes: dict[int, int] = {}
        scores: dict[str, float] = {}
        user: list[str] = []
        kind_of_model, normal = 1, {}
        for number, value in _fields(self.library.serialized_model_proto()):
            if number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            if number == 3:
                normal = dict(_fields(value))
            if number != 1:
                continue
            piece = dict(_fields(value))
            text, kind = piece.get(1, b"").decode(), piece.get(3, NORMAL)
            place = self.library.piece_to_id(text)
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = place
            if kind in (NORMAL, USER, UNUSED):
                self.ids[text] = place
                scores[text] = unpack("<f", piece[2])[0] if 2 in piece else 0.0
            if kind == UNUSED:
                self.unused.add(text)
            if kind == USER:
                user.append(text)
        if kind_of_model != MERGES:
            raise ValueError("the agenda needs a merge-type (BPE) model")
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {text: order[s] for text, s in scores.items()}
        self.user = set(user)
        self.first = re.compile("|".join([*map(re.escape, sorted(user, key=len, reverse=True)), "."]), re.S) if user else None
        crossing = re.compile(f"[^{BLANK}]{BLANK}")
        self.by_word = not user and not self.unused and not any(crossing.search(text) for text in self.ids)
        #: The library alone changes no text but for a leading blank and blank marks, so words can be asked for.
        self.as_is = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
        #: Whether two letters that end and begin with these bytes stand side by side in any piece.
        self.joined = np.zeros((256, 256), bool)
        for text in self.ids:
            for a, b in zip(text, text[1:], strict=False):
                self.joined[a.encode()[-1], b.encode()[0]] = True
        self._pairs()

    def _pairs(self) -> None:
        """Symbols (pieces, then letters that are only parts of pieces) and the table of pairs that make a piece."""
        symbols = dict.fromkeys(self.ids)
        symbols.update(dict.fromkeys(c for text in self.ids for c in text))
        number = {text: k for k, text in enumerate(symbols)}
        self.symbols = len(number)
        keys, made, ranks = [], [], []
        for text in self.ids:
            for k in range(1, len(text)):
                a, b = number.get(text[:k]), number.get(text[k:])
                if a is not None and b is not None:
                    keys.append(a * self.symbols + b)
                    made.append(number[text])
                    ranks.append(self.rank[text])
        at = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[at], _NEVER)
        self.made = np.append(np.array(made, np.int64)[at], 0)
        self.ranks = np.append(np.array(ranks, np.int64)[at], 0)
        self.letters = np.full(0x110000, -1, np.int32)
        for text, k in number.items():
            if len(text) == 1:
                self.letters[ord(text)] = k
        codes = [self._of(text) for text in symbols]
        self.code_sizes = np.array([len(c) for c in codes], np.int64)
        self.code_starts = np.concatenate([[0], np.cumsum(self.code_sizes)[:-1]]) if codes else np.zeros(0, np.int64)
        self.codes = np.array([i for c in codes for i in c], np.int32)

    def _of(self, piece: str) -> list[int]:
        place = self.ids.get(piece)
        if place is not None:
            return [place]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.library.unk_id()]

    def merged(self, text: str) -> list[str]:
        """The pieces of normalised text, by a heap.

        An entry is the pair's rank and the place of its left symbol in one number. It is stale, and passed
        over, where the symbols now at that place no longer have that rank together.
        """
        symbols: list[str | None] = self.first.findall(text) if self.first else list(text)
        n = len(symbols)
        rank, user, unused = self.rank.get, self.user, self.unused
        parts: dict[str, tuple[str, str]] = {}
        agenda = [r << 32 | i for i, r in enumerate(map(rank, map(add, symbols, symbols[1:]))) if r is not None]
        heapify(agenda)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            top = heappop(agenda)
            i = top & _PLACE
            j = right[i]
            a = symbols[i]
            if j == n or a is None:
                continue
            b = symbols[j]
            ab = a + b
            if rank(ab) != top >> 32 or user and (a in user or b in user):
                continue
            if ab in unused:
                parts[ab] = (a, b)
            symbols[i], symbols[j] = ab, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(ab + symbols[k])) is not None:
                    heappush(agenda, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := rank(symbols[h] + ab)) is not None:
                heappush(agenda, r << 32 | h)
        out = [s for s in symbols if s is not None]
        return [p for s in out for p in self._used(s, parts)] if parts else out

    def _used(self, piece: str, parts: dict[str, tuple[str, str]]) -> list[str]:
        """An unused piece falls back to the two that made it."""
        if piece not in self.unused or piece not in parts:
            return [piece]
        return [p for half in parts[piece] for p in self._used(half, parts)]

    def coded(self, text: str) -> list[int]:
        """Ids of normalised text, by the heap."""
        return [i for piece in self.merged(text) for i in self._of(piece)]

    def _tops(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda entries (rank, place) of pairs of symbols, and what each pair makes."""
        key = a.astype(np.int64) * self.symbols + b
        key[(a < 0) | (b < 0)] = -1
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[k] == key, self.ranks[k] << 32 | at, _NEVER), self.made[k]

    def short_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, and how many each has: every step merges the top pair of every open agenda."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.letters[points].astype(np.int64)
        symbol[symbol < 0] = -1 - points[symbol < 0].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        entry, made = self._next(symbol, owner)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            top = np.minimum.reduceat(entry, heads)
            sizes = np.diff(np.append(heads, len(owner)))
            open_ = np.repeat(top != _NEVER, sizes)
            if not open_.all():  # words without pairs are finished
                done.append((symbol[~open_], owner[~open_]))
                symbol, owner, entry, made = symbol[open_], owner[open_], entry[open_], made[open_]
                sizes, top = sizes[top != _NEVER], top[top != _NEVER]
                if not len(symbol):
                    break
            at = np.cumsum(sizes) - sizes + (top & _PLACE)
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, owner, entry, made = symbol[keep], owner[keep], entry[keep], made[keep]
            at -= np.arange(len(at))  # one symbol of each word before it is gone
            place = at - (np.cumsum(sizes - 1) - (sizes - 1))
            entry = self._shifted(entry, np.repeat(place, sizes - 1), owner)
            self._renew(entry, made, symbol, owner, at, place)
            before = at[place > 0] - 1
            self._renew(entry, made, symbol, owner, before, place[place > 0] - 1)
        symbol = np.concatenate([s for s, _ in done]) if done else symbol
        owner = np.concatenate([o for _, o in done]) if done else owner
        order = np.argsort(owner, kind="stable")
        return self._ids_of(symbol[order], owner[order], len(words))

    def _next(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry, made = np.full(len(symbol), _NEVER), np.zeros(len(symbol), np.int64)
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        places = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
        self._renew(entry, made, symbol, owner, np.arange(len(symbol)), places)
        return entry, made

    def _renew(self, entry: np.ndarray, made: np.ndarray, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray, place: np.ndarray) -> None:
        """Entries of the pairs that begin at ``at``."""
        entry[at] = _NEVER
        paired = np.flatnonzero(at + 1 < len(owner))
        paired = paired[owner[at[paired] + 1] == owner[at[paired]]]
        at, place = at[paired], place[paired]
        entry[at], made[at] = self._tops(symbol[at], symbol[at + 1], place)

    @staticmethod
    def _shifted(entry: np.ndarray, merged: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Entries right of their word's merge now begin one place earlier."""
        return np.where((entry != _NEVER) & ((entry & _PLACE) > merged), entry - 1, entry)

    def _ids_of(self, symbol: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: a piece is its id, a letter without a piece its bytes or the unknown id."""
        known = symbol >= 0
        sizes = np.ones(len(symbol), np.int64)
        sizes[known] = self.code_sizes[symbol[known]]
        strange = np.flatnonzero(~known)
        others = [self._of(chr(-1 - int(s))) for s in symbol[strange]]
        sizes[strange] = [len(o) for o in others]
        starts = np.zeros(len(symbol), np.int64)
        starts[known] = self.code_starts[symbol[known]]
        starts[strange] = len(self.codes) + np.cumsum(sizes[strange]) - sizes[strange]
        codes = np.concatenate([self.codes, np.array([i for o in others for i in o], np.int32)])
        return _gathered(codes, starts, sizes), np.bincount(owner, sizes, words).astype(np.int64)

    def encoded(self, texts: list[str], check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, how many each has, and which hold a word that the library's
        own encoding of it disputes (with ``check``; only for vocabularies that are encoded by words)."""
        whole = [self.library.normalize(t) for t in texts]
        odd = np.zeros(len(texts), bool)
        if not self.by_word:
            lists = [self.coded(t) for t in whole]
            ids = np.array([i for c in lists for i in c], np.int32)
            sizes = np.array([len(c) for c in lists], np.int64)
        else:
            data, offsets = text_parts(pa.array(whole, pa.large_string()))
            starts = _word_starts(data, offsets, self.joined)
            ends = np.append(starts[1:], len(data))
            text_of = np.searchsorted(offsets, starts, side="right") - 1
            parts, counts = [], []
            begin = 0
            while begin < len(starts):  # a slice of words at a time, also within one long text
                stop = max(begin + 1, int(np.searchsorted(ends, starts[begin] + SLICE, side="right")))
                flat, sizes, wrong = self._words(data, starts[begin:stop], ends[begin:stop], check)
                parts.append(flat)
                counts.append(sizes)
                odd[text_of[begin:stop][wrong]] = True
                begin = stop
            ids = np.concatenate([*parts, np.zeros(0, np.int32)])
            sizes = np.bincount(text_of, np.concatenate(counts), len(texts)).astype(np.int64) if counts else np.zeros(len(texts), np.int64)
        if not self.bytes and len(ids):  # unknown ids in a row are one
            text_of_id = np.repeat(np.arange(len(texts)), sizes)
            again = (ids[1:] == self.library.unk_id()) & (ids[:-1] == ids[1:]) & (text_of_id[1:] == text_of_id[:-1])
            kept = np.r_[True, ~again]
            ids, sizes = ids[kept], np.bincount(text_of_id[kept], minlength=len(texts))
        return ids, sizes, odd

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of consecutive words, how many each has, and which are disputed; each distinct word is coded once."""
        base = starts[0]
        offsets = pa.py_buffer(np.append(starts - base, ends[-1] - base).astype(np.int64))
        column = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(data[base : ends[-1]])).dictionary_encode()
        words, spot = column.dictionary.to_pylist(), column.indices.to_numpy()
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        flat, sizes = self.short_words([words[k] for k in short])
        lengths, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths[short], first[short] = sizes, np.cumsum(sizes) - sizes
        long = {k: self.coded(w) for k, w in enumerate(words) if len(w) > SHORT}
        at = len(flat)
        for k, code in long.items():
            lengths[k], first[k] = len(code), at
            at += len(code)
        flat = np.concatenate([flat, np.array([i for code in long.values() for i in code], np.int32)])
        wrong = np.zeros(len(words), bool)
        if check:
            # A lone blank is the empty text with its leading blank, which the library leaves out. A word without
            # a blank is asked for behind a line end, where no piece joins the two; else its texts are checked.
            lead = len(self.library.encode("\n"))
            after = np.array([w[:1] != BLANK for w in words])
            asked = np.array([k for k, w in enumerate(words) if w != BLANK], np.int64)
            found = self.library.encode([("\n" + words[k] if after[k] else words[k][1:]).replace(BLANK, " ") for k in asked], num_threads=1)
            theirs = np.array([i for c in found for i in c], np.int32)
            sizes = np.array([len(c) for c in found], np.int64)
            skip = lead * after[asked]
            same = sizes - skip == lengths[asked]
            own = _gathered(flat, first[asked][same], lengths[asked][same])
            other = _gathered(theirs, (np.cumsum(sizes) - sizes + skip)[same], (sizes - skip)[same])
            wrong[asked[~same]] = True
            wrong[np.repeat(asked[same], lengths[asked][same])[own != other]] = True
            wrong[[k for k in asked[after[asked]] if self.joined[10, words[k].encode()[0]]]] = True
        return _gathered(flat, first[spot], lengths[spot]), lengths[spot], wrong[spot]


def _word_starts(data: np.ndarray, offsets: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Byte places where words begin: at each text's begin, at blank marks that follow another letter, and
    between letters that no piece has side by side."""
    mark = BLANK.encode()
    n = len(data)
    blank = np.zeros(n, bool)
    if n > 2:
        blank[:-2] = (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    start = blank.copy()
    start[3:] &= ~blank[:-3]
    start[1:] |= ~joined[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def piece_coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_pieces(docs: DataFrame, model: str, add_end: bool = True, decode: bool = True, check: str = "words") -> DataFrame:
    """``doc_id``, ``ids`` (array of int), ``decoded`` (what the library makes of the ids; null without
    ``decode``) and ``agrees``, one row per row of ``docs``.

    ``check``: "texts" lets the library encode every whole text beside the agenda; "words" every distinct word
    of a slice, and whole texts that hold a word the two disagree on, or all where words cannot be asked for
    alone; "none" leaves ``agrees`` null. The ids are always those of the agenda. A null text counts as empty:
    the end id alone. Repeated rows and ids repeat; other columns are not carried, so their names cannot
    clash. The empty table gives the empty table. ``model`` is a path that every worker can open.
    """
    if check not in ("words", "texts", "none"):
        raise ValueError("check is words, texts or none")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        end = np.array([coder.library.eos_id()] if add_end else [], np.int32)
        words = check == "words" and coder.by_word and coder.as_is
        for batch in batches:
            for begin, stop in text_slices(batch.column("text"), SLICE):
                part = batch.slice(begin, stop - begin)
                texts = [t or "" for t in part.column("text").to_pylist()]
                flat, sizes, odd = coder.encoded(texts, words)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                if add_end:
                    flat = np.insert(flat, offsets[1:], end[0])
                    offsets += np.arange(len(offsets))
                whole = np.full(len(texts), check == "texts" or check == "words" and not words) | odd
                agrees: list[bool | None] = [None if check == "none" else True] * len(texts)
                for k in np.flatnonzero(whole):
                    agrees[k] = coder.library.encode(texts[k], add_eos=add_end) == flat[offsets[k] : offsets[k + 1]].tolist()
                decoded: list[str | None] = [None] * len(texts)
                if decode:
                    listed = flat.tolist()
                    decoded = coder.library.decode([listed[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32())),
                        pa.array(decoded, pa.string()),
                        pa.array(agrees, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "decoded", "agrees"],
                )
        settle()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, ids array<int>, decoded string, agrees boolean")


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of a column of ids: the library's decoding. Null ids give a null text.

    A column that is already named ``out`` is replaced; all others are kept as they are.
    """
    kept = [c for c in rows.columns if c != out]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        for batch in batches:
            texts = [None if i is None else coder.library.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return rows.select(*kept).mapInArrow(task, f"{kinds}, `{out}` string")


def piece_digest(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
