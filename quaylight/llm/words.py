"""Words and word windows of whole texts as arrays of hashes.

Texts arrive as Arrow string columns; their bytes are used where they lie. A word's hash is a polynomial
over its bytes and a window's hash a polynomial over its words' hashes, both read from prefix sums modulo
2^64, so all words of a batch cost a few vector operations. Two different sequences share a 64-bit hash
with probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse, kept and lengthened on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(lower: bool) -> np.ndarray:
    """One random 64-bit value per byte; with ``lower``, A-Z count as a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


def space_separated() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


PLAIN, LOWER, INSIDE = byte_values(False), byte_values(True), space_separated()


def text_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_SLICE`` bytes that split no word."""
    begin, end = 0, len(data)
    while begin < end:
        stop = min(end, begin + _SLICE)
        while stop < end:
            k = np.searchsorted(offsets, stop)
            if k < len(offsets) and offsets[k] == stop or not inside[data[stop]]:
                break
            stop += 1
        yield begin, stop
        begin = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = PLAIN, inside: np.ndarray = INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the place of its first word (one more entry at the end)."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for begin, stop in _cuts(data, offsets, inside):
        part = data[begin:stop]
        word = inside[part]
        heads = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, stop)] - begin
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = np.unique(heads)
        first[heads] = word[heads]
        last = word.copy()
        last[:-1] &= ~word[1:]
        tails = heads[heads > 0] - 1
        last[tails] = word[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        up, down = _BYTES.upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up, out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        owner = np.searchsorted(offsets, starts + begin, side="right") - 1
        counts += np.bincount(owner, minlength=len(counts))
    places = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=places[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), places


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` words from each place on, texts notwithstanding."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def window_owner(places: np.ndarray, size: int, total: int) -> np.ndarray:
    """The text of each window place, -1 where a window would leave its text."""
    n = max(0, total - size + 1)
    owner = np.repeat(np.arange(len(places) - 1), np.diff(places))
    if not n:
        return np.zeros(0, np.int64)
    head = owner[:n].copy()
    head[owner[size - 1 : size - 1 + n] != head] = -1
    return head


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes of text each, one row at least."""
    _, offsets = text_parts(column)
    begin, n = 0, len(offsets) - 1
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield begin, min(stop, n)
        begin = stop
