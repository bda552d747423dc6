"""Vectorised byte operations on the text column of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []

#: Bytes that are white space: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = ~SPACE
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z has become a-z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


#: Places of a span whose numbers are looked up; beyond them they are computed.
_PLACES = 64
_SEED = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of spans that are hashed at once.
_AT_ONCE = 1 << 20


def _numbers(at: np.ndarray) -> np.ndarray:
    return mix(at.astype(np.uint64) * BASE + _SEED)


_LOOKUP = _numbers(np.arange(_PLACES << 8))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal bytes, equal hash.

    Tabulation: every byte at every place of a span has a number of its own, and a span's hash is
    mixed from their sum. Unlike a polynomial, no pattern of letters makes terms cancel.
    """
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    filled = np.flatnonzero(lengths > 0)
    begin, whole = 0, np.cumsum(lengths[filled])
    while begin < len(filled):
        until = max(begin + 1, int(np.searchsorted(whole, (whole[begin - 1] if begin else 0) + _AT_ONCE, "right")))
        some = filled[begin:until]
        size = lengths[some]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        key = (place << 8) | data[place + np.repeat(starts[some], size)]
        if size.max() <= _PLACES:
            values = _LOOKUP[key]
        else:
            values = _LOOKUP[np.minimum(key, len(_LOOKUP) - 1)]
            far = np.flatnonzero(place >= _PLACES)
            values[far] = _numbers(key[far])
        out[some] = np.add.reduceat(values, first)
        begin = until
    return mix(out + lengths.astype(np.uint64))


class Words:
    """Words of a batch: byte spans, and offsets of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        n = len(data)
        inside = word_bytes[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        opens = inside & (first[:-1] | ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        closes = inside & (first[1:] | ~after)
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.offsets)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return span_hashes(data, self.starts, self.ends)


def by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i+1])."""
    return np.diff(prefix(values.astype(np.int64))[offsets])


def rows_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all positions of the spans (start, length), one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.zeros(0, np.int64)
    return np.arange(total) + shift


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of every window of `width` words inside one text."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = prefix(hashes * up[:-1])
    last = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(n) + width <= last)
    return at, mix((sums[at + width] - sums[at]) * down[at])


def covered(at: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie inside any span (at, length)."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + lengths, -1)
    return np.cumsum(marks[:-1]) > 0
