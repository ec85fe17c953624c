"""Vectorised spans and hashes over batches of texts, for use inside tasks.

All functions here work on the bytes of an Arrow string column at once, so
that a batch costs a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space and the five ASCII controls from tab to carriage return.
WORD_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LINE_SEPARATORS = (0x0A,)
#: Bytes of text worked on at once; numpy temporaries take about 40 times this.
SLICE_BYTES = 2 << 20

#: Odd multipliers of the two lanes of hashes: a lane alone is 64 bits, both together 128.
_FOLD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPREAD = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x165667B19E3779F9))
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a span that are hashed along with all other spans; what is beyond goes through BLAKE2b, span by span.
_TOGETHER = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fold(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """A hash of two hashes in order; for either of them given, a bijection of the other."""
    out = a * _FOLD[lane]
    out += b
    out ^= out >> np.uint64(32)
    out *= _SPREAD[lane]
    out ^= out >> np.uint64(29)
    return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def split(data: np.ndarray, offsets: np.ndarray, separators: tuple[int, ...] = WORD_SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes without separators."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    inside = table[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets[1:], begin, side="right")


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes; lanes are independent.

    Spans are read in words of 8 bytes, each folded in by a bijection, so that
    spans of up to 8 bytes and equal length never collide and no pattern of
    bytes cancels out, as it does in a sum of powers modulo 2^64.
    """
    size = end - begin
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = fold(size.astype(np.uint64) + np.uint64(1), words[begin] & _MASK[np.minimum(size, 8)], lane)
    at, more = 8, np.flatnonzero(size > 8)
    while len(more) and at < _TOGETHER:
        out[more] = fold(out[more], words[begin[more] + at] & _MASK[np.minimum(size[more] - at, 8)], lane)
        at += 8
        more = more[size[more] > at]
    for k in more.tolist():
        rest = hashlib.blake2b(np.ascontiguousarray(data[begin[k] + at : end[k]]), digest_size=8, salt=bytes([lane])).digest()
        out[k : k + 1] = fold(out[k : k + 1], np.frombuffer(rest, "<u8"), lane)
    return mix(out)


def hash_windows(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive values, from hashes of 1, 2, 4, ... values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, span = np.full(n, width, np.uint64), 0, values, 1
    while at < width:
        if width & span:
            out = fold(out, level[at : at + n], lane)
            at += span
        if at < width:
            level = fold(level[:-span], level[span:], lane)
            span *= 2
    return out


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of bytes, all spans at once, step by step of the hash's published definition."""
    size, seed = end - begin, np.uint64(seed)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    halves = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    round_ = lambda acc, word: _left(acc + word * _P[1], 31) * _P[0]
    out, at = np.full(len(begin), seed + _P[4]), begin.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        acc = [np.full(len(long), x) for x in (seed + _P[0] + _P[1], seed + _P[1], seed, seed - _P[0])]
        some = np.arange(len(long))
        while len(some):
            for k in range(4):
                acc[k][some] = round_(acc[k][some], words[at[long[some]] + 8 * k])
            at[long[some]] += 32
            some = some[at[long[some]] + 32 <= end[long[some]]]
        h = _left(acc[0], 1) + _left(acc[1], 7) + _left(acc[2], 12) + _left(acc[3], 18)
        for k in range(4):
            h = (h ^ round_(np.zeros(len(long), np.uint64), acc[k])) * _P[0] + _P[3]
        out[long] = h
    out += size.astype(np.uint64)
    some = np.flatnonzero(at + 8 <= end)
    while len(some):
        out[some] = _left(out[some] ^ round_(np.zeros(len(some), np.uint64), words[at[some]]), 27) * _P[0] + _P[3]
        at[some] += 8
        some = some[at[some] + 8 <= end[some]]
    some = np.flatnonzero(at + 4 <= end)
    out[some] = _left(out[some] ^ (halves[at[some]].astype(np.uint64) * _P[0]), 23) * _P[1] + _P[2]
    at[some] += 4
    some = np.flatnonzero(at < end)
    while len(some):
        out[some] = _left(out[some] ^ (padded[at[some]].astype(np.uint64) * _P[4]), 11) * _P[0]
        at[some] += 1
        some = some[at[some] < end[some]]
    out = (out ^ (out >> np.uint64(33))) * _P[1]
    out = (out ^ (out >> np.uint64(29))) * _P[2]
    return out ^ (out >> np.uint64(32))


def leftmost_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``width`` consecutive values and its leftmost place."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, place, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        span += step
    return least[:n], place[:n]


def groups_of(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every distinct key with the places that hold it, in order."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        cut = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cut):
            yield int(keys[part[0]]), part
