"""Vectorised kernels over the bytes of an Arrow text column: word spans and XXH64 of byte spans.

Words are the runs of bytes other than 0x20 and 0x09-0x0D. Kernels work on slices of a batch (``slices``), so their
memory is bounded by the slice, or by one text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Spans above this many bytes are hashed one by one; shorter ones all together.
LONG_SPAN = 512
_BLOCK = 1 << 15


@dataclass
class Words:
    """Words of several texts: ``buf`` has 8 spare bytes at its end; text i has the words first[i] to first[i+1]-1."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    begin, total = 0, 0
    for i, size in enumerate(sizes.to_pylist()):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def scan(texts: pa.Array, *, lower: bool = False, squeeze: bool = False) -> Words:
    """Find the words. ``lower`` lower-cases A-Z; ``squeeze`` leaves one 0x20 between the words of a text in ``buf``."""
    column = texts.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    inside = ~_SPACE[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    if lower:
        data = _LOWER[data]
    if squeeze:
        keep = inside | before
        place = np.cumsum(keep, dtype=np.int32 if n < 1 << 31 else np.int64)
        data = np.where(inside, data, np.uint8(0x20))[keep]
        start, end = place[start].astype(np.int64) - 1, place[end - 1].astype(np.int64)
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = data
    return Words(buf, start, end, first)


# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_block(lanes: np.ndarray, words: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    acc = np.full(len(start), seed + _P5, np.uint64)
    pos = start.copy()
    big = np.flatnonzero(size >= 32)
    if len(big):
        s, n = start[big], size[big]
        v = [np.full(len(big), seed + x, np.uint64) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        for k in range(int(n.max()) // 32):
            on = slice(None) if k == 0 else np.flatnonzero(n >= 32 * (k + 1))
            at = s[on] + 32 * k
            for j in range(4):
                v[j][on] = _round(v[j][on], lanes[at + 8 * j])
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        acc[big] = h
        pos[big] += n // 32 * 32
    acc += size.astype(np.uint64)
    left = size % 32
    for k in range(3):
        on = np.flatnonzero(left >= 8 * (k + 1))
        if not len(on):
            break
        lane = lanes[pos[on] + 8 * k]
        acc[on] = _rotl(acc[on] ^ _round(np.zeros_like(lane), lane), 27) * _P1 + _P4
    pos += left // 8 * 8
    left = left % 8
    on = np.flatnonzero(left >= 4)
    acc[on] = _rotl(acc[on] ^ (words[pos[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    pos[on] += 4
    left = left % 4
    for k in range(3):
        on = np.flatnonzero(left > k)
        acc[on] = _rotl(acc[on] ^ (buf[pos[on] + k].astype(np.uint64) * _P5), 11) * _P1
    acc = (acc ^ (acc >> np.uint64(33))) * _P2
    acc = (acc ^ (acc >> np.uint64(29))) * _P3
    return acc ^ (acc >> np.uint64(32))


def xxh64_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of ``buf`` (which must have 8 spare bytes at its end), as unsigned 64-bit integers."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    lanes = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    words = np.ndarray((len(buf) - 3,), dtype="<u4", buffer=buf, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        for i in range(0, len(start), _BLOCK):
            s, n = start[i : i + _BLOCK], size[i : i + _BLOCK]
            far = n > LONG_SPAN
            out[i : i + _BLOCK] = _xxh64_block(lanes, words, buf, s, np.where(far, 0, n) if far.any() else n, np.uint64(seed))
            for j in np.flatnonzero(far):
                out[i + j] = xxhash.xxh64_intdigest(buf[s[j] : s[j] + n[j]].tobytes(), seed)
    return out
