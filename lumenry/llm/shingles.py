"""Word shingles of many texts at a time, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import rows_of
from .hashing import MIX_B, Spans, mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(parts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each part in reading order, and where each part's begin; parts are joined by newlines."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.concatenate(([True], space)) != np.concatenate((space, [True])))
    starts, ends = edge[::2], edge[1::2]
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    at = np.searchsorted(starts, first)
    at[-1] = len(starts)
    return Spans(data).of(starts, ends), at


def shingle_hashes(parts: list[bytes], n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of n words of each part with repeats (of fewer words: all of them as one), and where each part's begin."""
    words, at = word_hashes(parts, lower)
    counts = np.diff(at)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = rows_of(at[:-1], made)
    span = np.repeat(np.minimum(counts, n), made)
    return Spans(words).of(begin, begin + span), np.concatenate(([0], np.cumsum(made)))


def shingle_sets(parts: list[bytes], n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each part, and where each part's begin."""
    hashes, at = shingle_hashes(parts, n, lower)
    part = np.repeat(np.arange(len(parts)), np.diff(at))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(part[order], kind="stable")]
    hashes, part = hashes[order], part[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (part[1:] != part[:-1])
    hashes, part = hashes[new], part[new]
    return hashes, np.searchsorted(part, np.arange(len(parts) + 1))


def set_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, the same for equal sets, 0 for empty ones."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ MIX_B))))
    sizes = np.diff(at).astype(np.uint64)
    key = mix64((total[at[1:]] - total[at[:-1]]) ^ mix64(sizes + np.uint64(3)))
    return np.where(sizes == 0, np.uint64(0), key)


#: Shingles of a set for each counter of its map, at most; and the greatest count that a counter holds.
SHARED, MOST = 4, 15


def count_maps(hashes: np.ndarray, at: np.ndarray) -> pa.BinaryArray:
    """A map of each set: how many of its shingles fall on each counter, by their hash modulo the number of counters.

    Numbers of counters are powers of two, so that a map whose halves are added is the map of half the size. A byte holds
    a counter of the first half and, in its upper four bits, one of the second. An empty set's map is empty.
    """
    sizes = np.diff(at)
    room = np.where(sizes > 0, 2 << np.ceil(np.log2(np.maximum(sizes / SHARED / 2, 1))).astype(np.int64), 0)
    first = np.cumsum(room) - room
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = first[owner] + (hashes & (room[owner] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=int(room.sum())), MOST).astype(np.uint8)
    low = rows_of(first, room // 2)
    packed = counts[low] | counts[low + np.repeat(room // 2, room // 2)] << np.uint8(4)
    ends = np.concatenate(([0], np.cumsum(room // 2))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])


def map_bytes(maps: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of maps, none of them null, where each map begins and how many bytes it has."""
    maps = pa.concat_arrays(maps.chunks) if isinstance(maps, pa.ChunkedArray) else maps
    ends = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
    return np.frombuffer(maps.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)


def most_common(flat: np.ndarray, first: np.ndarray, room: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound on the overlap of sets i and j: of shingles on one counter, no more are common than the lesser count; those
    that a full counter left out are a set's size less its counts."""
    out = np.zeros(len(i), np.int64)
    kind = room[i] * (1 << 32) + room[j]
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        a, b = (flat[first[x[at]][:, None] + np.arange(int(room[x[at[0]]]))] for x in (i, j))
        a, b = (np.concatenate((x & 15, x >> 4), axis=1).astype(np.uint16) for x in (a, b))
        while a.shape[1] != b.shape[1]:
            half = max(a.shape[1], b.shape[1]) // 2
            a, b = (x[:, :half] + x[:, half:] if x.shape[1] > half else x for x in (a, b))
        left = np.minimum(size[i[at]] - a.sum(1, dtype=np.int64), size[j[at]] - b.sum(1, dtype=np.int64))
        out[at] = np.minimum(a, b).sum(1, dtype=np.int64) + left
    return out
