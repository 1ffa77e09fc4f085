"""Suffix arrays of many short slices at a time, and their common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

from .common import rows_of


def suffix_array(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the slices data[bounds[i]:bounds[i+1]] in order, and each position's place in it.

    Larsson-Sadakane: suffixes are ranked by their first 7 symbols, then only groups of equal rank are sorted anew, by
    the rank of what follows, over twice as many symbols each time. A slice's end comes before every byte; suffixes
    that are equal up to their ends are in order of position.
    """
    n = len(data)
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(n)
    # seven symbols of nine bits: a byte plus one, or zero from the slice's end on
    left = np.minimum(end - at, 7)
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | wide[j : j + n]
    key &= ~((np.uint64(1) << (np.uint64(9) * (7 - left).astype(np.uint64))) - np.uint64(1))
    order = np.argsort(key)
    ranked = key[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    todo = order[np.repeat(size > 1, size)]
    h, longest = 7, int(np.diff(bounds).max()) if len(bounds) > 1 else 0
    while len(todo) and h < longest:
        after = todo + h
        follow = np.where(after < end[todo], rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[todo]
        pair = own * (n + 1) + follow
        sort = np.argsort(pair)
        todo, own, pair = todo[sort], own[sort], pair[sort]
        group = np.concatenate(([True], own[1:] != own[:-1]))
        begin = np.flatnonzero(group)
        inside = np.arange(len(todo)) - np.repeat(begin, np.diff(np.append(begin, len(todo))))
        head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        size = np.diff(np.append(head, len(todo)))
        rank[todo] = np.repeat(own[head] + inside[head], size)
        todo = todo[np.repeat(size > 1, size)]
        h *= 2
    sa = np.argsort(rank * n + at) if len(todo) else np.argsort(rank)
    place = np.empty(n, np.int64)
    place[sa] = at
    return sa, place


def common_prefixes(data: np.ndarray, bounds: np.ndarray, sa: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Kasai: for each place in sa, the length of the prefix shared with the suffix before it.

    Going on by one position shortens the common prefix by one at most. All slices are walked side by side.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int32)
    end = np.repeat(bounds[1:], np.diff(bounds))
    before = np.where(place > 0, sa[place - 1], -1)  # by position
    out = np.zeros(n, np.int32)
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)[: n + 1]
    words = np.ascontiguousarray(words).view("<u8").reshape(-1)  # eight bytes from each position on
    lengths = np.diff(bounds)
    by_length = np.argsort(-lengths, kind="stable")
    first, lengths = bounds[:-1][by_length], lengths[by_length]
    held = np.zeros(len(first), np.int64)
    for j in range(int(lengths[0]) if len(lengths) else 0):
        alive = np.searchsorted(-lengths, -j, "left")  # slices longer than j
        i = first[:alive] + j
        k = before[i]
        h = np.maximum(held[:alive] - 1, 0)
        h[k < 0] = 0
        todo = np.flatnonzero(k >= 0)
        most = np.minimum(end[i] - i, np.where(k >= 0, end[k] - k, 0))
        while len(todo):
            a, b, hh = i[todo], k[todo], h[todo]
            room = most[todo] - hh
            differ = words[np.minimum(a + hh, n)] ^ words[np.minimum(b + hh, n)]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(lowest.astype(np.float64) + (differ == 0)) // 8).astype(np.int64))
            step = np.minimum(same, np.maximum(room, 0))
            h[todo] = hh + step
            todo = todo[(step == 8)]
        held[:alive] = h
        out[place[i]] = h
    return out


def repeated_windows(data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """True for each position whose next `length` bytes, within its slice, also begin at another position."""
    sa, place = suffix_array(data, bounds)
    lcp = common_prefixes(data, bounds, sa, place)
    near = lcp >= length
    flags = np.zeros(len(data), bool)
    flags[sa[near]] = True
    flags[sa[np.flatnonzero(near) - 1]] = True
    return flags


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], reach[last]


def slices_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and their bounds."""
    return data[rows_of(start, end - start)], np.concatenate(([0], np.cumsum(end - start)))
