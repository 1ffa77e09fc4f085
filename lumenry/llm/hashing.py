"""Hashes of slices of arrays, in numpy. Equal slices have equal hashes at any place; no structured strings share one.

`Spans` joins hashes of runs of 1, 2, 4, ... units, each from two of half its length, by a function that isn't linear.
`Rolling` holds prefix sums of a polynomial modulo the prime 2**61 - 1.
"""

from __future__ import annotations

import numpy as np

MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
JOIN_A, JOIN_B, JOIN_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public MurmurHash3 family over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= MIX_A
    x ^= x >> np.uint64(33)
    x *= MIX_B
    x ^= x >> np.uint64(33)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    x = a * JOIN_A
    x += b * JOIN_B
    x ^= x >> np.uint64(32)
    x *= JOIN_C
    x ^= x >> np.uint64(29)
    return x


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_PAIRS = joined(np.repeat(_BYTES, 256), np.tile(_BYTES, 256))


class Spans:
    """Hashes of slices of one array of units."""

    def __init__(self, units: np.ndarray):
        self.units = units

    def _first(self) -> np.ndarray:
        return _BYTES[self.units] if self.units.dtype == np.uint8 else mix64(self.units.astype(np.uint64) + np.uint64(1))

    def _grown(self, runs: np.ndarray | None, width: int) -> np.ndarray:
        """Hashes of all runs of twice the width, from those of the width."""
        if width == 1 and self.units.dtype == np.uint8:
            return _PAIRS[(self.units[:-1].astype(np.uint16) << np.uint16(8)) | self.units[1:]]
        return joined(runs[:-width], runs[width:])

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all runs of `width` units, a power of two."""
        runs, w = self._first() if width == 1 or self.units.dtype != np.uint8 else None, 1
        while w < width:
            runs, w = self._grown(runs, w), 2 * w
        return runs

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all slices of k units."""
        width = 1 << (k.bit_length() - 1)
        runs = self.runs(width)
        return runs if width == k else joined(runs[: len(runs) - k + width], runs[k - width :])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of slices of one unit or more: of the longest runs that begin and end them, and of their lengths."""
        size = end - start
        level = np.log2(np.maximum(size, 1)).astype(np.int64)
        out = np.zeros(len(start), np.uint64)
        if not len(out):
            return out
        most, runs, width = int(level.max()), self._first(), 1
        todo, begin = np.arange(len(out)), start
        for p in range(most + 1):
            here = level[todo] == p
            if here.any():
                at, b = todo[here], begin[here]
                out[at] = joined(joined(runs[b], runs[b + size[at] - width]), size[at].astype(np.uint64))
                todo, begin = todo[~here], begin[~here]
            if p == most:
                return out
            if width > 1 and int(size[todo].sum()) * 4 < len(runs):
                runs, begin = _packed(runs, begin, size[todo], width)
                runs = joined(runs[:-width], runs[width:])
            else:
                runs = self._grown(runs, width)
            width *= 2
        return out


def _packed(runs: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs inside some slices alone, one slice after another, and where each slice's begin."""
    counts = size - width + 1
    ends = np.cumsum(counts)
    first = ends - counts
    return runs[np.arange(int(ends[-1])) - np.repeat(first, counts) + np.repeat(begin, counts)], first


def chained(runs: np.ndarray, width: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of `width` units or more, from the hashes of runs that cover them one after another."""
    out = (end - start).astype(np.uint64)
    steps, todo, j = -(-(end - start) // width), np.arange(len(start)), 0
    while len(todo):
        out[todo] = joined(out[todo], runs[np.minimum(start[todo] + j * width, end[todo] - width)])
        j += 1
        todo = todo[steps[todo] > j]
    return out


PRIME = np.uint64(2**61 - 1)
BASE = 0x1B873593CC9E2D51 % (2**61 - 1)
_LOW31, _LOW30, _LOW32, _LOW29 = (np.uint64((1 << k) - 1) for k in (31, 30, 32, 29))
_31, _30, _32, _29, _61 = (np.uint64(k) for k in (31, 30, 32, 29, 61))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _61)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, from halves of 31 and 30 bits: 2**62 is 2 there and 2**61 is 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = a1 * b0
    mid += a0 * b1
    out = a1 * b1
    out <<= np.uint64(1)
    out += mid >> _30
    mid &= _LOW30
    mid <<= _31
    out += mid
    out += a0 * b0
    return _reduced(out)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), at least, modulo the prime; what was made once is kept."""
    held = _POWERS.get(base, np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate((held, times(held, np.full(1, pow(base, len(held), 2**61 - 1), np.uint64))))
    _POWERS[base] = held
    return held


class Rolling:
    """Rolling hashes of slices of one array of units below the prime."""

    BACK = pow(BASE, -1, 2**61 - 1)

    def __init__(self, units: np.ndarray):
        n = len(units)
        value = times(units.astype(np.uint64) + np.uint64(1), powers(BASE, n)[:n])
        high = np.cumsum(value >> _32)
        total = np.cumsum(value & _LOW32)
        total += high >> _29
        total += (high & _LOW29) << _32
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = _reduced(total)
        self.back = powers(self.BACK, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Below 2**61, also by the slices' lengths."""
        value = times(_reduced(self.sums[end] + (PRIME - self.sums[start])), self.back[start])
        return mix64(value ^ mix64((end - start).astype(np.uint64))) >> np.uint64(4)
