"""Words and shingles of UTF-8 texts as 64-bit hashes, computed on whole byte arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A polynomial hash over the prefix sums of a
segment gives each word's hash from two positions: ``(sum[end] - sum[start]) / base**start`` modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += U(32)
#: Everything in ASCII but letters and digits parts words here.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _upto(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, U(_BASE if kind == "up" else _INVERSE))
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= 4 << 20:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _segment(data: np.ndarray, row_starts: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of ``data``; no word crosses a row start."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = apart[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = space[:-1]
    cut[row_starts[row_starts < n]] = True
    starts = np.flatnonzero(~space & cut[:-1])
    after = np.empty(n + 1, bool)
    after[n] = True
    after[:n] = space
    after[row_starts] = True
    ends = np.flatnonzero(~space & after[1:]) + 1
    sums = np.cumsum(_LOWER[data] * _upto("up", n))
    h = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], U(0))
    return mix(h * _upto("down", n)[starts] + (ends - starts).astype(np.uint64)), starts, ends


def words(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words by row) of rows ``offsets[i]:offsets[i+1]``; long stretches go in segments that end at a space."""
    h, starts, _ = word_spans(data, offsets, most, apart)
    return h, np.diff(np.searchsorted(starts, offsets))


def word_spans(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of each word; bytes count from the start of ``data``."""
    lo, hi, found = int(offsets[0]), int(offsets[-1]), []
    while lo < hi:
        end = hi
        if hi - lo > most:
            end = lo + most
            rows = offsets[(offsets > lo) & (offsets <= end)]
            spaces = np.flatnonzero(apart[data[lo:end]])
            best = max(int(rows[-1]) if len(rows) else 0, lo + int(spaces[-1]) + 1 if len(spaces) else 0)
            if best <= lo:  # one word longer than a segment
                later = np.flatnonzero(apart[data[end:hi]])
                rows = offsets[offsets > end]
                best = min(int(rows[0]), end + int(later[0]) if len(later) else hi)
            end = best
        inner = offsets[(offsets >= lo) & (offsets <= end)] - lo
        h, s, e = _segment(data[lo:end], inner.astype(np.int64), apart)
        found.append((h, s + lo, e + lo))
        lo = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_STEP = U(0xD6E8FEB86659FD93)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, ascending, of the k-word shingles of one text's word hashes; of all its words, where they are fewer."""
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, U(width))
    for i in range(width):
        out = out * _STEP + h[i : len(h) - width + 1 + i]
    return np.unique(mix(out))
