"""Word shingles of whole texts as 64-bit hashes, a batch at a time in numpy.

Words are `[^\\x20\\x09-\\x0D]+` after lowering A-Z; a shingle is five consecutive words; a text with
fewer words gives its whole sequence as one shingle; a null or wordless text gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
_SLICE = 1 << 20  # bytes hashed at once; a longer word is hashed in one piece
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(_SLICE + 1, np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = np.cumprod(np.full(_SLICE, _BASE, np.uint64))
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of concatenated texts; bounds are the texts' first bytes and the end."""
    n = len(data)
    gap = _SPACE[data]
    start = ~gap
    start[1:] &= gap[:-1]
    inside = bounds[(bounds > 0) & (bounds < n)]
    start[inside] |= ~gap[inside]
    begins = np.flatnonzero(start)
    if not len(begins):
        return begins, np.array([], np.uint64)
    end = gap.copy()
    end[inside] = True
    # the first byte after each word: the next gap or the next word's start
    stops = np.flatnonzero(np.append(end | start, True))
    after = stops[np.searchsorted(stops, begins, side="right")]
    low = _LOWER[data]
    out = np.empty(len(begins), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(begins):
            to = max(at + 1, int(np.searchsorted(after, begins[at] + _SLICE, side="right")))
            a, b = int(begins[at]), int(after[to - 1])
            powers = _POWERS[: b - a] if b - a <= _SLICE else np.cumprod(np.full(b - a, _BASE, np.uint64))
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
            s, e = begins[at:to] - a, after[at:to] - a
            # a word's polynomial, moved to a common place by the powers that remain to the slice's end
            rest = powers[(b - a - 1) - s]
            out[at:to] = mixed((sums[e] - sums[s]) * rest * (_inverse(b - a)) + (e - s).astype(np.uint64) * _PLACES[0])
            at = to
    return begins, out


_inverses: dict[int, np.uint64] = {}


def _inverse(n: int) -> np.uint64:
    """The inverse of BASE ** (n - 1) modulo 2 ** 64."""
    if n not in _inverses:
        if len(_inverses) > 10_000:
            _inverses.clear()
        _inverses[n] = np.uint64(pow(pow(int(_BASE), n - 1, 1 << 64), -1, 1 << 64))
    return _inverses[n]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return []
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.array([], np.uint8)
    bounds = bounds - bounds[0]
    out: list[np.ndarray] = []
    at = 0
    while at < n:  # a few MB at a time
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 4 * _SLICE, side="right")) - 1)
        out += _sets(whole[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to
    return out


def _sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    begins, h = _words(data, bounds)
    first = np.searchsorted(begins, bounds)
    with np.errstate(over="ignore"):
        if len(h) >= WIDTH:
            k = len(h) - WIDTH + 1
            s = sum((h[i : i + k] * _PLACES[i] for i in range(1, WIDTH)), h[:k] * _PLACES[0])
            s = mixed(s)
        else:
            s = np.array([], np.uint64)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                out.append(np.unique(s[a : b - WIDTH + 1]))
            elif b > a:
                out.append(mixed((h[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.array([b - a], np.uint64)))
            else:
                out.append(np.array([], np.uint64))
    return out
