"""Vectorised word and substring hashes over UTF-8 bytes.

A span's hash sums a nonlinear mix of each of its eight-byte blocks and the block's place, so no text is built that meets another by algebra;
a chance collision of two of n spans has odds of n * n / 2**65. Substring hashes of `_tables` powers (lines.py) only route candidates.
The constants are drawn once from a seeded generator, so every executor has the same ones.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_POS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, (1 << 18) + 1)  # a usual run of texts (lines.CHUNK); workers keep the tables
        powers = np.full(size, _BASE, np.uint64)
        powers[0] = 1
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _powers[:] = [np.multiply.accumulate(powers), np.multiply.accumulate(inverse)]
    return _powers[0], _powers[1]


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each span of a byte buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes, seed = ends - starts, U(seed)
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix((eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]) + seed)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        first = np.cumsum(more) - more
        place = np.arange(more.sum()) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * place
        block = eight[at] & _FIRST_BYTES[np.minimum(np.repeat(ends[long], more) - at, 8)]
        out[long] += np.add.reduceat(mix(block + seed + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)), first)
    return mix(out + sizes.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of the maximal runs of bytes other than space and 0x09-0x0D."""
    n = len(data)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end); A-Z are lower-cased if asked for."""
    starts, ends, rows = words(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), rows


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words inside a row, first shingle of each row and the end).

    A row of 1 to size-1 words has one shingle, its whole sequence; a row without words has none.
    """
    n = len(hashes)
    count = np.diff(rows)
    full = np.maximum(count - size + 1, 0)
    out_rows = np.concatenate([[0], np.cumsum(np.where((full == 0) & (count > 0), 1, full))])
    out = np.empty(out_rows[-1], np.uint64)
    if n >= size:
        total = hashes[: n - size + 1] * _POS[0]
        for j in range(1, size):
            total = total + hashes[j : n - size + 1 + j] * _POS[j]
        total = mix(total)
        width = full[full > 0]
        begin = rows[:-1][full > 0]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        to = np.repeat(out_rows[:-1][full > 0] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        out[to] = total[at]
    for r in np.flatnonzero((full == 0) & (count > 0)):
        own = hashes[rows[r] : rows[r + 1]]
        value = U(int(count[r]))
        with np.errstate(over="ignore"):
            for j in range(len(own)):
                value = value + own[j] * _POS[j]
        out[out_rows[r]] = mix(np.array([value]))[0]
    return out, out_rows
