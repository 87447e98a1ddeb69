"""Words and lines of many texts at once, as arrays of offsets and 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Between words: space and the five ASCII controls from tab to carriage return.
IS_GAP = np.zeros(256, bool)
IS_GAP[[32, *range(9, 14)]] = True
#: Bytes of text measured at once: the arrays of places and hashes take about 80 times that.
SLICE_BYTES = 1_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random number for each byte at each of 64 places; further on, the places repeat under other odd factors.
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 64 * 256, np.uint64, endpoint=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never reaches into the next text."""
    inside = ~IS_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes; stretches are in order and don't overlap.

    The sum of the random numbers of its bytes at their places, so no pattern of bytes makes equal sums more likely.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    flat = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _CODES[(flat & 63) << 8 | data[np.repeat(starts, lengths) + flat]]
    if lengths.max() > 64:
        values *= mix(flat.astype(np.uint64) >> np.uint64(6)) | np.uint64(1)
    full = lengths > 0
    out = np.zeros(len(starts), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashed: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of `width` words of one text."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashed[:n].copy()
    for k in range(1, width):
        total = mix(total) + hashed[k : n + k]
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(total[first]), first


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows counted, or weights summed, as whole numbers."""
    return np.bincount(rows, weights, n).astype(np.int64)
