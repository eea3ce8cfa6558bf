"""Hashes of many runs of bytes at once, by array operations.

A run's hash is a polynomial in its bytes. One cumulative sum over all bytes gives those of all runs:
the difference of two sums, divided by the power of the base that the run begins at. So it depends on the run's
bytes alone, wherever they stand and however the text around is cut.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes that are summed at once.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
VALUES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return tuple(np.cumprod(np.full(PIECE, x, dtype=np.uint64), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``raw[start:end]``, which follow each other."""
    up, down = powers()
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        last = max(at + 1, int(np.searchsorted(ends, a + PIECE, side="right")))
        b = int(ends[last - 1])
        if b - a <= PIECE:
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(VALUES[raw[a:b]] * up[: b - a], out=sums[1:])
            first = starts[at:last] - a
            out[at:last] = (sums[ends[at:last] - a] - sums[first]) * down[first]
        else:  # one run longer than a piece
            total, factor = 0, 1
            for k in range(a, b, PIECE):
                part = raw[k : min(k + PIECE, b)]
                total += int((VALUES[part] * up[: len(part)]).sum(dtype=np.uint64)) * factor
                factor = factor * int(up[-1]) % (1 << 64)
            out[at] = np.uint64(total * pow(BASE, -1, 1 << 64) % (1 << 64))
        at = last
    return mixed(out)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of unsigned 64-bit numbers, the lowest bit of the first number first."""
    data = np.ascontiguousarray(rows.astype("<u8", copy=False)).view(np.uint8).reshape(len(rows), -1)
    total = np.zeros(8 * data.shape[1], dtype=np.int64)
    for at in range(0, len(data), 255):  # sums of bytes that stay bytes
        total += np.unpackbits(data[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return total
