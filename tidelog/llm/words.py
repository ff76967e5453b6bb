"""Words of UTF-8 texts as 64-bit hashes, computed with numpy over whole buffers.

A word's hash is a polynomial over a random number per byte, taken from one running sum: the sum up to the word's end
minus the sum up to its start, shifted back by the inverse power of its start. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_numbers = np.random.Generator(np.random.PCG64(20240611))
BYTE = _numbers.integers(1, 2**63, 256, dtype=np.uint64)
LOW_BYTE = BYTE[LOWER]
OTHER_BYTE = _numbers.integers(1, 2**63, 256, dtype=np.uint64)  # for a second, independent hash
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_up, _down = powers(BASE, BLOCK), powers(INVERSE, BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: a run of bytes without ASCII white space inside one text."""
    inner = ~SPACE[data]
    if not inner.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(inner)
    before[0], before[1:] = False, inner[:-1]
    starts = inner & (~before | first[:-1])
    after = np.empty_like(inner)
    after[-1], after[:-1] = False, inner[1:]
    ends = inner & (~after | first[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True,
           table: np.ndarray | None = None) -> np.ndarray:
    """A hash for each span of bytes; spans are in order and don't overlap. Memory is bounded by BLOCK."""
    if table is None:
        table = LOW_BYTE if lower else BYTE
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, origin + BLOCK, side="right")))
        size = int(ends[to - 1]) - origin
        up, down = (_up, _down) if size <= BLOCK else (powers(BASE, size), powers(INVERSE, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(table[data[origin:origin + size]] * up[:size], out=sums[1:])
        s, e = starts[at:to] - origin, ends[at:to] - origin
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out)


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` numbers in a row; one shorter by length - 1 than the input."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(powers(BASE, length)):
        total += h[j:j + n] * factor
    return mix(total)


def whole(h: np.ndarray) -> np.uint64:
    """Hash of a sequence of numbers, its length included."""
    total = (h * powers(BASE, len(h))).sum(dtype=np.uint64) + np.uint64(len(h))
    return mix(np.array([total], np.uint64))[0]
