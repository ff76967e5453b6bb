"""A cuckoo filter over 64-bit hashes: 16-bit fingerprints, four to a bucket, two buckets to choose from."""

from __future__ import annotations

import numpy as np

from tidelog.llm.words import mix

SLOTS = 4
KICKS = 500


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


class CuckooFilter:
    """Membership with rare false positives and no false negatives; what was added can be removed again."""

    def __init__(self, buckets: int):
        self.table = np.zeros((max(2, 1 << (buckets - 1).bit_length()), SLOTS), np.uint16)

    @classmethod
    def of(cls, h: np.ndarray) -> CuckooFilter:
        """A filter that holds all these hashes, large enough for that."""
        size = int(len(h) / SLOTS / 0.8) + 1
        while True:
            out = cls(size)
            if all(out.add(x) for x in h):
                return out
            size = 2 * len(out.table)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints, mask = _fingerprints(h), np.uint64(len(self.table) - 1)
        first = mix(h) & mask
        return prints, first, first ^ (mix(prints.astype(np.uint64)) & mask)

    def add(self, h: np.uint64) -> bool:
        """Add one hash; False if the table is too full, which leaves some other entry out: build a larger one then."""
        (p,), (a,), (b,) = self._places(np.array([h], np.uint64))
        mask = np.uint64(len(self.table) - 1)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            p, self.table[b, slot] = self.table[b, slot], p
            b ^= mix(np.array([p], np.uint64))[0] & mask
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = p
                return True
        return False

    def remove(self, h: np.uint64) -> bool:
        """Take one hash out that was added before."""
        (p,), (a,), (b,) = self._places(np.array([h], np.uint64))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == p)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def has(self, h: np.ndarray) -> np.ndarray:
        p, a, b = self._places(h.astype(np.uint64))
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)
