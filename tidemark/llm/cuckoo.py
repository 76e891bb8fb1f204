"""A cuckoo filter over 128-bit keys, with vectorised lookup."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Partial-key cuckoo hashing: 32-bit fingerprints in buckets of four, deletable.

    Keys are pairs (hi, lo) of uint64. A key's two buckets are i and i ^ mix(fingerprint).
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint32)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.84))))))

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        out = cls(0)
        out.table = np.frombuffer(data, dtype=np.uint32).reshape(-1, SLOTS).copy()
        return out

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        fp = (hi >> np.uint64(32)).astype(np.uint32)
        fp[fp == 0] = 1
        one = lo & mask
        return fp, one.astype(np.int64), (one ^ self._step(fp)).astype(np.int64)

    def _step(self, fp: np.ndarray) -> np.ndarray:
        mixed = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)) & np.uint64(len(self.table) - 1)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if not len(hi):
            return np.zeros(0, dtype=bool)
        fp, one, two = self._places(hi, lo)
        fp = fp[:, None]
        return (self.table[one] == fp).any(axis=1) | (self.table[two] == fp).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if some key found no room; the filter must then be rebuilt larger."""
        table = self.table
        for fp, one, two in zip(*self._places(hi, lo), strict=True):
            for at in (one, two):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = fp
                    break
            else:
                at = two
                for kick in range(KICKS):
                    slot = (kick + int(fp)) % SLOTS
                    fp, table[at, slot] = table[at, slot], fp
                    at = int(at) ^ int(self._step(np.array([fp]))[0])
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Remove keys that are in the filter."""
        for fp, one, two in zip(*self._places(hi, lo), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        n = len(hi)
        while True:
            out = cls.sized(n)
            if out.insert(hi, lo):
                return out
            n = 2 * n + SLOTS
