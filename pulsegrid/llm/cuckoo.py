"""A cuckoo filter over 64-bit key hashes, vectorised over whole batches of keys.

Partial-key cuckoo hashing: a key keeps a 16-bit fingerprint in one of two buckets of four slots, and the second bucket
follows from the first and the fingerprint alone, so entries can move and be deleted without the key. The filter
answers "surely absent" or "perhaps present"; its owner keeps the keys, verifies hits against them and rebuilds the
filter from them when it overflows.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8
KICKS = 200


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class CuckooFilter:
    def __init__(self, capacity: int, table: bytes | None = None) -> None:
        """``capacity``: keys it should hold; with ``table`` (of :meth:`to_bytes`) it continues a stored filter."""
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * LOAD)))))
            self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        else:
            self.table = np.frombuffer(table, dtype=np.uint16).reshape(-1, SLOTS).copy()

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mixed(keys.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (_mixed(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds keys that are not in yet; False on overflow, after which the owner must rebuild."""
        prints, bucket, other = self._places(keys)
        for kick in range(KICKS):
            if not len(prints):
                return True
            for _ in range(2):
                prints, bucket, other = self._fill(prints, bucket, other)
                bucket, other = other, bucket
                if not len(prints):
                    return True
            # both buckets are full: in each bucket one waiting entry takes the place of a resident, which moves on
            _, chosen = np.unique(bucket, return_index=True)
            slot = kick % SLOTS
            moved = self.table[bucket[chosen], slot].copy()
            self.table[bucket[chosen], slot] = prints[chosen]
            prints[chosen] = moved
            other[chosen] = bucket[chosen]
            bucket[chosen] = self._other(bucket[chosen], moved)
        return not len(prints)

    def _fill(self, prints: np.ndarray, bucket: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Puts entries into free slots of ``bucket``; returns those that found none."""
        for _ in range(SLOTS):
            free = self.table[bucket] == 0
            can = np.flatnonzero(free.any(axis=1))
            if not len(can):
                break
            place = bucket[can] * SLOTS + free[can].argmax(axis=1)
            place, first = np.unique(place, return_index=True)
            self.table.reshape(-1)[place] = prints[can[first]]
            rest = np.ones(len(prints), dtype=bool)
            rest[can[first]] = False
            prints, bucket, other = prints[rest], bucket[rest], other[rest]
            if not len(prints):
                break
        return prints, bucket, other

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that are in; deleting a key that never was in would damage others, so the owner verifies first."""
        prints, a, b = self._places(keys)
        while len(prints):
            here = np.concatenate([self.table[a], self.table[b]], axis=1) == prints[:, None]
            found = here.any(axis=1)
            at = here.argmax(axis=1)
            place = np.where(at < SLOTS, a * SLOTS + at, b * SLOTS + at - SLOTS)
            place, chosen = np.unique(np.where(found, place, -1), return_index=True)
            chosen, place = chosen[place >= 0], place[place >= 0]
            if not len(place):
                return
            self.table.reshape(-1)[place] = 0
            rest = found.copy()
            rest[chosen] = False
            prints, a, b = prints[rest], a[rest], b[rest]
