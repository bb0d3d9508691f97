"""A cuckoo filter over batches of 64-bit hashes: insert, look up, remove.

A key has two buckets of four 16-bit fingerprints; the second follows from the first
and the fingerprint, so entries can move, and be removed, without the key.  All three
operations work on whole arrays.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
_ROUNDS = 400


class Cuckoo:
    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) uint16, 0 for empty
        self.mask = np.int64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """Room for ``keys`` at half load or less."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) * 2 / SLOTS))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (h & np.uint64(self.mask)).astype(np.int64), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        scattered = (mark.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)
        return bucket ^ (scattered & np.uint64(self.mask)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        bucket, mark = self._places(h)
        here = (self.table[bucket] == mark[:, None]).any(axis=1)
        return here | (self.table[self._other(bucket, mark)] == mark[:, None]).any(axis=1)

    def _put(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Fills free slots; true where an entry found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        new = np.ones(len(b), bool)
        new[1:] = b[1:] != b[:-1]
        nth = np.arange(len(b)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        free = self.table[b] == 0
        fits = nth < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free, axis=1) == (nth + 1)[:, None], axis=1)
        self.table[b[fits], slot[fits]] = mark[order[fits]]
        done = np.zeros(len(bucket), bool)
        done[order[fits]] = True
        return done

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Adds all hashes; returns those that found no place (hashes of moved entries can't be known: none is lost,
        the table is put back as it was and everything is returned)."""
        before = self.table.copy()
        bucket, mark = self._places(h)
        luck = np.random.Generator(np.random.PCG64(len(h)))
        for _ in range(_ROUNDS):
            if not len(bucket):
                return h[:0]
            left = ~self._put(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            other = self._other(bucket, mark)
            left = ~self._put(other, mark)
            bucket, mark = other[left], mark[left]
            if len(bucket):  # one entry of each full bucket makes room and goes to its other bucket
                _, first = np.unique(bucket, return_index=True)
                slot = luck.integers(0, SLOTS, len(first))
                out = self.table[bucket[first], slot].copy()
                self.table[bucket[first], slot] = mark[first]
                mark[first] = out
                bucket[first] = self._other(bucket[first], out)
        self.table = before
        return h

    def remove(self, h: np.ndarray) -> None:
        """Removes one entry for each hash; each must have been inserted."""
        bucket, mark = self._places(h)
        for turn in (0, 1):
            while len(bucket):
                found = self.table[bucket] == mark[:, None]
                has = found.any(axis=1)
                if not has.any():
                    break
                slot = found.argmax(axis=1)
                at = bucket * SLOTS + slot
                _, first = np.unique(np.where(has, at, -1 - np.arange(len(at))), return_index=True)
                gone = np.zeros(len(at), bool)
                gone[first] = True
                gone &= has
                self.table[bucket[gone], slot[gone]] = 0
                bucket, mark = bucket[~gone], mark[~gone]
            if turn == 0:
                bucket = self._other(bucket, mark)
