"""Cuckoo filters over 64-bit hashes: membership with deletion, worked on in numpy arrays.

A filter has buckets of four 16-bit fingerprints. A fingerprint lives in one of
two buckets, each computable from the other and the fingerprint, so it can be
moved or removed without the key. What finds no place after many moves goes to
an exact stash, so no inserted key is ever reported absent.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

SLOTS = 4
ROUNDS = 500


class CuckooFilter:
    def __init__(self, slots: np.ndarray, stash: np.ndarray):
        self.slots, self.stash = slots, stash

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for ``keys`` at 80 % load."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, np.uint64))

    @classmethod
    def loaded(cls, slots: bytes, stash: bytes) -> CuckooFilter:
        return cls(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.uint64).copy())

    def stored(self) -> tuple[bytes, bytes]:
        return self.slots.tobytes(), self.stash.tobytes()

    def __len__(self) -> int:
        return int((self.slots != 0).sum()) + len(self.stash)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(np.asarray(hashes).astype(np.uint64))
        mark = (np.uint64(1) + (h >> np.uint64(40)) % np.uint64(65535)).astype(np.uint16)
        bucket = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, bucket, self._other(bucket, mark)

    def _stash_key(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        lower = np.minimum(bucket, self._other(bucket, mark)).astype(np.uint64)
        return (lower << np.uint64(16)) | mark.astype(np.uint64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        found = (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)
        return found | np.isin(self._stash_key(mark, one), self.stash)

    def insert(self, hashes: np.ndarray) -> None:
        """Add keys, each once; the caller inserts a key only while it is absent."""
        mark, bucket, _ = self._places(hashes)
        for turn in range(ROUNDS):
            if not len(mark):
                return
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            taken = self.slots[bucket] != 0
            fits = rank < (SLOTS - taken.sum(1))
            free = np.argsort(taken, axis=1, kind="stable")  # free slots first
            self.slots[bucket[fits], free[fits, rank[fits]]] = mark[fits]
            mark, bucket, rank = mark[~fits], bucket[~fits], rank[~fits]
            if turn % 2 and len(mark):  # both buckets were full: move one occupant of each bucket out
                first = np.r_[True, bucket[1:] != bucket[:-1]]
                slot = (turn // 2 + mark[first].astype(np.int64)) % SLOTS
                out = self.slots[bucket[first], slot]
                self.slots[bucket[first], slot] = mark[first]
                mark = mark.copy()
                mark[first] = out
            bucket = self._other(bucket, mark)
        self.stash = np.concatenate([self.stash, self._stash_key(mark, bucket)])

    def delete(self, hashes: np.ndarray) -> None:
        """Remove one fingerprint for each key; every key must have been inserted."""
        mark, one, two = self._places(hashes)
        pair = self._stash_key(mark, one)
        while len(pair):
            _, turn = np.unique(pair, return_index=True)  # keys with equal places go one after another
            rest = turn
            for bucket in (one, two):
                hit = self.slots[bucket[rest]] == mark[rest][:, None]
                some = hit.any(1)
                self.slots[bucket[rest[some]], hit[some].argmax(1)] = 0
                rest = rest[~some]
            for key in pair[rest]:
                at = np.flatnonzero(self.stash == key)[:1]
                self.stash = np.delete(self.stash, at)
            keep = np.ones(len(pair), bool)
            keep[turn] = False
            mark, one, two, pair = mark[keep], one[keep], two[keep], pair[keep]
