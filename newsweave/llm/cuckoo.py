"""A cuckoo filter: approximate membership with insertion and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
# Share of the slots that a filter is built for.
LOAD = 0.8
ROUNDS = 500


def tags(keys: np.ndarray) -> np.ndarray:
    """16-bit tags, never 0, from the upper bits of unsigned 64-bit keys."""
    found = (keys >> np.uint64(48)).astype(np.uint16)
    found[found == 0] = 1
    return found


def _other(buckets: np.ndarray, tag: np.ndarray, count: int) -> np.ndarray:
    """The second bucket; from it, the same step leads back."""
    spread = (tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return buckets ^ (spread & np.uint64(count - 1)).astype(np.int64)


class CuckooFilter:
    """``table`` has a power of two of rows with four tags each; 0 is free."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        rows = 1
        while rows * SLOTS * LOAD < keys:
            rows *= 2
        return cls(np.zeros((rows, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds ``keys``, as large as that takes."""
        made = cls.sized(len(keys))
        while not made.insert(keys):
            made = cls(np.zeros((len(made.table) * 2, SLOTS), np.uint16))
        return made

    def _buckets(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, first = tags(keys), self._buckets(keys)
        second = _other(first, tag, len(self.table))
        return ((self.table[first] == tag[:, None]) | (self.table[second] == tag[:, None])).any(axis=1)

    def _place(self, tag: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put tags into free slots of their buckets; which of them found room."""
        order = np.argsort(bucket, kind="stable")
        sorted_buckets = bucket[order]
        fresh = np.concatenate(([True], sorted_buckets[1:] != sorted_buckets[:-1]))
        starts = np.flatnonzero(fresh)
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        rows = self.table[sorted_buckets]
        room = (rows == 0).sum(axis=1)
        fits = rank < room
        free = np.argsort(rows != 0, axis=1, kind="stable")
        chosen = free[fits, rank[fits]]
        self.table[sorted_buckets[fits], chosen] = tag[order[fits]]
        done = np.zeros(len(order), bool)
        done[order[fits]] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all ``keys`` found room. After False the filter must be rebuilt."""
        tag, bucket = tags(keys), self._buckets(keys)
        for turn in range(ROUNDS):
            for _ in range(2):
                if not len(tag):
                    return True
                left = ~self._place(tag, bucket)
                tag, bucket = tag[left], _other(bucket[left], tag[left], len(self.table))
            if not len(tag):
                return True
            # One tag per full bucket takes the place of another, which moves on.
            _, one = np.unique(bucket, return_index=True)
            slot = turn % SLOTS
            out = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = tag[one]
            free = out == 0
            tag[one], bucket[one] = out, _other(bucket[one], out, len(self.table))
            keep = np.ones(len(tag), bool)
            keep[one[free]] = False
            tag, bucket = tag[keep], bucket[keep]
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted, one tag for each."""
        tag, first = tags(keys), self._buckets(keys)
        second = _other(first, tag, len(self.table))
        for t, a, b in zip(tag, first.tolist(), second.tolist()):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == t)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(cls.view(data).table.copy())

    @classmethod
    def view(cls, data: bytes) -> CuckooFilter:
        """The filter of ``data`` without a copy; it can only be asked."""
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS))
