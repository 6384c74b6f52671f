"""A minimal perfect hash over a set of 64-bit keys, for whole arrays of keys at a time.

Level by level each key that is alone at its place in a bit array of twice the number of keys left
claims that place; the others go on to the next level.  A key's number is the count of set bits
before its own, read from a directory of counts per 64 bits, so a look-up costs a constant number
of steps.  Keys outside the set get some number too: what is stored beside it (a fingerprint of
the key) tells them apart.
"""

from __future__ import annotations

import numpy as np

SPARE = 2
_MULTIPLY = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function with another result for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _MULTIPLY[0]
        x = (x ^ (x >> np.uint64(27))) * _MULTIPLY[1]
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 977) >> np.uint64(32)).astype("<u4")


class MinimalPerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes.astype("<i8")
        self.bits = bits.astype("<u8")
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """`keys` must be distinct."""
        left, sizes, set_bits, level, start = keys.astype(np.uint64), [], [], 0, 0
        while len(left):
            size = -(-len(left) * SPARE // 64) * 64
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            set_bits.append(start + at[alone])
            sizes.append(size)
            left, level, start = left[~alone], level + 1, start + size
        words = np.zeros(start // 64, dtype=np.uint64)
        for some in set_bits:
            np.bitwise_or.at(words, some // 64, np.uint64(1) << (some % 64).astype(np.uint64))
        return cls(np.array(sizes, dtype=np.int64), words)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, 0 to n - 1; -1 for keys that certainly are not in the set."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.first[level]
            word, bit = at // 64, (at % 64).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out
