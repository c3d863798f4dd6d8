"""A minimal perfect hash over 128-bit keys, held in numpy arrays.

Level by level, each key that alone hits a bit of the level's bitmap keeps it;
the others go on to the next level. A key's slot is the rank of its bit. Slots
carry a 32-bit fingerprint and a count. A key that the hash was built of always
finds its own slot; another one is recognised by its fingerprint, except for one in
four billion. Counts are kept up to ``MOST``, larger ones as ``MOST``.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it.
LOAD = 2.0
MOST = 2**32 - 1
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def mixed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the key, another one for each level."""
    with np.errstate(over="ignore"):
        x = hi ^ (lo * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def fingerprint(lo: np.ndarray) -> np.ndarray:
    return (lo >> np.uint64(32)).astype(np.uint32)


def build(hi: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[list[int], bytes, bytes, bytes]:
    """Level sizes, packed bitmaps, fingerprints and counts of distinct keys."""
    left = np.arange(len(hi))
    sizes, maps, order = [], [], []
    while len(left):
        size = max(64, int(len(left) * LOAD))
        at = mixed(hi[left], lo[left], len(sizes)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size)[at.astype(np.int64)] == 1
        bits = np.zeros(size, bool)
        bits[at[alone].astype(np.int64)] = True
        placed = left[alone]
        order.append(placed[np.argsort(at[alone])])
        sizes.append(size)
        maps.append(bits)
        left = left[~alone]
    order = np.concatenate(order) if order else left
    bits = np.packbits(np.concatenate(maps)) if maps else np.zeros(0, np.uint8)
    return sizes, bits.tobytes(), fingerprint(lo[order]).tobytes(), np.minimum(count[order], MOST).astype(np.uint32).tobytes()


class Shard:
    """One shard's arrays, ready to be probed."""

    def __init__(self, sizes, bits: bytes, fingerprints: bytes, counts: bytes):
        self.sizes = list(sizes)
        self.bits = np.frombuffer(bits, np.uint8)
        ones = np.cumsum(ONES[self.bits], dtype=np.uint32)
        self.before = np.concatenate([np.zeros(1, np.uint32), ones])  # ones before each byte
        self.fingerprints = np.frombuffer(fingerprints, np.uint32)
        self.counts = np.frombuffer(counts, np.uint32)

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The stored count of each key, 0 for keys that the shard lacks."""
        out = np.zeros(len(hi), np.int64)
        left, start = np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = start + (mixed(hi[left], lo[left], level) % np.uint64(size)).astype(np.int64)
            upto = self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)
            hit = (upto & 1).astype(bool)
            slot, keys = self.before[at[hit] >> 3].astype(np.int64) + ONES[upto[hit]] - 1, left[hit]
            same = self.fingerprints[slot] == fingerprint(lo[keys])
            out[keys[same]] = self.counts[slot[same]]
            left, start = left[~hit], start + size
            if not len(left):
                break
        return out
