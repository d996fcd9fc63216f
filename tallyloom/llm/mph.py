"""A minimal perfect hash over 64-bit keys, built and asked for whole arrays at once.

Levels of bits: at each level the keys that remain are hashed into a bit array
of twice their number; keys that are alone in their place are settled there, the
others go on to the next level. The rank of a settled bit among all bits is the
key's slot, so n distinct keys get the slots 0..n-1. A key that was never put in
gets some slot or none, so an index keeps a fingerprint in each slot.
"""

from __future__ import annotations

import struct

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64(level + 1) * _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """bits: a boolean array for each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.cumsum([0] + [int(x.sum()) for x in levels])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64; the caller sees to that."""
        left, levels = keys, []
        while len(left):
            size = max(64, 2 * len(left))
            at = (_scrambled(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that were not put in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_scrambled(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = self.starts[level] + self.ranks[level][at[here]]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<i", len(self.levels)) + b"".join(struct.pack("<q", len(x)) + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<i", blob), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<q", blob, at)
            stop = at + 8 + (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, stop - at - 8, at + 8), count=size).astype(bool))
            at = stop
        return cls(levels)
