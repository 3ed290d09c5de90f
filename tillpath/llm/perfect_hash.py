"""A minimal perfect hash of 64-bit keys, in blocks that Spark tasks build and that are looked up with numpy.

Keys are dealt to blocks by a mixed hash. In a block, a key that is alone at its place of the first bit
array sets that bit; those that share a place go on to the next, smaller array, until none is left. The
index of a key is the rank of its bit, so n keys have the indices 0 to n-1 (about 3 bits a key). Any other
key gets some index too or none, so the keys are kept in the order of their indices and compared.
"""

from __future__ import annotations

import numpy as np

_ROOM = 1.5  # bits of an array for each key that reaches it
_MOST_LEVELS = 100


def mixed(keys: np.ndarray) -> np.ndarray:
    """64 well spread bits of every key (the finaliser of a split-mix generator), as unsigned."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(hashes: np.ndarray, level: int, size) -> np.ndarray:
    step = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    return (mixed(hashes + step) % size).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Words of the bit arrays one after the other, bits of each array, and the keys by index."""
    keys = np.sort(keys.astype(np.int64))
    left, words, sizes, ordered = keys, [], [], []
    for level in range(_MOST_LEVELS):
        if not len(left):
            break
        size = 64 * int(np.ceil(_ROOM * len(left) / 64))
        at = _place(mixed(left), level, np.uint64(size))
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        set_here = alone[at]
        ordered.append(left[set_here][np.argsort(at[set_here])])
        left = left[~set_here]
    if len(left):
        raise ValueError("keys are repeated")
    none = np.zeros(0, np.int64)
    return (
        np.concatenate(words) if words else none.astype("<u8"), sizes, np.concatenate(ordered) if ordered else none,
    )


class PerfectHash:
    """The hash of some consecutive blocks out of `n_blocks`: `blocks` are tuples (words, sizes, keys) as `build` gives them."""

    def __init__(self, n_blocks: int, first: int, blocks: list[tuple[np.ndarray, list[int], np.ndarray]]) -> None:
        self.n_blocks, self.first = n_blocks, first
        self.words = np.concatenate([b[0] for b in blocks])
        self.keys = np.concatenate([b[2] for b in blocks])
        levels = max(len(b[1]) for b in blocks)
        self.sizes = np.zeros((levels, len(blocks)), np.uint64)
        self.starts = np.zeros((levels, len(blocks)), np.int64)
        at = 0
        for j, (_, sizes, _) in enumerate(blocks):
            for level, size in enumerate(sizes):
                self.sizes[level, j], self.starts[level, j] = size, at
                at += size
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones  # bits set before each word; blocks are in the order of `keys`
        self.offsets = np.cumsum([0, *[len(b[2]) for b in blocks]])

    def block_of(self, keys: np.ndarray) -> np.ndarray:
        return block_of(keys, self.n_blocks)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key among `self.keys`, -1 for one that is not there."""
        hashes, block = mixed(keys), self.block_of(keys) - self.first
        out = np.full(len(keys), -1, np.int64)
        open_rows = np.flatnonzero((block >= 0) & (block < self.sizes.shape[1]))
        for level in range(self.sizes.shape[0]):
            own = block[open_rows]
            size = self.sizes[level, own]
            open_rows, own, size = open_rows[size > 0], own[size > 0], size[size > 0]
            if not len(open_rows):
                break
            bit = self.starts[level, own] + _place(hashes[open_rows], level, size)
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            held = (self.words[word] >> low) & np.uint64(1) == 1
            rank = self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))
            out[open_rows[held]] = rank[held]
            open_rows = open_rows[~held]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out


def block_of(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((mixed(keys) >> np.uint64(20)) % np.uint64(n_blocks)).astype(np.int64)
