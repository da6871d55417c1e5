"""A compressed set of byte offsets with rank and select, in the manner of Roaring.

Offsets are grouped by their high bits into containers of 65,536 values. A
container is a sorted array (few members), a bitmap (many), or a list of runs
(long stretches), whichever is smallest. The cumulative cardinalities of the
containers find the one that holds the k-th member; a select inside it gives the
offset. All queries are vectors.
"""

from __future__ import annotations

import numpy as np

BITS = 16
SPAN = 1 << BITS
WORDS = SPAN // 64


class _Array:
    kind = "array"

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def nbytes(self):
        return self.low.nbytes

    def select(self, k):
        return self.low[k].astype(np.int64)

    def rank(self, x):
        return np.searchsorted(self.low, x, side="left")


class _Runs:
    kind = "run"

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first, self.length = first.astype(np.uint16), (length - 1).astype(np.uint16)
        self.before = np.concatenate(([0], np.cumsum(length)))

    def nbytes(self):
        return self.first.nbytes + self.length.nbytes

    def select(self, k):
        run = np.searchsorted(self.before, k, side="right") - 1
        return self.first[run].astype(np.int64) + k - self.before[run]

    def rank(self, x):
        run = np.searchsorted(self.first, x, side="right") - 1
        inside = np.minimum(x - self.first[run].astype(np.int64), self.length[run].astype(np.int64) + 1)
        return np.where(run < 0, 0, self.before[run] + inside)


class _Bitmap:
    kind = "bitmap"

    def __init__(self, mask: np.ndarray):
        full = np.zeros(SPAN, dtype=bool)
        full[:len(mask)] = mask
        self.words = np.packbits(full, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def nbytes(self):
        return self.words.nbytes

    def select(self, k):
        word = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(len(word), 8), axis=1, bitorder="little")
        nth = np.cumsum(bits, axis=1, dtype=np.int64) == (k - self.before[word] + 1)[:, None]
        return word.astype(np.int64) * 64 + nth.argmax(axis=1)

    def rank(self, x):
        word, bit = x >> 6, (x & 63).astype(np.uint64)
        below = self.words[np.minimum(word, WORDS - 1)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.where(word < WORDS, np.bitwise_count(below), 0)


def _container(mask: np.ndarray):
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    card = int(np.count_nonzero(mask))
    runs = (len(edge) + 1 + int(mask[0])) // 2 if card else 0
    if 4 * runs <= min(2 * card, 8 * WORDS):
        at = np.concatenate((np.zeros(int(mask[0]), dtype=np.int64), edge,
                             np.full(int(mask[-1]), len(mask), dtype=np.int64)))
        return card, _Runs(at[::2], at[1::2] - at[::2])
    if 2 * card <= 8 * WORDS:
        return card, _Array(np.flatnonzero(mask))
    return card, _Bitmap(mask)


class BoundarySet:
    """Members are the offsets at which ``mask`` is set."""

    def __init__(self, mask: np.ndarray):
        self.keys, self.containers, cards = [], [], []
        for key in range(-(-len(mask) // SPAN)):
            card, c = _container(mask[key << BITS:(key + 1) << BITS])
            if card:
                self.keys.append(key)
                self.containers.append(c)
                cards.append(card)
        self.keys = np.array(self.keys, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(cards, dtype=np.int64)))

    def __len__(self):
        return int(self.before[-1])

    def nbytes(self):
        return sum(c.nbytes() for c in self.containers) + self.keys.nbytes + self.before.nbytes

    def select(self, k) -> np.ndarray:
        """Offsets of the members numbered ``k`` (from 0)."""
        k = np.asarray(k, dtype=np.int64)
        at = np.searchsorted(self.before, k, side="right") - 1
        out = np.empty(len(k), dtype=np.int64)
        for c in np.unique(at):
            here = at == c
            out[here] = (self.keys[c] << BITS) + self.containers[c].select(k[here] - self.before[c])
        return out

    def rank(self, x) -> np.ndarray:
        """How many members lie below each ``x``."""
        x = np.asarray(x, dtype=np.int64)
        at = np.searchsorted(self.keys, x >> BITS, side="left")
        out = self.before[at].copy()
        inside = at < len(self.keys)
        inside[inside] = self.keys[at[inside]] == x[inside] >> BITS
        for c in np.unique(at[inside]):
            here = inside & (at == c)
            out[here] += self.containers[c].rank(x[here] - (self.keys[c] << BITS))
        return out
