"""Elias-Fano sequences and a two-level n-gram trie, on NumPy views of one buffer."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit of each word."""
    pos = np.zeros(len(word), dtype=np.uint64)
    k = k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        mask = np.uint64((1 << width) - 1)
        count = np.bitwise_count((word >> pos) & mask).astype(np.int64)
        go = k >= count
        k -= np.where(go, count, 0)
        pos += np.where(go, np.uint64(width), np.uint64(0))
    return pos.astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, counts per word.

    Buffer: n, low width, words of lows, words of highs (64-bit each), then the
    lows, the highs and the number of ones before each word of highs.
    """

    def __init__(self, buffer, offset: int = 0):
        n, low, n_low, n_high = np.frombuffer(buffer, "<u8", 4, offset).tolist()
        self.n, self.low_bits = n, low
        offset += 32
        self.lows = np.frombuffer(buffer, "<u8", n_low, offset)
        offset += 8 * n_low
        self.highs = np.frombuffer(buffer, "<u8", n_high, offset)
        offset += 8 * n_high
        self.ones = np.frombuffer(buffer, "<u8", n_high, offset)
        self.end = offset + 8 * n_high
        self.zeros = 64 * np.arange(n_high, dtype=np.int64) - self.ones.astype(np.int64)

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        lows = np.zeros(n * low // 64 + 2, dtype=np.uint64)
        if low:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            part = v & ((ONE << np.uint64(low)) - ONE)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift + np.uint64(low) > 64
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        bit = (v >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        highs = np.zeros((int(bit[-1]) if n else 0) // 64 + 2, dtype=np.uint64)
        np.bitwise_or.at(highs, (bit >> np.uint64(6)).astype(np.int64), ONE << (bit & np.uint64(63)))
        count = np.bitwise_count(highs).astype(np.uint64)
        head = np.array([n, low, len(lows), len(highs)], dtype="<u8")
        return b"".join(x.astype("<u8").tobytes() for x in (head, lows, highs, np.cumsum(count) - count))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.lows[word] >> shift
        spill = shift > 0
        value = np.where(spill, value | (self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))), value)
        return value & ((ONE << np.uint64(self.low_bits)) - ONE)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.ones, i.astype(np.uint64), side="right") - 1
        pos = 64 * word + _select_in_word(self.highs[word], i - self.ones[word].astype(np.int64))
        return ((pos - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _after_zeros(self, k: np.ndarray) -> np.ndarray:
        """Number of ones before the k-th zero (0-based); all of them beyond the last zero."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        pos = 64 * word + _select_in_word(~self.highs[word], k - self.zeros[word])
        return np.minimum(pos - k, self.n)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value >= x (n if there is none)."""
        x = np.asarray(x, dtype=np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        last = 64 * len(self.highs) - self.n - 1  # zeros that are stored
        beyond = high > last
        high = np.minimum(high, last)
        at = np.where(high > 0, self._after_zeros(np.maximum(high - 1, 0)), 0)
        end = self._after_zeros(high)
        want = x & ((ONE << np.uint64(self.low_bits)) - ONE)
        todo = np.flatnonzero(at < end)
        while len(todo):
            small = self._low(at[todo]) < want[todo]
            todo = todo[small]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return np.where(beyond, self.n, at)


class BigramTrie:
    """Contexts, pointers to their children, children, and a code per child.

    A child is stored relative to its context (rank * span + word), which keeps
    the whole level monotone; a query finds the context's rank, then searches the
    successor within the context's own range.
    """

    def __init__(self, buffer):
        self.span, n = np.frombuffer(buffer, "<u8", 2, 0).tolist()
        self.contexts = EliasFano(buffer, 16)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.children = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, "<u2", n, self.children.end)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> bytes:
        """From rows sorted by (context, word), without repeats."""
        ids, first = np.unique(context, return_index=True)
        span = int(word.max()) + 1 if len(word) else 1
        rank = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(context))))
        child = rank.astype(np.uint64) * np.uint64(span) + word.astype(np.uint64)
        return (np.array([span, len(codes)], dtype="<u8").tobytes() + EliasFano.build(ids)
                + EliasFano.build(np.append(first, len(context))) + EliasFano.build(child)
                + codes.astype("<u2").tobytes())

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the bigrams, 0 where absent."""
        out = np.zeros(len(context), dtype=np.uint16)
        if self.contexts.n == 0 or len(context) == 0:
            return out
        ids, back = np.unique(context, return_inverse=True)
        rank = self.contexts.successor(ids)
        known = rank < self.contexts.n
        known[known] = self.contexts.get(rank[known]) == ids[known]
        rank = np.where(known, rank, 0)
        lo, hi = self.pointers.get(rank), self.pointers.get(rank + 1)
        hit = np.flatnonzero(known[back] & (word < self.span))
        want = rank[back[hit]].astype(np.uint64) * np.uint64(self.span) + word[hit].astype(np.uint64)
        at = self.children.successor(want)
        inside = (at >= lo[back[hit]].astype(np.int64)) & (at < hi[back[hit]].astype(np.int64))
        hit, at, want = hit[inside], at[inside], want[inside]
        same = self.children.get(at) == want
        out[hit[same]] = self.codes[at[same]]
        return out
