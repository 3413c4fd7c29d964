"""Elias-Fano sequences and a trie of word pairs over them, in one flat
buffer that is read in place.

A monotone sequence of n values below u keeps the low log2(u / n) bits of each
value as they are and the high parts in unary, about 2 + log2(u / n) bits a
value. ``successor`` goes to the bucket of the high part and searches
the low parts there.

The trie's second level holds ``rank of the context * symbols + word``, which
rises over the whole level; looking a word up below a context is one successor
search. The pointers from roots to their children are another monotone sequence.
"""

from __future__ import annotations

import numpy as np

STEP = 20        # codes of a probability: a twentieth of its log10


class EliasFano:
    """Reads a sequence at ``at`` of a buffer; ``end`` is the next free byte."""

    def __init__(self, buffer: bytes, at: int = 0):
        self.n, self.width, buckets = (int(x) for x in np.frombuffer(buffer, np.int64, 3, at))
        at += 24
        low, high = (self.n * self.width + 127) // 64, (self.n + buckets + 63) // 64
        self.low = np.frombuffer(buffer, np.uint64, low, at)
        bits = np.frombuffer(buffer, np.uint8, high * 8, at + 8 * low)
        self.end = at + 8 * (low + high)
        # directory: where each bucket of equal high parts starts
        zeros = np.flatnonzero(np.unpackbits(bits, bitorder="little")[:self.n + buckets] == 0)
        self.start = np.concatenate([[0], zeros - np.arange(buckets)])

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = values >> width
        buckets = (universe >> width) + 1
        unary = np.zeros((n + buckets + 63) // 64 * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        # a zero ends each bucket, so the rest of the last word is not read
        words = np.zeros((n * width + 127) // 64, np.uint64)
        if width and n:
            part = (values & ((1 << width) - 1)).astype(np.uint64)
            bits = np.zeros((len(words) * 64,), np.uint8)
            for i in range(width):
                bits[i:n * width:width] = (part >> np.uint64(i)) & np.uint64(1)
            words = np.packbits(bits, bitorder="little").view(np.uint64)
        return np.array([n, width, buckets], np.int64).tobytes() + words.tobytes() + np.packbits(unary, bitorder="little").tobytes()

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        got = self.low[word] >> shift
        over = (np.uint64(64) - shift) & np.uint64(63)
        got |= np.where(shift > 0, self.low[word + 1] << over, np.uint64(0))
        return (got & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.start, i, side="right") - 1
        return high << self.width | self.lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Places of the first values not below ``x`` (n where there is none)."""
        high, low = x >> self.width, x & ((1 << self.width) - 1)
        inside = high < len(self.start) - 1
        high = np.where(inside, high, 0)
        lo = np.where(inside, self.start[high], self.n)
        hi = np.where(inside, self.start[high + 1], self.n)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of ``x``, -1 where it is not there. Values are distinct."""
        at = self.successor(x)
        there = at < self.n
        there[there] = self.get(at[there]) == x[there]
        return np.where(there, at, -1)


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of probabilities; 0 stands for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 254), 0).astype(np.uint8)


def probability(code: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEP)])
    return table[code]


class Trie:
    """Roots with their counts, and the words that follow them with a code of
    their share of the root."""

    def __init__(self, buffer: bytes):
        self.symbols = int(np.frombuffer(buffer, np.int64, 1)[0])
        self.roots = EliasFano(buffer, 8)
        self.to_pairs = EliasFano(buffer, self.roots.end)
        self.pairs = EliasFano(buffer, self.to_pairs.end)
        at = self.pairs.end
        self.counts = np.frombuffer(buffer, np.int64, self.roots.n, at)
        self.share = np.frombuffer(buffer, np.uint8, self.pairs.n, at + 8 * self.roots.n)

    @staticmethod
    def pack(symbols: int, root: np.ndarray, second: np.ndarray, n: np.ndarray, whole, mu: float) -> bytes:
        """From distinct pairs in order with their counts. ``whole(roots,
        counts)`` gives the roots' counts over all shards."""
        top = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])) if len(n) else np.zeros(0, np.int64)
        roots = root[top]
        rank = np.repeat(np.arange(len(top)), np.diff(np.append(top, len(n))))
        counts = whole(roots, np.add.reduceat(n, top) if len(top) else n)
        keys = [EliasFano.pack(roots, max(symbols, 1)), EliasFano.pack(np.append(top, len(n)), len(n) + 1),
                EliasFano.pack(rank * symbols + second, max(len(top) * symbols, 1))]
        return (np.array([symbols], np.int64).tobytes() + b"".join(keys) + counts.astype(np.int64).tobytes()
                + quantised(n / (counts[rank] + mu)).tobytes())

    def below(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Ranks of words below contexts (ranks of roots, -1 for none)."""
        out = np.full(len(context), -1)
        known = np.flatnonzero(context >= 0)
        if len(known):
            c = context[known]
            at = self.pairs.find(c * self.symbols + word[known])
            # siblings lie between the context's pointers
            there = (at >= self.to_pairs.get(c)) & (at < self.to_pairs.get(c + 1))
            out[known[there]] = at[there]
        return out
