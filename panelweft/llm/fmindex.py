"""A compressed FM-index over integer tokens: Burrows-Wheeler transform in a wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with constant-time rank: packed words and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class WaveletMatrix:
    """A sequence of integers below 2**levels with rank of any value."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.rows, self.zeros = levels, [], []
        v = values
        for level in range(levels - 1, -1, -1):
            bits = (v >> level) & 1 == 1
            self.rows.append(BitVector(bits))
            self.zeros.append(len(v) - self.rows[-1].ones)
            v = np.concatenate([v[~bits], v[bits]])

    def rank(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of value[k] before lo[k] and before hi[k]: as places in the last level, and where the value begins there."""
        first = np.zeros_like(lo)
        for level, row, zeros in zip(range(self.levels - 1, -1, -1), self.rows, self.zeros, strict=True):
            one = (value >> level) & 1 == 1
            a, b, c = row.rank(lo), row.rank(hi), row.rank(first)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
            first = np.where(one, zeros + c, first - c)
        return lo - first, hi - first, first


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first depth symbols (at least), by prefix doubling; equal ones by place."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and n > 1:
        after = np.full(n, 0, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        rank, k = new, 2 * k
        if rank.max() == n - 1:
            break
    return order


class FMIndex:
    """Backward search over a text of hashed tokens, for patterns of up to depth - 1 tokens.

    Suffixes are sorted by their first `depth` symbols only, which such patterns can't tell
    from a full sort.
    """

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, depth: int) -> None:
        """tokens: uint64 hashes; ends: where each piece of the text ends, ascending; no pattern crosses an end."""
        self.alphabet, codes = np.unique(tokens, return_inverse=True)
        pieces = np.searchsorted(ends, np.arange(len(tokens)), side="right")
        text = np.zeros(len(tokens) + len(ends), np.int64)
        self.place = np.arange(len(tokens)) + pieces  # of each token in the text
        text[self.place] = codes + 1
        self.size = len(text)
        order = suffix_order(text, depth)
        bwt = text[order - 1]
        self.order = order.astype(np.int32)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.wavelet = WaveletMatrix(bwt, max(1, int(len(self.alphabet)).bit_length()))

    def matches(self, tokens: np.ndarray, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a streamed document's matches that end before the given places: their length, up to cap tokens, and suffix interval."""
        n = len(ends)
        code = np.searchsorted(self.alphabet, tokens)
        code[code == len(self.alphabet)] = 0
        code = np.where(self.alphabet[code] == tokens, code + 1, -1) if len(self.alphabet) else np.full(len(tokens), -1)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        reach, live = np.zeros(n, np.int64), np.arange(n)
        for back in range(1, cap + 1):
            live = live[ends[live] >= back]
            c = code[ends[live] - back]
            live, c = live[c > 0], c[c > 0]
            if not len(live):
                break
            a, b, _ = self.wavelet.rank(c, lo[live], hi[live])
            a, b = self.counts[c] + a, self.counts[c] + b
            some = b > a
            live = live[some]
            lo[live], hi[live], reach[live] = a[some], b[some], back
        return reach, lo, hi

    def statistics(self, tokens: np.ndarray, cap: int) -> np.ndarray:
        """Matching statistics of a streamed document, capped: the longest match that begins at each token, up to cap tokens."""
        reach, _, _ = self.matches(tokens, np.arange(1, len(tokens) + 1), cap)
        out = np.zeros(len(tokens), np.int64)
        for length in range(1, cap + 1):
            good = np.flatnonzero(reach >= length)
            out[good + 1 - length] = np.maximum(out[good + 1 - length], length)
        return out

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in the text of each (non-empty) interval's suffixes; intervals are equal or disjoint."""
        starts, back = np.unique(lo, return_inverse=True)
        stops = np.empty(len(starts), np.int64)
        stops[back] = hi
        edges = np.stack([starts, stops], axis=1).ravel()
        padded = np.append(self.order, np.iinfo(np.int32).max)
        return np.minimum.reduceat(padded, edges)[::2][back]
