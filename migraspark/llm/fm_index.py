"""A compressed index of word sequences: a sorted transform in a wavelet matrix, searched backwards."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols below 2**bits as bit vectors of one level each, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])))
            self.zeros.append(int(len(ones) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def placed(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the first ``ends`` places leave off in the last level's block of each symbol."""
        at = ends
        for k in range(self.bits):
            ones = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            below = self.words[k][word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.counts[k][word] + np.bitwise_count(below)
            at = np.where(ones, self.zeros[k] + rank, at - rank)
        return at


class WindowIndex:
    """Which windows of a fixed number of words occur in some texts, and their lowest owner.

    The transform is sorted by the first 64 words or more, so intervals of patterns of up to
    ``window`` + 1 words are those of a full suffix array. Equal windows are neighbours there: a mark
    where a new window begins and the lowest owner per window replace the suffix array.
    """

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, window: int):
        self.window = window
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.alphabet = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
        text = np.zeros(int(lengths.sum()), np.int64)  # 0 parts the texts
        inner = np.ones(len(text), bool)
        inner[np.cumsum(lengths) - 1] = False
        if texts:
            text[inner] = np.searchsorted(self.alphabet, np.concatenate(texts)) + 1
        n = self.n = len(text)
        ranks, rank, length = {1: text}, text, 1
        while length <= window:
            key = rank * (n + 2)
            key[: max(n - length, 0)] += rank[length:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            length *= 2
            ranks[length] = rank
        order = np.argsort(rank, kind="stable")
        same = np.ones(max(n - 1, 0), bool)
        begin, left = 0, window
        for length in sorted(ranks, reverse=True):
            while left >= length:
                part = np.full(n, -1, np.int64)
                part[: max(n - begin, 0)] = ranks[length][begin:]
                sorted_part = part[order]
                same &= sorted_part[1:] == sorted_part[:-1]
                begin, left = begin + length, left - length
        starts = np.flatnonzero(np.concatenate(([True], ~same))) if n else np.zeros(0, np.int64)
        self.starts = np.append(starts, n)
        self.lowest = np.minimum.reduceat(np.repeat(owners, lengths)[order], starts) if n else owners[:0]
        symbols = len(self.alphabet) + 1
        self.matrix = WaveletMatrix(text[order - 1], max(symbols.bit_length(), 1))
        smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]))
        every = np.arange(symbols)
        self.shift = smaller - self.matrix.placed(every, np.zeros(symbols, np.int64))

    def matches(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, lowest owner) of every window of ``texts`` that occurs in the index.

        All texts are read from their ends in step. The match of each goes on by a word to the left
        and is cut to a window on the right; where it can't go on it starts again at the last word
        that a further window may end with.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lengths = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)))
        words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        symbol = np.searchsorted(self.alphabet, words)
        symbol = np.minimum(symbol, max(len(self.alphabet) - 1, 0))
        known = self.alphabet[symbol] == words if len(self.alphabet) else np.zeros(len(words), bool)
        symbol = np.where(known, symbol + 1, 0)
        stream = np.flatnonzero(lengths >= self.window)
        at = lengths[stream] - 1
        low, high = np.zeros(len(stream), np.int64), np.full(len(stream), self.n)
        depth = np.zeros(len(stream), np.int64)
        while len(stream):
            place = first[stream] + at
            s = symbol[place]
            ends = self.matrix.placed(np.concatenate([s, s]), np.concatenate([low, high]))
            new_low, new_high = ends[: len(s)] + self.shift[s], ends[len(s) :] + self.shift[s]
            goes = known[place] & (new_high > new_low)
            reached, depth = depth, np.where(goes, depth + 1, 0)
            full = depth >= self.window
            if full.any():
                kind = np.searchsorted(self.starts, new_low[full], side="right") - 1
                new_low[full], new_high[full] = self.starts[kind], self.starts[kind + 1]
                found.append((stream[full], at[full], self.lowest[kind]))
            low, high = np.where(goes, new_low, 0), np.where(goes, new_high, self.n)
            at = np.where(goes, at - 1, at + reached - 1)
            depth = np.where(goes, np.minimum(depth, self.window), 0)
            left = (at >= 0) & (at + depth >= self.window - 1)
            stream, at, low, high, depth = stream[left], at[left], low[left], high[left], depth[left]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))
