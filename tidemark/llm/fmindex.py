"""FM-index over integer symbols: suffix order, wavelet matrix ranks, sampled positions. All queries are vectorised."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling. Separators (0) count as distinct, in order of place,
    and below every symbol, so the rounds are bounded by the longest stretch between separators."""
    n = len(symbols)
    gaps = symbols == SEPARATOR
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + int(gaps.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class BitVector:
    """64-bit words with a running count before each of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        current = symbols.astype(np.int64)
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (current >> shift) & 1
            vector = BitVector(bits.astype(np.uint8))
            zeros = len(bits) - int(bits.sum())
            self.levels.append((shift, vector, zeros))
            current = np.concatenate((current[bits == 0], current[bits == 1]))
        self.first = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, vector, zeros in self.levels:
            ones = vector.rank1(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each place."""
        return self._descend(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for shift, vector, zeros in self.levels:
            bit = vector.get(at).astype(np.int64)
            ones = vector.rank1(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            symbol |= bit << shift
        return symbol


class FMIndex:
    """symbols: 0 separates stretches and must end the text; others are 1..top."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.n, self.top = len(symbols), top
        self.tree = WaveletMatrix(last, top)
        counts = np.bincount(symbols, minlength=top + 2)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        marked = (order % sample == 0) | (last == SEPARATOR)  # a walk never crosses a separator
        self.marks = BitVector(marked.astype(np.uint8))
        self.positions = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases: one a line, all of one length, symbols in 1..top."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
            gone = low[live] >= high[live]
            high[live[gone]] = low[live[gone]]
            live = live[~gone]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one, adding the steps."""
        row, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.marks.get(row[open_]) == 1
            open_ = open_[~done]
            symbol = self.tree.access(row[open_])
            row[open_] = self.below[symbol] + self.tree.rank(symbol, row[open_])
            steps[open_] += 1
        return self.positions[self.marks.rank1(row)] + steps
