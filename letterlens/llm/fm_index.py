"""FM-index over a shard of token ids: Burrows-Wheeler transform in a wavelet matrix, with sampled suffix positions."""

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in lexical order, by prefix doubling. Each 0 counts as a symbol of its own that is
    smaller than the rest, so comparisons end at the next 0."""
    n = len(symbols)
    breaks = symbols == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, symbols.astype(np.int64) + int(breaks.sum()))
    width = 1
    while True:
        follow = np.full(n, -1, np.int64)
        follow[: n - width] = rank[width:]
        key = rank * (int(rank.max()) + 2) + follow + 1
        order = np.argsort(key, kind="stable")
        changed = np.r_[False, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changed)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Rank and access over a sequence of symbols below 2 ** levels."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.zeros, self.below = levels, [], []
        for level in reversed(range(levels)):
            bit = (values >> level) & 1
            below = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - bit, out=below[1:])
            self.below.append(below)
            self.zeros.append(int(below[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        first, last = np.zeros_like(place), place
        for i, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            low, high = self.below[i][first], self.below[i][last]
            first = np.where(one, self.zeros[i] + first - low, low)
            last = np.where(one, self.zeros[i] + last - high, high)
        return last - first

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for i in range(self.levels):
            below = self.below[i]
            low = below[place]
            one = below[place + 1] == low
            symbol = symbol * 2 + one
            place = np.where(one, self.zeros[i] + place - low, low)
        return symbol


class FMIndex:
    """Index of symbols 1 .. highest; 0 divides stretches, and no phrase contains it."""

    def __init__(self, symbols: np.ndarray, highest: int, sample: int = 16):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=highest + 1))]
        self.matrix = WaveletMatrix(before, max(1, int(highest).bit_length()))
        # Starts of stretches are sampled too, so that no walk has to pass a 0.
        self.sampled = (order % sample == 0) | (before == 0)
        self.position = np.where(self.sampled, order, -1)

    def _step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.rank(symbol, place)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each phrase (one per row of equal length), by backward search."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for column in reversed(range(phrases.shape[1] - 1)):
            symbol = phrases[:, column]
            low, high = self._step(symbol, low), self._step(symbol, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by walking back to a sampled one."""
        found, walked, place = np.full(len(rows), -1, np.int64), 0, rows
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[place]
            found[open_[done]] = self.position[place[done]] + walked
            open_, place = open_[~done], place[~done]
            if len(open_):
                place = self._step(self.matrix.access(place), place)
            walked += 1
        return found
