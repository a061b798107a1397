"""A compressed FM-index in numpy: Burrows-Wheeler transform of small numbers in a wavelet matrix of packed bits, with backward search for many patterns at a time."""

from __future__ import annotations

import numpy as np

#: Symbols to which suffixes are sorted; no pattern may be longer.
DEPTH = 64
#: Bits of a symbol.
BITS = 12
#: Symbols of a pattern that the sorted suffixes answer at once.
HEAD = 4


class Bits:
    """Bit vector with rank: words of 64 bits, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64))).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def heads_of(text: np.ndarray) -> np.ndarray:
    """The HEAD symbols from each place on as one number."""
    key = np.zeros(len(text) + HEAD, np.uint64)
    key[: len(text)] = text
    have = 1
    while have < HEAD:
        key[:-have] = key[:-have] << np.uint64(BITS * have) | key[have:]
        have *= 2
    return key[: len(text)]


def suffix_order(heads: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their first DEPTH symbols."""
    n, have = len(heads), HEAD
    order = np.argsort(heads)
    ordered = heads[order]
    new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
    while have < DEPTH and not new[1:].all():
        rank = np.zeros(n + have, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
        key = rank[:n] * np.uint64(n + 2) + rank[have:]
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        have *= 2
    return order


class FmIndex:
    """Of a text of symbols below 2**BITS that ends with 0; patterns hold no 0, which stands between stretches."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        heads = heads_of(text)
        order = suffix_order(heads)
        column = text[order - 1]
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        symbols = np.arange(1 << BITS)
        base = np.zeros(len(symbols), np.int64)
        for bit in range(BITS - 1, -1, -1):
            ones = (column >> bit & 1).astype(np.uint8)
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(ones) - ones.sum()))
            up = self.levels[-1].ones(base)
            base = np.where(symbols >> bit & 1, self.zeros[-1] + up, base - up)
            column = np.concatenate([column[ones == 0], column[ones == 1]])
        #: What is added to a symbol's place in the last level to give the row of the suffix that it begins.
        self.shift = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << BITS))[:-1])) - base
        self.heads = heads[order]

    def begin(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with HEAD symbols each."""
        return np.searchsorted(self.heads, heads), np.searchsorted(self.heads, heads, "right")

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with a symbol followed by what rows ``low`` to ``high`` begin with: one step of backward search."""
        both = np.concatenate([low, high])
        twice = np.concatenate([symbol, symbol])
        for bit, level, zeros in zip(range(BITS - 1, -1, -1), self.levels, self.zeros, strict=True):
            up = level.ones(both)
            both = np.where(twice >> bit & 1, zeros + up, both - up)
        both = both + self.shift[twice]
        return both[: len(low)], both[len(low) :]

    def count(self, pattern: np.ndarray) -> int:
        """Occurrences of one pattern of at most DEPTH symbols."""
        low, high = np.array([0]), np.array([self.size])
        for symbol in pattern[::-1]:
            low, high = self.extend(np.array([symbol]), low, high)
        return int(high[0] - low[0])


def repeated_windows(index: FmIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Marks the places of ``text`` at which a window starts that occurs at least twice; only the stretches from ``begin`` to ``end`` are searched.

    Matching statistics from right to left: each stretch extends a match as
    long as it occurs twice. All windows inside a match are repeated; the
    search then goes on with the first window that the match does not cover.
    """
    if not HEAD <= window < DEPTH - 2:
        raise ValueError(f"windows of {window} symbols don't fit an index of depth {DEPTH}")
    marks = np.zeros(len(text) + 1, np.int32)
    stop = end.copy()  # right end of the match of each stretch
    live = np.flatnonzero(stop - begin >= window)
    place = np.zeros(len(begin), np.int64)
    low, high = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)

    heads = heads_of(text)

    def restart(who: np.ndarray) -> None:
        at = stop[who] - HEAD
        place[who] = at
        low[who], high[who] = index.begin(heads[at])

    restart(live)
    while len(live):
        more = live[(place[live] > begin[live]) & (high[live] - low[live] > 1) & (stop[live] - place[live] < DEPTH - 2)]
        new_low, new_high = index.extend(text[place[more] - 1].astype(np.int64), low[more], high[more])
        good = new_high - new_low > 1
        went = more[good]
        place[went] -= 1
        low[went], high[went] = new_low[good], new_high[good]
        moved = np.zeros(len(begin), bool)
        moved[went] = True
        halted = live[~moved[live]]
        if len(halted):
            alone = high[halted] - low[halted] < 2  # even the head occurs once only
            length = np.where(alone, 0, stop[halted] - place[halted])
            long = halted[length >= window]
            np.add.at(marks, place[long], 1)
            np.add.at(marks, stop[long] - window + 1, -1)
            at_begin = (place[halted] == begin[halted]) & ~alone
            stop[halted] = np.where(length >= window, place[halted] + window - 1, stop[halted] - 1)
            done = (at_begin & (length >= window)) | (stop[halted] - begin[halted] < window)
            restart(halted[~done])
            moved[halted[~done]] = True
            live = live[moved[live]]
    return np.cumsum(marks[:-1]) > 0
