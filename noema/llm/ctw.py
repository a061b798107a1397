"""Context-tree weighting over binary-decomposed bytes.

Every byte is eight binary decisions, each with a context tree over the bytes
before it. A node (a context of some depth and the bits of the byte so far)
holds how often either bit came there; its Krichevsky-Trofimov estimate is
weighed against the product of its children by one half each. A trained tree
predicts with the posterior weights, from the deepest known context up.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

#: The byte that stands before and after every text; it is in no UTF-8 text.
EDGE = 255
_HALF = math.log(0.5)
_SMALL = np.array([math.lgamma(k + 0.5) for k in range(4096)]), np.array([math.lgamma(k + 1.0) for k in range(8192)])


def _log_gamma(table: np.ndarray, n: np.ndarray, plus: float) -> np.ndarray:
    """ln gamma(n + plus), from a table or by Stirling's series."""
    x = np.maximum(n + plus, 50.0)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1)], (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a bit sequence."""
    return _log_gamma(_SMALL[0], zeros, 0.5) + _log_gamma(_SMALL[0], ones, 0.5) - _log_gamma(_SMALL[1], zeros + ones, 1.0) - math.log(math.pi)


def gram_keys(texts: list[bytes], depth: int) -> np.ndarray:
    """A key for every byte of the texts and for the edge that ends each: the byte before it in the highest place, then the one before that and so on to ``depth``, the byte itself in the lowest."""
    data = np.frombuffer(b"".join(bytes((EDGE,)) * depth + t for t in texts) + bytes((EDGE,)) * depth, np.uint8).astype(np.uint64)
    n = len(data) - depth
    key = data[depth:].copy()
    for k in range(1, depth + 1):
        key |= data[depth - k : depth - k + n] << np.uint64(8 * (depth + 1 - k))
    # of the edges between two texts only the first is one
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + depth
    keep = np.ones(n, bool)
    ends = np.cumsum(size) - depth
    for k in range(1, depth):
        keep[ends + k] = False
    return key[keep]


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted different keys."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Level(NamedTuple):
    """Nodes of one depth and one number of known bits: sorted ``key`` (context, then the known bits), counts, ln of the weighted probability."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray
    stay: np.ndarray

    def bit(self, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The node's own estimate of a bit."""
        return (np.where(bits, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)


def _levels(keys: np.ndarray, counts: np.ndarray, below: list[tuple[np.ndarray, np.ndarray]] | None) -> list[Level]:
    """The eight levels of the contexts of one depth. ``keys``: context and byte, sorted; ``below``: node keys of each level and their children's summed ln weighted probability."""
    out: list[Level] = []
    key, n = keys, counts
    for known in range(7, -1, -1):
        bit = (key & np.uint64(1)).astype(bool)
        up = key >> np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1]))) if len(up) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        ones = np.add.reduceat(np.where(bit, n, 0), first) if len(first) else np.zeros(0, np.int64)
        key, n = up[first], total
        own = log_kt(total - ones, ones)
        weighted = own
        if below is not None:
            child, value = below[known]
            sums = np.bincount(np.searchsorted(key, child), value, len(key)) if len(key) else np.zeros(0)
            weighted = np.logaddexp(_HALF + own, _HALF + sums)
        stay = np.exp(_HALF + own - weighted) if below is not None else np.ones(len(own))
        out.append(Level(key, total - ones, ones, weighted, np.minimum(stay, 1.0)))
    return out[::-1]


def _parents(levels: list[Level]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What the contexts that are one byte shorter get from their children: keys of the shorter contexts' nodes, repeated, and values."""
    out = []
    for known, level in enumerate(levels):
        low = level.key & np.uint64((1 << known) - 1)
        out.append((level.key >> np.uint64(known + 8) << np.uint64(known) | low, level.log_weighted))
    return out


def shorter(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (context, byte) and counts, with contexts one byte shorter."""
    cut = keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)
    new, at = np.unique(cut, return_inverse=True)
    return new, np.bincount(at, counts, len(new)).astype(np.int64)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys)
    ordered = all_keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(all_counts[order], first) if len(first) else np.zeros(0, np.int64)


class Tree:
    """Levels of each depth from ``top`` to ``depth``; ``keys`` are grams of that depth."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 0, below: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.depth, self.top = depth, top
        self.levels: dict[int, list[Level]] = {}
        for d in range(depth, top - 1, -1):
            self.levels[d] = _levels(keys, counts, below)
            below = _parents(self.levels[d])
            self.entries = keys, counts
            if d > top:
                keys, counts = shorter(keys, counts)
        #: What contexts shorter than ``top`` get.
        self.upward = below

    def log_probability(self, grams: np.ndarray, above: Tree | None = None, depth: int | None = None) -> np.ndarray:
        """ln of the probability of each gram's byte; ``above`` is the tree of the shorter contexts."""
        depth = depth or self.depth
        out = np.zeros(len(grams))
        for known in range(8):
            bits = (grams >> np.uint64(7 - known) & np.uint64(1)).astype(bool)
            prefix = (grams & np.uint64(255)) >> np.uint64(8 - known)
            p = np.full(len(grams), 0.5)
            seen = np.zeros(len(grams), bool)
            for d in range(depth, -1, -1):
                tree = self if d >= self.top else above
                level = tree.levels[d][known]
                if not len(level.key):
                    continue
                key = (grams >> np.uint64(8 * (depth - d + 1))) << np.uint64(known) | prefix
                at = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
                there = level.key[at] == key
                own = level.bit(at, bits)
                stay = level.stay[at]
                p = np.where(there, np.where(seen, stay * own + (1 - stay) * p, own), p)
                seen |= there
            out += np.log(p)
        return out
