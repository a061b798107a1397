"""Words and n-grams of a run of texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time.
CHUNK = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit number for every byte.
_BYTE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """``data``: bytes of all texts, ``starts`` and ``ends``: of each word in them, ``first``: the first word of each text and, at the end, the number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_table(separators: bytes | None = None, letters: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words."""
    table = np.full(256, separators is not None, bool)
    table[np.frombuffer(separators if separators is not None else letters, np.uint8)] = separators is None
    return table


def words(texts: list[bytes], inside: np.ndarray, lower: bool = False) -> Words:
    """Words of UTF-8 texts: the longest runs of bytes that ``inside`` marks; a line feed is never one. ``lower`` turns A-Z to a-z."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    flags = np.zeros(len(data) + 1, np.int8)
    flags[1:] = inside[data]
    edges = np.diff(flags)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=at[1:])
    return Words(data, starts, ends, np.searchsorted(starts, at))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries; those that cross texts are the caller's to leave out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])


def smallest(h: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every ``span`` consecutive entries."""
    have = 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (span - have)], h[span - have :]) if span > have else h


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``size`` bytes; a longer text stands alone."""
    begin = held = 0
    for k, text in enumerate(texts):
        if k > begin and held + len(text) > size:
            yield begin, k
            begin, held = k, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)
