"""Hashes of words and word windows over whole Arrow batches, without a Python loop per word.

A window's hash is a function of its words alone, so equal windows have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BYTE, _GRAM = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Text bytes that are hashed at a time; a longer text is taken alone.
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _TABLES[base] = have = (out[0], out[1])
    return have


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    power, inverse = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


class Words(NamedTuple):
    """The words of a slice of texts. row: the slice's row of each word; bytes[start:end] is the word."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray  # of the texts in data
    first: np.ndarray  # of each text, the index of its first word; one more at the end


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: the texts' UTF-8 bytes one after the other; offsets: n + 1 boundaries."""
    n = len(data)
    space = np.ones(n + 1, bool)
    space[:n] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n + 1, bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | edge))
    end = np.flatnonzero(~before & (space | edge))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, row, start, end, offsets, first)


def word_hashes(words: Words, which: int = 0) -> np.ndarray:
    return _range_hash(words.data.astype(np.uint64) + np.uint64(1), words.start, words.end, _BYTE[which])


def window_hashes(words: Words, hashes: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the `size` words from each word on, and whether they lie in one text. Hashes of other
    starts mean nothing."""
    n = len(hashes)
    begin = np.arange(n)
    inside = begin + size <= words.first[words.row + 1] if n else np.zeros(0, bool)
    out = _range_hash(hashes, begin, np.minimum(begin + size, n), _GRAM[which])
    return out, inside


def range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the words from start to end, by another base than a window's."""
    return _range_hash(hashes, start, end, _GRAM[1])


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column in runs of about `budget` bytes: (first row, row after, bytes, offsets). A null
    has no bytes."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + budget, "right")) - 1)
        high = min(high, len(texts))
        own = offsets[low : high + 1]
        yield low, high, data[own[0] : own[-1]], own - own[0]
        low = high
