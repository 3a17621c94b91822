"""Words of whole texts as numpy arrays: byte spans and 64-bit hashes, many texts at a time.

A text is cut into words at separator bytes; hashes are polynomials over the bytes,
taken from running sums, so that the cost is a few vector operations a byte. Texts
are handled in pieces of about a megabyte; a longer text is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def separators(ranges: str) -> np.ndarray:
    """256 flags from hexadecimal byte ranges such as ``20-20 09-0D``."""
    table = np.zeros(256, bool)
    for pair in ranges.split():
        low, high = (int(x, 16) for x in pair.split("-"))
        table[low:high + 1] = True
    return table


#: Words are runs of what is not blank: [^\x20\x09-\x0D]+
BLANKS = separators("20-20 09-0D")
#: Words are letters, digits and all beyond ASCII, after A-Z were lower-cased.
MARKS = separators("00-2F 3A-40 5B-60 7B-7F")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
BYTE_VALUES = _BYTES
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


def fold_values(fold: bool) -> np.ndarray:
    """Value of each byte in a hash. ``fold``: A-Z count as a-z."""
    return _FOLDED if fold else _BYTES


class _Powers:
    """Powers of the base and of its inverse, grown when a longer piece comes."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, PIECE_BYTES + 1)
            self.up, self.down = (running_powers(b, self.size)
                                  for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def running_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0], done = 1, 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * _U(pow(base, done, 1 << 64))
        done += step
    return out


POWERS = _Powers()


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


@dataclass
class Words:
    """Words of rows ``low`` to ``high`` of a batch. Row r has words first[r-low] to first[r-low+1]."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """For each word its row, counted from ``low``."""
        return np.repeat(np.arange(self.high - self.low), self.counts)


def _spans(data, starts, ends, apart):
    """Word spans in data[starts[0]:ends[-1]]; no word goes over the end of a row."""
    base = starts[0]
    inside = ~apart[data[base:ends[-1]]]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    full = ends > starts
    before[starts[full] - base] = False
    after[ends[full] - base - 1] = False
    return np.flatnonzero(inside & ~before) + base, np.flatnonzero(inside & ~after) + base + 1


def _hashes(data, start, end, table):
    if not len(start):
        return np.empty(0, _U)
    low, high = start[0], end[-1]
    up, down = POWERS.upto(high - low + 1)
    sums = np.empty(high - low + 1, _U)
    sums[0] = 0
    np.cumsum(table[data[low:high]] * up[:-1], out=sums[1:])
    return mix((sums[end - low] - sums[start - low]) * down[start - low])


def _long(data, low, high, apart, table):
    """Words of one long row, a piece at a time; pieces end between words."""
    parts = []
    while low < high:
        cut = min(low + PIECE_BYTES, high)
        while cut < high and not apart[data[cut]]:
            gaps = np.flatnonzero(apart[data[cut:cut + PIECE_BYTES]])
            cut = cut + int(gaps[0]) if len(gaps) else min(cut + PIECE_BYTES, high)
        start, end = _spans(data, np.array([low]), np.array([cut]), apart)
        parts.append((start, end, _hashes(data, start, end, table)))
        low = cut
    return tuple(np.concatenate(x) for x in zip(*parts))


def read_words(texts: pa.Array, apart: np.ndarray, fold: bool) -> Iterator[Words]:
    """Words of all rows. ``fold``: hash A-Z as a-z."""
    data, offsets = text_buffers(texts)
    table = _FOLDED if fold else _BYTES
    n, low = len(texts), 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + PIECE_BYTES, side="right")) - 1
        high = min(max(high, low + 1), n)
        own = offsets[low:high + 1]
        if own[-1] - own[0] > PIECE_BYTES:
            start, end, hashes = _long(data, int(own[0]), int(own[-1]), apart, table)
        elif own[-1] > own[0]:
            start, end = _spans(data, own[:-1], own[1:], apart)
            hashes = _hashes(data, start, end, table)
        else:
            start = end = np.empty(0, np.int64)
            hashes = np.empty(0, _U)
        first = np.searchsorted(start, own)
        yield Words(low, high, data, own, first, start, end, hashes)
        low = high


def sequence_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``n`` words, by the place of its first word (rows are not looked at)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, _U)
    out = np.zeros(count, _U)
    factor = (_BASE * (2 * seed + 1)) & _MASK
    for k in range(n):
        out *= _U(factor)
        out += hashes[k:k + count]
    return mix(out + _U((seed * 0x9E3779B97F4A7C15) & _MASK))


def whole_windows(words: Words, n: int) -> np.ndarray:
    """Starts of all runs of ``n`` words that stay in one row."""
    counts = np.maximum(words.counts - n + 1, 0)
    return runs(words.first[:-1], counts)


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one after another."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    begins = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - begins, length)
