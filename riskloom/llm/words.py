"""Words of whole Arrow batches as byte ranges and 64-bit hashes, computed in numpy without a loop over words.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D; these are single bytes in UTF-8, so words
are found on bytes. Hashes of short ranges are polynomials over random byte values, finished by a bijective mixer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
#: Longest range hashed as a polynomial, which modulo 2**64 is safe for short ranges only, and places computed at a time.
LONG, _SEGMENT = 256, 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    """Powers of the base modulo 2**64 for the places of a segment."""
    steps = np.full(_SEGMENT + LONG + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of values[start:end], or of table[values[start:end]], for ranges of at most LONG places with ascending starts.

    Equal contents hash equally wherever they stand.
    """
    out = np.empty(len(starts), np.uint64)
    firsts = np.searchsorted(starts, np.arange(0, len(values) + _SEGMENT + 1, _SEGMENT))
    for k in range(len(firsts) - 1):
        part = slice(firsts[k], firsts[k + 1])
        if part.start == part.stop:
            continue
        base = k * _SEGMENT
        here = values[base : base + _SEGMENT + LONG]
        here = here if table is None else table[here]
        sums = np.zeros(len(here) + 1, np.uint64)
        np.cumsum(here * _UP[: len(here)], out=sums[1:])
        a, b = starts[part] - base, ends[part] - base
        out[part] = mix((sums[b] - sums[a]) * _DOWN[a] + (b - a).astype(np.uint64))
    return out


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each range, starts ascending; A-Z count as a-z with `lower`.

    Ranges longer than LONG are hashed by BLAKE2b: no two texts made for the purpose share a polynomial's value there.
    """
    out = np.empty(len(starts), np.uint64)
    short = ends - starts <= LONG
    out[short] = range_hashes(data, starts[short], ends[short], _LOWER_VALUES if lower else _BYTE_VALUES)
    for i in np.flatnonzero(~short).tolist():
        content = data[starts[i] : ends[i]]
        content = _LOWER[content].astype(np.uint8) if lower else content
        out[i] = int.from_bytes(hashlib.blake2b(content.tobytes(), digest_size=8).digest(), "little")
    return out


class Words(NamedTuple):
    """first row of the chunk; bytes; byte offset of each text; word ranges in bytes; word offset of each text."""

    row: int
    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.texts) - 1

    def hashes(self, lower: bool) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, lower)

    def owners(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """The texts of a batch in runs of about `most` bytes (a longer text is a run of its own); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        at = bounds[row : last + 1] - bounds[row]
        yield split_words(row, data[bounds[row] : bounds[last]], at)
        row = last


def split_words(row: int, data: np.ndarray, at: np.ndarray) -> Words:
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return Words(row, data, at, starts, ends, np.searchsorted(starts, at))


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `length` consecutive words inside one text, and the first word of each."""
    first = np.arange(max(0, len(hashes) - length + 1))
    room = np.repeat(offsets[1:], np.diff(offsets))
    first = first[first + length <= room[: len(first)]]
    return range_hashes(hashes, first, first + length), first
