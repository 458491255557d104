"""Vectorised scanning of whole texts inside a task: words, lines and their hashes, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What separates words: space and the bytes 09 to 0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes of text that are scanned at once; a longer text is scanned alone.
SLICE_BYTES = 2 << 20
#: Sums of powers modulo 2**64 can be made to collide by chosen texts of about a thousand bytes, so longer spans than this are hashed apart.
LONG_SPAN = 512

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        factors[0] = 1
        values = np.cumprod(factors, dtype=np.uint64)
        if len(values) > SLICE_BYTES + 1:
            return values  # of one very long text: not kept
        _powers[kind] = values
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Slice:
    """Some rows of a column of texts: UTF-8 bytes of all, where each begins, and the rows' numbers in the batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        d, o, n = self.data, self.offsets, len(self.data)
        space = SPACE[d]
        word = ~space
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before[o[:-1][o[:-1] < n]] = True
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after[o[1:][o[1:] > 0] - 1] = True
        self.in_word = word
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        #: Row r has the words bounds[r]:bounds[r + 1].
        self.bounds = np.searchsorted(self.starts, o)
        self._sums: dict[bool, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte spans: equal spans have equal hashes wherever they stand."""
        if lower not in self._sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[self.data] * _power("up", _BASE, len(self.data))[: len(self.data)], out=sums[1:])
            self._sums[lower] = sums
        s = self._sums[lower]
        h = (s[ends] - s[starts]) * _power("down", _INVERSE, len(self.data) + 1)[starts]
        h = mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(ends - starts > LONG_SPAN):
            raw = self.data[starts[i] : ends[i]]
            h[i] = int.from_bytes(blake2b((_LOWER[raw] if lower else raw).astype(np.uint8).tobytes(), digest_size=8).digest(), "little")
        return h

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends, lower)

    def count_by_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row the mask marks."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def row_bytes(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts (null: empty) into slices of whole rows of about limit bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words, in order; of the whole sequence if it is shorter; none of none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
        h ^= h >> np.uint64(29)
    return mix(h)
