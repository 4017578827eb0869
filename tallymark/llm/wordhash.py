"""Words of a text column and their 64-bit hashes, without a Python object per word.

A word is a run of bytes other than ASCII white space (blank, tab, LF, VT, FF,
CR).  Its hash comes from prefix sums of a polynomial over the column's bytes;
hashes of runs of words are polynomials over mixed word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_ODD = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time; sets the size of the tables of powers.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(32))
    x *= _ODD
    x ^= x >> _U(29)
    x *= _U(_BASE)
    return x ^ (x >> _U(32))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not _tables:
        _tables.extend((_powers(_BASE, CHUNK), _powers(pow(_BASE, -1, 1 << 64), CHUNK)))
    up, down = _tables
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        high = ends[to - 1]
        if high - low > CHUNK:  # a single word of more than CHUNK bytes
            out[at] = int.from_bytes(hashlib.blake2b(data[low:high].tobytes(), digest_size=8).digest(), "little")
        else:
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(_BYTES[data[low:high]] * up[: high - low], out=sums[1:])
            out[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * down[starts[at:to] - low]
        at = to
    return mix(out + (ends - starts).astype(_U) * _ODD)


@dataclass
class Words:
    """Words of consecutive rows: ``row`` of each word, ``first`` word of each row (one more than rows), ``hash``."""

    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningful where ``fits(k)``."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, _U)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= _U(_BASE)
            out += self.hash[j : j + n]
        return mix(out)

    def fits(self, k: int) -> np.ndarray:
        """True where k words of one row begin."""
        n = len(self.row) - k + 1
        return self.row[:n] == self.row[k - 1 :] if n > 0 else np.empty(0, bool)


def slices(column: pa.Array, most: int = CHUNK * 2) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each (a longer text is alone)."""
    lengths = np.asarray(pc.binary_length(column.fill_null("")), np.int64)
    at = 0
    total = np.cumsum(lengths)
    while at < len(lengths):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield at, to
        at = to


def words_of(column: pa.Array) -> Words:
    """Words of every text; a null text has none."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return Words(np.empty(0, np.int64), np.zeros(n + 1, np.int64), np.empty(0, _U))
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    begins[offsets[filled]] = inside[offsets[filled]]
    ends[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, offsets)
    return Words(np.repeat(np.arange(n), np.diff(first)), first, _word_hashes(data, starts, ends))
