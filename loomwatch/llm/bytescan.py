"""Vectorised word hashing over the UTF-8 bytes of an Arrow string column.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased first. All of these are single ASCII bytes, so UTF-8 text needs no
decoding. A word's 64-bit hash is a polynomial in its bytes, taken from prefix
sums so that a whole batch is hashed without a Python loop over words, and then
mixed. Two different words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_TILE = 1 << 18
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


_POW = _powers(_BASE, 2 * _TILE)
_INV = _powers(pow(_BASE, -1, 1 << 64), 2 * _TILE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def chain(*columns: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes, position by position."""
    out = columns[0]
    with np.errstate(over="ignore"):
        for c in columns[1:]:
            out = mix(out * _U(0xD6E8FEB86659FD93) + c)
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system, since Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, one row at least."""
    i = batch.schema.get_field_index(name)
    _, offsets = buffers(batch.column(i))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Words:
    """The words of a string column.

    ``hash`` (uint64), ``start``/``end`` (byte positions in ``data``) have one
    entry per word; the words of row ``i`` are ``first[i]:first[i + 1]``.
    """

    gap = SPACE

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffers(column)
        low = self.lowered()
        word = self.inside(low)
        cut = np.zeros(len(low) + 1, dtype=bool)
        cut[self.offsets] = True
        if len(low):
            begins = word.copy()
            begins[1:] &= ~word[:-1] | cut[1:-1]
            ends = word.copy()
            ends[:-1] &= ~word[1:] | cut[1:-1]
            self.bounds(low, begins, ends)
            self.start = np.flatnonzero(begins)
            self.end = np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes(low)

    def lowered(self) -> np.ndarray:
        return LOWER[self.data]

    def inside(self, low: np.ndarray) -> np.ndarray:
        return ~self.gap[low]

    def bounds(self, low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """For subclasses that cut words further."""

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        k, n = 0, len(out)
        with np.errstate(over="ignore"):
            while k < n:
                a = int(self.start[k])
                j = int(np.searchsorted(self.end, a + 2 * _TILE - 1, side="right"))
                j = min(j, max(int(np.searchsorted(self.start, a + _TILE)), k + 1))
                if j <= k:  # one word longer than the tables of powers
                    word = low[a : int(self.end[k])].tobytes()
                    out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                    k += 1
                    continue
                b = int(self.end[j - 1])
                sums = np.empty(b - a + 1, np.uint64)
                sums[0] = 0
                np.cumsum(_BYTE[low[a:b]] * _POW[: b - a], out=sums[1:])
                s = self.start[k:j] - a
                out[k:j] = mix((sums[self.end[k:j] - a] - sums[s]) * _INV[s] + (self.end[k:j] - a - s).astype(np.uint64))
                k = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class PlainWords(Words):
    """Runs of ASCII letters and digits and of other letters above 0x7F, without case.

    The case of Latin-1 letters is folded as well: their UTF-8 form is 0xC3 and
    a byte that differs by 0x20. Typographic quotes, dashes and blanks (U+2000 to
    U+206F, U+3000 to U+303F, and U+0080 to U+00BF but its three letters) are
    gaps, and each character from U+3040 to U+9FFF is a word of its own.
    """

    gap = np.ones(256, dtype=bool)
    gap[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

    def lowered(self) -> np.ndarray:
        low = LOWER[self.data]
        if len(low) > 1:
            upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
            low[1:][upper] += 0x20
        return low

    def inside(self, low: np.ndarray) -> np.ndarray:
        word = super().inside(low)
        signs = np.flatnonzero(low[:-1] == 0xC2)
        signs = signs[~np.isin(low[signs + 1], [0xAA, 0xB5, 0xBA])]
        word[signs] = word[signs + 1] = False
        for lead, blocks in ((0xE2, [0x80, 0x81]), (0xE3, [0x80])):
            at = np.flatnonzero(low[:-2] == lead)
            at = at[np.isin(low[at + 1], blocks)]
            word[at] = word[at + 1] = word[at + 2] = False
        return word

    def bounds(self, low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        lead = np.flatnonzero((low[:-2] >= 0xE3) & (low[:-2] <= 0xE9))
        if len(lead):
            word = self.inside(low)
            lead = lead[word[lead]]
            begins[lead] = ends[lead + 2] = True
            before, after = lead[lead > 0] - 1, lead[lead + 3 < len(low)] + 3
            ends[before[word[before]]] = True
            begins[after[word[after]]] = True
