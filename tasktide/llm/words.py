"""Vectorised work on the bytes of Arrow string columns, shared by the text operators.

A batch of texts is one run of UTF-8 bytes with row offsets, so cutting it into words and hashing every word, word
window or byte n-gram takes a few numpy passes and no Python step per character.  Word classes are tables over byte
values; all bytes of a non-ASCII character are 0x80 or above, so "everything outside ASCII" is a byte class too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 256_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: [^\x20\x09-\x0D]: all but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Hashes are polynomials modulo this prime, whose bases, one for each lane, are random numbers below it.
_PRIME = 2**61 - 1
_BASES = np.random.Generator(np.random.PCG64(20240229)).integers(2**60, _PRIME, 2).tolist()
_P, _29, _32 = np.uint64(_PRIME), np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A run of more bytes is hashed by BLAKE2.
_LONG = 1 << 20
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h = h * _M2
    h ^= h >> np.uint64(31)
    return h


def _reduced(r: np.ndarray) -> np.ndarray:
    """r modulo the prime."""
    r = (r & _P) + (r >> np.uint64(61))
    return np.where(r >= _P, r - _P, r)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2 ** 32 + low modulo the prime, of which 2 ** 61 is one more."""
    return _reduced((high >> np.uint64(29)) + ((high & _29) << np.uint64(32)) + (low & _P) + (low >> np.uint64(61)))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _32, b >> np.uint64(32), b & _32
    low = a0 * b0
    low = (low & _P) + (low >> np.uint64(61)) + (a1 * b1 << np.uint64(3))  # 2 ** 64 is 8
    return _joined(a1 * b0 + a0 * b1, low)


def _power(n: int, inverse: bool, lane: int = 0) -> np.ndarray:
    """base ** i (or its inverse) modulo the prime for i < n."""
    key, base = (lane, inverse), pow(_BASES[lane], -1, _PRIME) if inverse else _BASES[lane]
    if key not in _powers or len(_powers[key]) < n:
        a, m = np.ones(max(n, SLICE_BYTES + 64), dtype=np.uint64), 1
        while m < len(a):
            k = min(m, len(a) - m)
            a[m : m + k] = _times(a[:k], np.uint64(pow(base, m, _PRIME)))
            m += k
        if n > 2 * SLICE_BYTES:
            return a[:n]
        _powers[key] = a
    return _powers[key][:n]


class Sums:
    """Hashes of runs, from the upper and lower parts of the terms that they add up."""

    def __init__(self, high: np.ndarray, low: np.ndarray, lane: int = 0):
        self.parts = []
        for terms in (high, low):
            total = np.zeros(len(terms) + 1, dtype=np.uint64)
            np.cumsum(terms, out=total[1:])
            self.parts.append(total)
        self.inverse = _power(len(high) + 1, True, lane)

    @classmethod
    def of(cls, values: np.ndarray) -> Sums:
        """Of 64-bit values."""
        terms = _times(_reduced(values), _power(len(values), False))
        return cls(terms >> np.uint64(32), terms & _32)

    @classmethod
    def of_bytes(cls, data: np.ndarray, lane: int = 0) -> Sums:
        """Of bytes; for runs of at most 2 ** 20."""
        power, values = _power(len(data), False, lane), data.astype(np.uint64)
        return cls(values * (power >> np.uint64(32)), values * (power & _32), lane)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = _times(_joined(*(total[ends] - total[starts] for total in self.parts)), self.inverse[starts])
        return mix(h + (ends - starts).astype(np.uint64) * _M1)


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end] of 64-bit values, the same wherever the run stands."""
    return Sums.of(values)(starts, ends)


def byte_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run data[start:end] of bytes, the same wherever the run stands."""
    h = Sums.of_bytes(data)(starts, ends)
    for i in np.flatnonzero(ends - starts > _LONG):  # their sums of terms pass 64 bits
        h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


@dataclass
class Words:
    """Words of some rows. Row i has the words first[i]:first[i + 1]."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words that lie in one row, and the number of the first word of each."""
        n = np.diff(self.first)
        starts = np.arange(len(self.hash))
        left = np.repeat(self.first[1:], n) - starts
        starts = starts[left >= k]
        return runs(self.hash, starts, starts + k), starts


@dataclass
class Texts:
    """Rows of text: row i is data[offsets[i]:offsets[i + 1]]; a null row is empty here and False in valid."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def lower(self) -> Texts:
        """With A-Z in lower case."""
        return Texts(LOWER[self.data], self.offsets, self.valid)

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the longest runs of bytes that the table holds."""
        n = len(self.data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = table[self.data]
        starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        starts[cut] = inside[1:-1][cut]
        ends[cut - 1] = inside[1:-1][cut - 1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def words(self, table: np.ndarray) -> Words:
        """The runs of spans() and their hashes."""
        s, e = self.spans(table)
        return self.hashed(self.data, s, e)

    def hashed(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> Words:
        return Words(byte_runs(data, s, e) if len(s) else np.zeros(0, np.uint64), np.searchsorted(s, self.offsets), s, e)

    def terms(self, table: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and of the first bytes, of each of the given numbers, of all longer words; their rows."""
        words = self.words(table)
        row = np.repeat(np.arange(len(self.valid)), np.diff(words.first))
        found, rows = [words.hash], [row]
        if len(words.hash):
            for k in prefixes:
                longer = words.end - words.start > k
                found.append(mix(byte_runs(self.data, words.start[longer], words.start[longer] + k) + np.uint64(k)))
                rows.append(row[longer])
        return np.concatenate(found), np.concatenate(rows)


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) over an Arrow string column; a slice has up to `most` bytes and `rows` rows, or one row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    at = 0
    while at < len(column):
        end = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
        yield at, end, Texts(raw[off[at] : off[end]], off[at : end + 1] - off[at], valid[at:end])
        at = end


def as_long(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return h.view(np.int64)
