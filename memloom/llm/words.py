"""Vectorised word splitting and hashing of Arrow string columns (numpy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text hashed at a time: bounds the temporaries, which take about 40 bytes for each.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: One random 64-bit value for each byte, from a fixed seed.
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public murmur3 constants); works in place on a copy."""
    x = x.copy()
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class _Powers:
    """Powers of the base and of its inverse, as long as the longest block so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                    steps = np.full(n, base, U64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


class Words(NamedTuple):
    """Words of consecutive documents: document k has the words first[k]:first[k + 1]; starts and ends are offsets in data."""

    rows: slice
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    edges: np.ndarray  # document k has the bytes edges[k]:edges[k + 1] of data
    sums: np.ndarray  # running hash sums of the bytes, for prefixes()

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of words of more than n bytes, and the hashes of their first n bytes."""
        at = np.flatnonzero(self.ends - self.starts > n)
        start = self.starts[at]
        with np.errstate(over="ignore"):
            return at, mix((self.sums[start + n] - self.sums[start]) * _powers.get(len(self.data) + 1)[1][start] + U64(n))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows in them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, *, lower: bool, alnum: bool = False, hashed: bool = True) -> Iterator[Words]:
    """Words of each text, in blocks of whole rows.

    Words are maximal runs of bytes other than space and 0x09-0x0D, or with ``alnum`` of
    ASCII letters, digits and non-ASCII bytes. ``lower`` lower-cases A-Z alone.
    """
    data, offsets = text_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        block, edges = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        if lower:
            block = _LOWER[block]
        yield _split(slice(row, end), block, edges, _ALNUM[block] if alnum else ~_SPACE[block], hashed)
        row = end


def _split(rows: slice, block: np.ndarray, edges: np.ndarray, inside: np.ndarray, hashed: bool) -> Words:
    n = len(block)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    begins, after = inside & ~before[:-1], np.zeros(n + 1, bool)
    after[:-1] = inside
    stops = after[:-1] & ~after[1:]
    at = edges[1:-1]
    at = at[(at > 0) & (at < n)]
    if len(at):  # a document's edge also ends a word
        begins[at] |= inside[at]
        stops[at - 1] |= inside[at - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, edges)
    hashes = sums = np.zeros(0, U64)
    if hashed:
        up, down = _powers.get(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U64)
            np.cumsum(_VALUES[block] * up[:n], out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return Words(rows, first, starts, ends, hashes, block, edges, sums)


_STEPS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; those that cross a document's end are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = hashes[:n] * _STEPS[0]
        for j in range(1, k):
            total += hashes[j : j + n] * _STEPS[j]
        return mix(total)


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of one word sequence of any length; differs by length."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, len(hashes) + 1, dtype=U64))
        return int(mix((hashes * (place | U64(1))).sum(dtype=U64, keepdims=True) + U64(len(hashes)) * _STEPS[63])[0])


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one document; a shorter, non-empty document is one shingle."""
    if not len(hashes):
        return np.zeros(0, U64)
    if len(hashes) < k:
        return np.array([sequence_hash(hashes)], U64)
    return np.unique(shingles(hashes, k))
