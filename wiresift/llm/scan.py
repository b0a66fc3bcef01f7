"""Words, lines and rolling fingerprints of a whole Arrow batch of texts at once, in numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D. All functions take the joined UTF-8 bytes of a batch and the offsets of its texts, so no
Python object is made per word. Fingerprints are 64 bits: a polynomial over random byte values modulo 2**64, then mixed. Strings of bytes of any length (words, lines) add
a polynomial modulo the prime 2**31 - 1: modulo a power of two alone, some long strings of two letters are equal whatever the byte values.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, CHAIN = 0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        have = np.ones(size, U)
        done = 1
        while done < size:
            have[done:2 * done] = have[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[base] = have
    return have[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[t] * base**t over i <= t < j."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(p: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed fingerprints of the value ranges [start, end), the same wherever they stand."""
    back = powers(_inverse(base), len(p))
    return mix((p[end] - p[start]) * back[start] + (end - start).astype(U))


PRIME, OTHER = U((1 << 31) - 1), 1_103_515_245
_SMALL = _BYTES >> U(33)
_RESIDUES: dict[int, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """The residue modulo `PRIME` of numbers below 2**62, as a number of at most 2**31."""
    x = (x & PRIME) + (x >> U(31))
    return (x & PRIME) + (x >> U(31))


def residues(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo `PRIME`, kept between calls."""
    have = _RESIDUES.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        have = np.ones(size, U)
        done = 1
        while done < size:
            have[done:2 * done] = _folded(have[:done] * U(pow(base, done, int(PRIME))))
            done *= 2
        _RESIDUES[base] = have
    return have[:n]


def byte_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the strings data[start:end]: both polynomials, mixed."""
    one = spans(prefix(_BYTES[data], BASE), BASE, start, end)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_folded(_SMALL[data] * residues(OTHER, len(data))), out=sums[1:])
    back = residues(pow(OTHER, -1, int(PRIME)), len(data) + 1)
    two = _folded(_folded(sums[end] - sums[start]) * back[start])
    two = np.where(two >= PRIME, two - PRIME, two)
    return mix(one ^ mix(two + U(1)))


def rolling(values: np.ndarray, width: int, base: int = CHAIN) -> np.ndarray:
    """Fingerprint of every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    p = prefix(values, base)
    return mix((p[width:] - p[:-width]) * powers(_inverse(base), n))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return whole, offsets - offsets[0]


def text_batches(column: pa.Array, limit: int = 1 << 20):
    """Row ranges of a column whose texts come to about `limit` bytes each (a longer text stands alone), with their bytes and offsets."""
    whole, offsets = joined(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, whole[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): positions ordered by `keys`, the first key leading, and where in that order each group of equal keys begins."""
    order = np.lexsort(keys[::-1])
    head = np.ones(len(order), bool)
    head[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(head)


def listed(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """A list column of the groups of `values` that begin at `heads`."""
    return pa.ListArray.from_arrays(pa.array(np.r_[heads, len(values)].astype(np.int32)), pa.array(values))


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[start:end], as a large_string array."""
    sizes = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    taken = data[np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])


class Words:
    """Start and end byte of each word, and `at`: text i holds words at[i]..at[i + 1]. `inside` tells the bytes of words where they are other than the usual ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        inside = ~((data == 32) | ((data - np.uint8(9)) <= 4)) if inside is None else inside
        self.inside = inside
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        cuts = offsets[(offsets < len(data))]
        before[cuts] = False
        ends = offsets[offsets > 0]
        after[ends - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.at = np.searchsorted(self.start, offsets)

    def prints(self) -> np.ndarray:
        """A fingerprint of each word."""
        return byte_prints(self.data, self.start, self.end)

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def within(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the n - width + 1 windows lie inside one text, given the texts' bounds."""
    ok = np.zeros(max(0, n - width + 1), bool)
    lengths = np.diff(at)
    long = np.flatnonzero(lengths >= width)
    mark = np.zeros(len(ok) + 1, np.int32)
    np.add.at(mark, at[long], 1)
    np.add.at(mark, at[long] + lengths[long] - width + 1, -1)
    return np.cumsum(mark[:-1]) > 0 if len(ok) else ok


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:len(best) - step], best[step:]
        take = right < left
        best, where = np.where(take, right, left), np.where(take, where[step:], where[:len(where) - step])
        have += step
    return where
