"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than space and \\t-\\r; A-Z are lower-cased. Its hash is a polynomial in its
bytes modulo 2**64, taken as a difference of prefix sums, then mixed; equal words have equal hashes anywhere.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur-style finaliser: each input bit moves about half of the output bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column's rows, one after another, and where each begins (with the end)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    hashes: np.ndarray  # one per word
    first: np.ndarray  # for each text, the index of its first word; one more at the end


def words(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> Words:
    """Hashes of all words. keep: 256 flags; bytes without one are left out of the words' hashes."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[raw]
    begins = solid[1:-1] & ~solid[:-2]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begins[inner] = solid[1:-1][inner]  # no word goes on from one text into the next
    starts = np.flatnonzero(begins)
    stops_here = solid[1:-1] & ~solid[2:]
    last = inner[inner > 0] - 1
    stops_here[last] = solid[1:-1][last]
    ends = np.flatnonzero(stops_here) + 1
    value = (_LOWER[raw].astype(U) + U(1)) * powers(n)
    if keep is not None:
        value *= keep[raw]
    sums = np.zeros(n + 1, U)
    np.cumsum(value, out=sums[1:])
    origin = starts
    if keep is not None and len(kept := np.flatnonzero(keep[raw])):
        origin = np.minimum(kept[np.minimum(np.searchsorted(kept, starts), len(kept) - 1)], ends)
    hashes = (sums[ends] - sums[starts]) * powers(n + 1, _INVERSE)[origin]
    if keep is not None:
        return Words(mix(hashes), np.searchsorted(starts, offsets))
    return Words(mix(hashes + (ends - starts).astype(U)), np.searchsorted(starts, offsets))


def ngram(hashes: np.ndarray, size: int) -> np.ndarray:
    """At i, the hash of the words i .. i+size-1, in order."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, U)
    for k in range(size):
        out = out * U(_BASE) + hashes[k : k + n]
    return mix(out)


class Shingles(NamedTuple):
    hashes: np.ndarray  # with repeats
    first: np.ndarray  # for each text, the index of its first shingle; one more at the end


def shingles(found: Words, size: int = 5) -> Shingles:
    """Word shingles of each text. A text of fewer words has one, of all of them; one without words has none."""
    count = np.diff(found.first)
    shown = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.zeros(len(shown) + 1, np.int64)
    np.cumsum(shown, out=first[1:])
    out = np.empty(first[-1], U)
    full = count >= size
    every = ngram(found.hashes, size)
    if full.all() and len(count):
        within = np.ones(len(every), bool)
        cross = (found.first[1:-1, None] - np.arange(1, size)).ravel()
        within[cross[cross < len(every)]] = False
        return Shingles(every[within], first)
    for i in range(len(count)):
        a, b = found.first[i], found.first[i + 1]
        if full[i]:
            out[first[i] : first[i + 1]] = every[a : b - size + 1]
        elif b > a:
            out[first[i]] = ngram(found.hashes[a:b], int(b - a))[0] + U(b - a)
    return Shingles(out, first)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct shingles; empty for a null text or one without words."""
    got = shingles(words(*buffers(column)), size)
    return [np.unique(got.hashes[a:b]) for a, b in zip(got.first[:-1], got.first[1:])]


def set_digests(found: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text two sums over its distinct shingles, together equal for equal sets alone, and their number."""
    size, a, b = (np.zeros(len(found.first) - 1, np.int64) for _ in range(3))
    for i, (x, y) in enumerate(zip(found.first[:-1], found.first[1:])):
        own = np.unique(found.hashes[x:y])
        size[i] = len(own)
        a[i] = own.sum(dtype=U).astype(np.int64)
        b[i] = mix(own).sum(dtype=U).astype(np.int64)
    return a, b, size


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd 32-bit factors and addends of `count` universal hash functions x -> a * x + b modulo 2**32."""
    x = mix(np.arange(1, 2 * count + 1, dtype=U) * U(_BASE)).astype(np.uint32)
    return x[:count] | np.uint32(1), x[count:]


def minhash(found: Shingles, count: int) -> np.ndarray:
    """A row per text of `count` 32-bit minima, mixed, one for each universal hash of its shingles; texts without
    shingles have all ones."""
    out = np.full((len(found.first) - 1, count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(found.first))
    if len(some):
        at, x = found.first[some], (found.hashes >> U(32)).astype(np.uint32)
        for k, (a, b) in enumerate(zip(*coefficients(count))):
            out[some, k] = np.minimum.reduceat(x * a + b, at)
        # Low bits of a minimum follow those of its shingle; mixed, any few bits of it can stand for it.
        m = out[some]
        m = (m ^ (m >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        m = (m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[some] = m ^ (m >> np.uint32(16))
    return out
