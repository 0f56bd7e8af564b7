"""Texts of few edits, by the hashes of what both have left when letters are left out.

A pair's texts are made equal by leaving out d letters of both together at most, the limit for their lengths.

    d <= 3        the whole texts: none of one's letters and up to three of the other's left out, or one of each
    d = 3, 1 + 2  one of the halves of the shorter text has one edit at most
    d = 4, 5      the first or the last letters, as many as half the shortest of such texts has, have two edits at most

Texts of a length are hashed together, as a table of letters: the hash is a sum over places, so each way of leaving letters out takes
a few additions. Of the many ways those of two or three letters, and of parts, are kept only where a filter of bits holds the same hash for a
text, or part, with nothing left out. What is shuffled is a hash, an id and a word of flags.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Edits up to which pairs are found here, and letters of both texts together.
LARGE, FAR = 5, 120
#: Words of 64 bits in a chunk of the filter, and in the filter for each text.
CHUNK, WORDS = 1 << 13, 0.75
#: Hashes that are made at once; rows of a partition, about; pairs that are looked at at once.
AT_ONCE, ROWS, PAIRS = 1 << 20, 1_000_000, 1 << 20

#: Edits of a pair by the letters of both together, from 0 to FAR.
Limits = tuple[int, ...]

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_WHOLE, _HEAD, _HEAD_LESS, _FIRST, _FIRST_LESS, _FIRST_TWO = 1, 2, 4, 6, 8, 10


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(None)
def _cuts(length: int, out: int) -> np.ndarray:
    return np.array(list(combinations(range(length), out)), np.int64).reshape(math.comb(length, out), out)


def left_out(letters: np.ndarray, out: int) -> np.ndarray:
    """Hashes of texts (rows of letters) with `out` letters left out, a column for each way."""
    many, length = letters.shape
    powers = np.cumprod(np.append(np.uint64(1), np.full(length - 1, _BASE, np.uint64)))
    sums = np.zeros((many, length + 1), np.uint64)
    np.cumsum(letters * powers, axis=1, out=sums[:, 1:])
    if not out:
        return sums[:, length:]
    cuts = _cuts(length, out)
    ends = np.column_stack([cuts[:, 1:], np.full(len(cuts), length)])
    got = sums[:, cuts[:, 0]]
    for j in range(out):
        got += (sums[:, ends[:, j]] - sums[:, cuts[:, j] + 1]) * np.uint64(pow(_BACK, j + 1, 1 << 64))
    return got


def limited(limits: Limits, both: int) -> int:
    """Edits of a pair by the letters of both together; -1 where it isn't found here."""
    return limits[both] if both < len(limits) and limits[both] <= LARGE else -1


@lru_cache(None)
def forms(length: int, limits: Limits) -> list[tuple[int, int, int, int, int, int, bool]]:
    """kind, size, low, high, out, side, asked of a text of this length: its letters from low to high, `out` of them left out, meet those of
    the same kind and size. side: 1 of the shorter text, 2 of the longer, 0 of either. asked: only if the filter has it."""
    limit, n, found = partial(limited, limits), length, []
    some = lambda both, *of: limit(both) in of
    if any(g <= limit(2 * n + g) <= 3 for g in (1, 2, 3)):
        found.append((_WHOLE, n, 0, n, 0, 0, False))
    if some(2 * n, 2, 3) or some(2 * n - 1, 1, 2, 3):
        found.append((_WHOLE, n - 1, 0, n, 1, 0, not some(2 * n, 2, 3)))
    if some(2 * n - 2, 2, 3):
        found.append((_WHOLE, n - 2, 0, n, 2, 0, True))
    if some(2 * n - 3, 3):
        found.append((_WHOLE, n - 3, 0, n, 3, 0, True))
    if some(2 * n + 1, 3):  # as the shorter of two
        for tail, (low, high) in enumerate([(0, n // 2), (n // 2, n)]):
            found += [(_HEAD + tail, n, low, high, 0, 1, False), (_HEAD_LESS + tail, n, low, high, 1, 1, True)]
    if some(2 * n - 1, 3):  # as the longer
        head = (n - 1) // 2
        for tail, size in enumerate([head, n - 1 - head]):
            at = lambda k, tail=tail: (n - k, n) if tail else (0, k)
            found += [(_HEAD + tail, n - 1, *at(size + 1), 1, 2, True), (_HEAD_LESS + tail, n - 1, *at(size - 1), 0, 2, False)]
    if any(some(n + m, 4, 5) for m in range(n - LARGE, n + LARGE + 1)):
        size = next(k for k in range(1, n + 1) if any(some(k + m, 4, 5) for m in range(k, k + LARGE + 1))) // 2
        for tail in (0, 1):
            at = lambda k, tail=tail: (n - k, n) if tail else (0, k)
            found += [(_FIRST + tail, size, *at(size), 0, 1, False), (_FIRST + tail, size, *at(size + 2), 2, 2, True), (_FIRST_LESS + tail, size, *at(size), 1, 0, False)]
            found += [(_FIRST_TWO + tail, size, *at(size), 2, 1, True), (_FIRST_TWO + tail, size, *at(size - 2), 0, 2, False)]
    return found


def _hashed(batch: pa.RecordBatch, limits: Limits, wanted: Callable[[tuple], bool]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """places in the batch, letters, hashes (a row a place, a column a way) and form of all forms that are wanted."""
    lengths = pc.utf8_length(batch.column("key")).to_numpy()
    salts = batch.column("salt").to_numpy().view(np.uint64)
    for length in np.unique(lengths).tolist():
        own = [f for f in forms(length, limits) if wanted(f)]
        places = np.flatnonzero(lengths == length) if own else ()
        if not own:
            continue
        texts = np.array(batch.column("key").take(pa.array(places)).to_pylist(), f"U{length}").view(np.uint32).reshape(-1, length)
        letters = mixed((texts.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        for form in own:
            kind, size, low, high, out, _, _ = form
            salt = mixed(salts[places] + np.uint64(kind << 32 | size))[:, None]
            step = max(1, AT_ONCE // math.comb(high - low, out))
            for at in range(0, len(places), step):
                part = slice(at, at + step)
                yield places[part], texts[part], mixed(left_out(letters[part, low:high], out) ^ salt[part]), form


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Four bits of a word by a hash."""
    bit = lambda at: np.uint64(1) << ((hashes >> np.uint64(at)) & np.uint64(63))
    return bit(0) | bit(6) | bit(12) | bit(18)


def _word(hashes: np.ndarray, words: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(words)).astype(np.int64)


def _filter(texts: DataFrame, limits: Limits, words: int) -> np.ndarray:
    """A filter of bits that holds what is hashed with nothing left out."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [h.ravel() for _, _, h, _ in _hashed(batch, limits, lambda f: f[4] == 0)]
            hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *got]))
            word = _word(hashes, words)
            yield pa.RecordBatch.from_arrays([pa.array(word // CHUNK), pa.array(word % CHUNK), pa.array(_bits(hashes).view(np.int64))], names=["chunk", "word", "bits"])

    def packed(table: pa.Table) -> pa.Table:
        own = np.zeros(CHUNK, np.uint64)
        np.bitwise_or.at(own, table.column("word").to_numpy(), table.column("bits").to_numpy().view(np.uint64))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "words": pa.array([own.tobytes()], pa.binary())})

    found = np.zeros(words, np.uint64)
    for row in texts.mapInArrow(entries, "chunk long, word long, bits long").groupBy("chunk").applyInArrow(packed, "chunk long, words binary").toLocalIterator():
        found[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.words, np.uint64)
    return found


def _letters_of(texts: np.ndarray) -> np.ndarray:
    """48 bits, one for each letter that is there an odd number of times: an edit changes one."""
    bits = np.uint64(1) << (texts % 48).astype(np.uint64)
    return np.bitwise_xor.reduce(bits, axis=1)


def _met(table: pa.Table, limits: Limits) -> Iterator[pa.RecordBatch]:
    """x, y (ids, x < y) of rows with the same hash that can be as near as they have to be."""
    of = np.array([limited(limits, both) for both in range(2 * FAR + 1)])
    at, id_, what = (table.column(c).to_numpy() for c in ("at", "id", "what"))
    if len(at) < 2:
        return
    order = np.argsort(at)
    at = at[order]
    same = at[1:] == at[:-1]
    kept = np.append(False, same) | np.append(same, False)
    order, at = order[kept], at[kept]
    id_, what = id_[order], what[order].view(np.uint64)
    letters, n, out, side = what >> np.uint64(16), (what >> np.uint64(4) & np.uint64(0xFFF)).astype(np.int64), (what >> np.uint64(2) & np.uint64(3)).astype(np.int64), (what & np.uint64(3)).astype(np.int64)
    ends = np.searchsorted(at, at, "right")
    left, many, gap = np.arange(len(at)), 0, 1
    held: list[np.ndarray] = []
    while len(left := left[left + gap < ends[left]]):
        for begin in range(0, len(left), PAIRS):
            x = left[begin : begin + PAIRS]
            y = x + gap
            most = of[np.minimum(n[x] + n[y], 2 * FAR)]
            good = (id_[x] != id_[y]) & (np.abs(n[x] - n[y]) <= most) & (out[x] + out[y] <= most) & (np.bitwise_count(letters[x] ^ letters[y]) <= np.maximum(most, 0))
            good &= ((side[x] == 0) & (side[y] == 0)) | ((side[x] == 1) & (side[y] == 2) & (n[x] <= n[y])) | ((side[x] == 2) & (side[y] == 1) & (n[x] >= n[y]))
            x, y = id_[x[good]], id_[y[good]]
            held.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
            many += len(x)
            if many > PAIRS:
                yield _pairs(held)
                held, many = [], 0
        gap += 1
    if many:
        yield _pairs(held)


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])


def near_ids(texts: DataFrame, limits: Limits) -> DataFrame:
    """x, y (x < y, each pair once): all pairs of one salt with so few edits as their lengths allow, and others. texts: id (long), salt (long), key; they are read three times."""
    spark = texts.sparkSession
    many = texts.count()
    words = max(1, -(-int(many * WORDS) // CHUNK)) * CHUNK
    sent = spark.sparkContext.broadcast(_filter(texts, limits, words))

    def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for places, letters, hashes, (kind, _, _, _, out, side, asked) in _hashed(batch, limits, lambda f: True):
                row, at = np.repeat(np.arange(len(places)), hashes.shape[1]), hashes.ravel()
                if asked:
                    bits = _bits(at)
                    kept = np.flatnonzero(have[_word(at, words)] & bits == bits)
                    row, at = row[kept], at[kept]
                # Whole texts that meet are as near as they have to be, so their letters aren't compared.
                own = _letters_of(letters) if kind != _WHOLE else np.zeros(len(places), np.uint64)
                what = own << np.uint64(16) | np.uint64(letters.shape[1] << 4 | out << 2 | side)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(ids[places[row]]), pa.array(what[row].view(np.int64))], names=["at", "id", "what"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            yield from _met(pa.Table.from_batches(got), limits)

    parts = max(spark.sparkContext.defaultParallelism, many * 25 // ROWS)
    near = texts.mapInArrow(rows, "at long, id long, what long").repartition(parts, "at").mapInArrow(meet, "x long, y long")
    return near.distinct()
