"""Packing documents into sequences: best fit by size class, then a swap-based local search.

Only sizes decide a packing, and there are at most `capacity` of them, so it is planned on the histogram of
piece lengths (2,048 numbers, whatever the input): best fit decreasing gives groups of equal bins (a tuple of
sizes and how many bins hold it). The local search then works between groups of underfull bins: it moves a
piece, exchanges one for one or two for one, whenever the sum of squared fills grows, for as many bins of the
two groups at once as there are, until no exchange helps, the bins are as few as the tokens need, or a bound on its looks is
reached; bins that it empties go. A group finds its partner in an index, not by meeting all others. Spark counts the histogram,
ranks the pieces within each size and joins them to the plan, which is broadcast: its rows are bounded by the
number of groups, a few for each size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import small_batches, trimmed, written
from airlens.llm.tokens import encoder

CAPACITY = 2048
#: Looks of the local search at most (some 10 s on the driver), and pieces that a look asks back at most for each that it could give.
STEPS, LOOKS = 20_000, 8

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = own.encode(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each text's ids and a closing 0, cut after every `capacity` of them; a null text has the 0 alone."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(_cut(path, capacity)), _PIECE)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Groups of bins: a tuple of sizes, descending, and how many bins hold it."""
    spaces: list[int] = []  # sorted
    groups: dict[int, Counter] = {}  # by space left

    def add(left: int, content: tuple, n: int) -> None:
        if left not in groups:
            groups[left] = Counter()
            spaces.insert(bisect_left(spaces, left), left)
        groups[left][content] += n

    for size in sorted(histogram, reverse=True):
        rest = histogram[size]
        while rest:
            k = bisect_left(spaces, size)
            if k == len(spaces):
                each = capacity // size
                if full := rest // each:
                    add(capacity - each * size, (size,) * each, full)
                if part := rest % each:
                    add(capacity - part * size, (size,) * part, 1)
                break
            left = spaces[k]
            content, n = next(iter(groups[left].items()))
            take = min(n, rest)
            groups[left][content] -= take
            if not groups[left][content]:
                del groups[left][content]
                if not groups[left]:
                    del groups[left]
                    del spaces[k]
            add(left - size, (*content, size), take)
            rest -= take
    out: Counter = Counter()
    for of in groups.values():
        out.update(of)
    return out


def _gives(content: tuple) -> list[tuple[int, tuple]]:
    """What a bin can give: a piece or two, by their sum."""
    held = Counter(content)
    sizes = sorted(held)
    one = [(x, (x,)) for x in sizes]
    return one + [(x + y, (x, y)) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or held[x] > 1]


class _Underfull:
    """Groups of underfull bins by a piece that they can give back (0: none), each list in order of free space, and the most
    space that a group with that piece has."""

    def __init__(self, capacity: int):
        self.capacity, self.by_piece, self.most = capacity, {}, np.full(capacity + 1, -1)

    def add(self, content: tuple) -> None:
        space = self.capacity - sum(content)
        for piece in {0, *content}:
            insort(self.by_piece.setdefault(piece, []), (space, content))
            self.most[piece] = max(self.most[piece], space)

    def drop(self, content: tuple) -> None:
        space = self.capacity - sum(content)
        for piece in {0, *content}:
            own = self.by_piece[piece]
            del own[bisect_left(own, (space, content))]
            self.most[piece] = own[-1][0] if own else -1

    def partner(self, own: tuple, single: bool) -> tuple[int, tuple, tuple, tuple] | None:
        """An exchange that raises the sum of squared fills, of those looked at the one that leaves the other bin with the least
        space: that space, what own gives, what it gets, the other. single: own is one bin, and no partner of itself."""
        best, space = None, self.capacity - sum(own)
        for gain, given in _gives(own):
            if gain > self.capacity:
                break
            need = gain - np.arange(gain)  # net of each piece that could come back
            over = self.most[:gain] - need
            if len(given) > 1:
                over[0] = -1  # two pieces move one by one
            some = np.flatnonzero(over >= 0)
            if len(some) > LOOKS:
                some = some[np.argpartition(over[some], LOOKS)[:LOOKS]]
            for lost in some.tolist():
                net, groups = gain - lost, self.by_piece[lost]
                at = bisect_left(groups, (net, ()))
                if single and groups[at][1] == own:
                    at += 1
                # The other bin gets fuller than own was, or was fuller before.
                if at < len(groups) and groups[at][0] < net + space and (best is None or groups[at][0] - net < best[0]):
                    best = groups[at][0] - net, given, (lost,) if lost else (), groups[at][1]
            if best is not None and best[0] == 0:
                break
        return best


def local_search(bins: Counter, capacity: int = CAPACITY, steps: int | None = None, made: list | None = None) -> Counter:
    """Exchanges between groups of underfull bins: a piece moves, or one or two pieces change places with one, where that
    raises the sum of squared fills. Groups give in rounds, the emptiest first, each to the group that it fills best, found by
    halving in an index of what groups can take. Ends with a round without an exchange, when the bins are as few as their pieces need, or after
    `steps` looks (STEPS), which bounds the time whatever the histogram. made: gets (bins of an exchange) for each."""
    bins = +Counter(bins)
    steps = STEPS if steps is None else steps
    left = sum(bins.values()) - -(-sum(sum(c) * n for c, n in bins.items()) // capacity)
    under = _Underfull(capacity)
    for c in sorted(bins):
        if sum(c) < capacity:
            under.add(c)
    changed = True
    while changed and left > 0 and steps > 0:
        changed = False
        waiting = [(sum(c), c) for c in bins if sum(c) < capacity]
        heapify(waiting)
        while waiting and left > 0 and steps > 0:
            _, own = heappop(waiting)
            while bins[own] and left > 0 and steps > 0:
                steps -= 1
                got = under.partner(own, bins[own] == 1)
                if got is None:
                    break
                _, given, back, other = got
                n = bins[own] // 2 if own == other else min(bins[own], bins[other])
                if made is not None:
                    made.append(n)
                changed = True
                left -= n * _exchange(bins, under, own, other, given, back, n, waiting)
    return +bins


def _exchange(bins: Counter, under: _Underfull, own: tuple, other: tuple, given: tuple, back: tuple, n: int, waiting: list) -> int:
    """Makes the exchange in n bins of either group; how many bins a pair of them loses."""
    less, more = list(own), list(other)
    for x in given:
        less.remove(x)
        more.append(x)
    for x in back:
        more.remove(x)
        less.append(x)
    for c in (own, other):
        bins[c] -= n
        if not bins[c]:
            del bins[c]
            under.drop(c)
    for c in (tuple(sorted(less, reverse=True)), tuple(sorted(more, reverse=True))):
        if c:
            if not bins[c] and sum(c) < under.capacity:
                under.add(c)
                heappush(waiting, (sum(c), c))
            bins[c] += n
    return int(not less)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, first_bin, each, offset): the pieces of that length ranked low to high-1 go into
    bins from first_bin on, `each` to a bin, the first at `offset`."""
    taken: Counter = Counter()
    rows, at = [], 0
    for content, n in sorted(local_search(best_fit(histogram, capacity), capacity).items()):
        offset = 0
        for size, each in sorted(Counter(content).items(), reverse=True):
            rows.append((size, taken[size], taken[size] + n * each, at, each, offset))
            taken[size] += n * each
            offset += size * each
        at += n
    return rows


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `found` (pieces(), written) with sequence_id and offset. Deterministic; rows that repeat are
    packed each. An empty table gives an empty result."""
    spark = found.sparkSession
    rows = found.count()
    # A length that many pieces have is ranked in parts: by a hash of the id, then within each part.
    parts = max(64, rows // 100_000)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counts = written(dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    table = spark.createDataFrame(plan(histogram, capacity), "length long, low long, high long, first_bin long, each long, at long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "part", before.alias("base"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    got = ranked.join(F.broadcast(table), (ranked.length == table.length) & (ranked["rank"] >= table.low) & (ranked["rank"] < table.high)).drop(table.length)
    index = F.col("rank") - F.col("low")
    return got.select(
        "doc_id", "piece", "start", ranked.length, "ids_crc32",
        (F.col("first_bin") + F.floor(index / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (index % F.col("each")) * ranked.length).alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return packed(written(pieces(docs, path, capacity), "pieces"), capacity)
