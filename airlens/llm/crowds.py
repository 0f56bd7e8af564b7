"""Buckets that may hold a large share of all nodes: counted in parts, compared in units of bounded size, and their pairs
confirmed unit by unit, so that a text is shipped once a unit and not once a pair.

A unit is a block of at most about BLOCK open members of a bucket (`left`) and one of all its members (`right`): together
the units hold every pair that an open member is in, once. What a unit finds leaves it as lists, not as a row a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import slices, split_join, trimmed, written
from airlens.llm.shingles import shingle_sets

BLOCK = 1024
#: Pairs of one node that are confirmed together, and shingles of either side of a list.
GROUP, LIST_SHINGLES = 256, 2_000_000
#: A bucket that a sample of this many nodes shows to hold over a 64th of them is counted in PARTS. The sample decides
#: how rows are dealt, not which.
SAMPLED, PARTS = 20_000, 64
#: Ids of at most this many documents are broadcast to pick out texts (16 MB); beyond, they are joined.
BROADCAST_IDS = 1_000_000

_LISTS = pa.schema([("unit", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def buckets(nodes: DataFrame, enter: Callable[[DataFrame], DataFrame], keys: list[str], name: str) -> DataFrame:
    """The rows of enter(nodes) (keys and node) whose bucket has several, with their number `n` and the least node, `first`.
    nodes: a written table with `node`. The driver gets the hashes of hot buckets, at most 64 for each key of a node."""
    one_in = max(1, nodes.count() // SAMPLED)
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(one_in)), F.lit(one_in)) == 0)
    hot = enter(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SAMPLED // PARTS)
    hot = F.xxhash64(*keys).isin([r[0] for r in hot.select(F.xxhash64(*keys)).collect()])
    part = F.when(hot, F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(0)
    own = Window.partitionBy(*keys, "_part")
    found = enter(nodes).withColumn("_part", part.cast("int")).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("first", F.min("node").over(own))
    found = written(found.withColumn("_hot", hot).where("n > 1 or _hot").drop("_part"), name)
    apart = found.where("_hot").drop("n", "first", "_hot")
    whole = apart.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    return found.where("not _hot").drop("_hot").unionByName(apart.join(F.broadcast(whole), keys)).where("n > 1")


def with_bucket(members: DataFrame, keys: list[str], rows: int, *columns: Column, where: str = "true") -> DataFrame:
    """Members with aggregates of their bucket, of the buckets that fit `where`: partial sums first, then a join that deals
    out hot buckets."""
    return split_join(members, members.groupBy(*keys).agg(*columns).where(where), keys, "node", rows)


def in_units(members: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """members: keys, node, open, n, m (members of the bucket, and open ones). Rows sorted by unit: keys, i, j, left, right, node,
    open, payload. Closed members are repeated once a block of open ones, open ones once a block of all as well."""
    down, across = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumns({"_i": F.pmod(F.xxhash64("node", F.lit(1)), down).cast("int"), "_j": F.pmod(F.xxhash64("node"), across).cast("int")})
    place = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    no, yes = F.lit(False), F.lit(True)
    rights = F.transform(F.sequence(F.lit(0), down - 1), lambda x: place(x, F.col("_j"), F.col("open") & (x == F.col("_i")), yes))
    lefts = F.transform(F.filter(F.sequence(F.lit(0), across - 1), lambda x: x != F.col("_j")), lambda x: place(F.col("_i"), x, yes, no))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("open"), F.concat(rights, lefts)).otherwise(rights)))
    rows = rows.select(*keys, "_at.*", "node", "open", *payload)
    return rows.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "node")


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by `names`, one batch for each run of equal ones."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            unit = tuple(c[a] for c in columns)
            if held and unit != last:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = unit
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def candidates(rows: DataFrame, keys: list[str], close: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """unit, a, b: lists of pairs that `close` lets through, of rows as in_units gives them (with n_shingles and, where a pair
    inside one component isn't wanted, comp). close(unit, x, y): flags for the pairs of rows x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, [*keys, "i", "j"]):
            node, size, opened = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n_shingles", "open"))
            comp = unit.column("comp").to_numpy(zero_copy_only=False) if "comp" in unit.schema.names else node
            left, right = (np.flatnonzero(unit.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
            # Lists are cut where either side's sets would grow large.
            group = np.cumsum(size) // LIST_SHINGLES
            xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            step = max(1, 30_000 // max(1, len(right)))
            for at in range(0, len(left), step):
                own = left[at : at + step]
                # A set of likeness 0.75 or more is at least three quarters as large; a pair of two open members comes once.
                ok = (4 * np.minimum(size[own][:, None], size[right]) >= 3 * np.maximum(size[own][:, None], size[right])) & (comp[own][:, None] != comp[right])
                ok &= (node[own][:, None] < node[right]) | (~opened[right] & (node[own][:, None] != node[right]))
                x, y = np.nonzero(ok)
                x, y = own[x], right[y]
                if len(x):
                    ok = close(unit, x, y)
                    xs.append(x[ok])
                    ys.append(y[ok])
            x, y = np.concatenate(xs), np.concatenate(ys)
            if not len(x):
                continue
            key = hash(tuple(int(unit.column(c)[0].as_py()) for c in [*keys, "i", "j"]))
            part = group[x] << 20 | group[y]
            lists = [(hash((key, int(p))), part == p) for p in np.unique(part)]
            columns = [pa.array([k for k, _ in lists]), *(pa.array([node[z[at]] for _, at in lists], pa.list_(pa.int64())) for z in (x, y))]
            yield pa.RecordBatch.from_arrays(columns, schema=_LISTS)

    return rows.mapInArrow(trimmed(run), "unit long, a array<long>, b array<long>")


def listed(pairs: DataFrame) -> DataFrame:
    """unit, a, b of pairs (a, b; a written table): the pairs of one `a` in lists of about GROUP."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP).select("a", F.ceil(F.col("_n") / GROUP).alias("_lists"))
    part = F.pmod(F.xxhash64("b"), F.coalesce("_lists", F.lit(1)))
    dealt = split_join(pairs.select("a", "b"), many, ["a"], "b", pairs.count(), "left").select(F.xxhash64("a", part).alias("unit"), "a", "b")
    return dealt.groupBy("unit").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit: lists of pairs, and the texts of their nodes."""

    def sets() -> Iterator[tuple[int, int | None, list | np.ndarray]]:
        for batch in batches:
            for part in slices(batch, "text"):
                node = part.column("node").to_pylist()
                for k, (unit, own) in enumerate(zip(part.column("unit").to_pylist(), shingle_sets(part.column("text")))):
                    pairs = None if node[k] is not None else [part.column(c).slice(k, 1).flatten().to_numpy() for c in ("a", "b")]
                    yield unit, node[k], own if pairs is None else pairs

    def linked(pairs: list, own: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        own = sorted(own, key=lambda x: x[0])
        known, values = np.array([k for k, _ in own], np.int64), [v for _, v in own]
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        # An id may have several texts; any of them may link it.
        (x, more), (y, others) = ((low := np.searchsorted(known, z), np.searchsorted(known, z, "right") - low) for z in (a, b))
        if (more != 1).any() or (others != 1).any():
            every = [(p, q) for i in range(len(a)) for p in range(x[i], x[i] + more[i]) for q in range(y[i], y[i] + others[i])]
            x, y = np.array(every, np.int64).reshape(-1, 2).T
            a, b = known[x], known[y]
        size = np.array([len(v) for v in values], np.int64)
        code = np.unique(np.concatenate([np.zeros(0, np.uint64), *values]), return_inverse=True)[1]
        first = np.append(0, np.cumsum(size))
        flags, both = np.zeros(len(code) + 1, bool), np.zeros(len(a), np.int64)
        order = np.argsort(x, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(order) else []:
            mine = code[first[x[at[0]]] : first[x[at[0]] + 1]]
            flags[mine] = True
            for k in at:
                both[k] = np.count_nonzero(flags[code[first[y[k]] : first[y[k] + 1]]])
            flags[mine] = False
        ok = (both > 0) & (100 * both >= 75 * (size[x] + size[y] - both))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])

    pairs: list = []
    own: list[tuple[int, np.ndarray]] = []
    last = None
    for unit, node, value in sets():
        if unit != last and pairs:
            yield linked(pairs, own)
        if unit != last:
            pairs, own, last = [], [], unit
        if node is None:
            pairs.append(value)
        else:
            own.append((node, value))
    if pairs:
        yield linked(pairs, own)


def confirmed(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """a < b: of the pairs in the lists (unit, a, b; a written table) those whose full shingle sets have a Jaccard likeness
    of 0.75 or more. A text is shipped once for each unit that its node is in; only nodes of pairs are."""
    members = lists.select("unit", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    rows, ids = members.count(), members.select("node").distinct()
    if rows <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(ids, "node", "left_semi")
    texts = split_join(members, texts, ["node"], "unit", rows).select("unit", "node", "text", *(F.lit(None).cast("array<long>").alias(c) for c in "ab"))
    both = lists.select("unit", F.lit(None).cast("long").alias("node"), F.lit(None).cast("string").alias("text"), "a", "b").unionByName(texts)
    return both.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(trimmed(_likeness), "a long, b long").distinct()
