"""Exact pairs of vectors within an angle and a span of time, by pivots and the triangle inequality on angles.

Each item belongs to the cell of its nearest pivot, in its window of time, and to a ring of that cell (its angle to the pivot, in steps of the
threshold's angle). An item can only be near members of a cell whose angle to the pivot differs from its own by at most the threshold's angle, so it
visits the rings in that reach and no others, in its own window and the next, and only those that have members. In a
ring the members meet the visitors list by list, each list a matrix; what angles to the pivots rule out is left away. A pair of
two cells is met from one side only.

Pivots are chosen far apart in a bounded sample; they decide how much is compared, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.text import dot

PIVOTS, SAMPLE = 64, 4000
#: Rings of a cell; items of a list, about; numbers multiplied at once.
RINGS, BLOCK, AT_ONCE = 64, 128, 1 << 20
#: Reach (radians) from which one pivot does.
WIDE = 1.05
#: Rounding of angles and products.
SLACK = 1e-9


def chosen(items: DataFrame, most_pivots: int = PIVOTS) -> np.ndarray:
    """Unit vectors far apart, of a sample of at most SAMPLE items (the least hashes of their ids)."""
    rows = items.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).select("embedding").collect()
    size = max((len(r[0]) for r in rows), default=0)
    if not size:
        return np.ones((1, 1))
    vectors = np.array([r[0] for r in rows if len(r[0]) == size], float)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    picked, most = [0], vectors @ vectors[0]
    while len(picked) < min(most_pivots, len(vectors)):
        far = int(np.argmin(most))
        if most[far] > 1 - 1e-6:  # all others are copies
            break
        picked.append(far)
        most = np.maximum(most, vectors @ vectors[far])
    return vectors[picked]


def with_angles(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds `angles` to the pivots; null for vectors of another length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            whole = [v is not None and len(v) == pivots.shape[1] for v in lists]
            rows = np.array([v.values.to_numpy(zero_copy_only=False) for v, ok in zip(lists, whole) if ok], float).reshape(-1, pivots.shape[1])
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            angle = iter(np.arccos(np.clip(rows @ pivots.T / norm, -1, 1)).tolist())
            angles = [next(angle) if ok else None for ok in whole]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles, pa.list_(pa.float64()))], names=[*batch.schema.names, "angles"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, f"{schema}, angles array<double>")


def _met(reach: float, window: int, least: float | None):
    """Pairs x, y, similarity of blocks of visitors and members: those that angles, minutes and the order of a pair leave, from `least` on. A product of
    matrices picks them, with room for its rounding; the similarity itself is summed up element by element, as `dot` does."""

    def table(values: pa.StructArray, *names: str) -> list[np.ndarray]:
        n = len(values)
        flat = [values.field(name) for name in names]
        return [np.asarray(f.flatten(), float).reshape(n, -1) if pa.types.is_list(f.type) else np.asarray(f) for f in flat]

    def pairs(left: list[np.ndarray], right: list[np.ndarray], next_window: bool, cell: int) -> Iterator[tuple]:
        x, mx, vx, nx, ax, cx, at = left
        y, my, vy, ny, ay, angle = right
        # Of one window: by cell, and inside a cell by id, so that a pair is met once. Of two windows the earlier one visits.
        keep = (np.abs(mx[:, None] - my) <= window) & (np.abs(at[:, None] - angle) <= reach)
        if not next_window:
            keep &= (cx[:, None] < cell) | ((cx[:, None] == cell) & (x[:, None] < y))
        if least is not None:
            keep &= vx @ vy.T >= (least - SLACK) * nx[:, None] * ny
        i, j = np.nonzero(keep)
        size = max(1, AT_ONCE // max(vx.shape[1], ax.shape[1]))
        for k in range(0, len(i), size):
            p, q = i[k : k + size], j[k : k + size]
            near = (np.abs(ax[p] - ay[q]) <= reach).all(axis=1)
            p, q = p[near], q[near]
            similarity = np.add.accumulate(vx[p] * vy[q], axis=1)[:, -1] / (nx[p] * ny[q])
            said = similarity >= least if least is not None else np.ones(len(p), bool)
            yield x[p[said]], y[q[said]], similarity[said]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, bucket, cell, lefts, rights = (batch.column(c) for c in ("own", "bucket", "cell", "visitors", "members"))
            for k in range(batch.num_rows):
                left = table(lefts[k].values, "item_id", "minute", "embedding", "norm", "angles", "cell", "at")
                right = table(rights[k].values, "item_id", "minute", "embedding", "norm", "angles", "angle")
                for found in pairs(left, right, own[k].as_py() < bucket[k].as_py(), cell[k].as_py()):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["x", "y", "similarity"])

    return run


def candidates(items: DataFrame, threshold: float, window: int, least: float | None = None) -> DataFrame:
    """x, y, similarity of the pairs that angles, minutes and windows leave; with `least` of those alone that reach it. items: item_id, minute, embedding.
    Members of a ring, and those who visit it from one window, meet as lists of some BLOCK items."""
    rows = items.select("item_id", "minute", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"), F.floor(F.col("minute") / window).alias("bucket")).where("norm > 0")
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    # Most directions are about a right angle apart: beyond a reach of 60 degrees or so more pivots tell nothing apart.
    pivots = chosen(rows, PIVOTS if reach < WIDE else 1)
    ring = lambda angle: F.least(F.floor(angle / reach), F.lit(RINGS - 1)).cast("int")
    rows = with_angles(rows, pivots)
    other = rows.where("angles is null").drop("angles")
    rows = rows.where("angles is not null")
    cell = F.array_position("angles", F.array_min("angles")).cast("int") - 1
    members = rows.withColumn("cell", cell).withColumn("angle", F.array_min("angles")).withColumn("ring", ring(F.col("angle"))).withColumn("place", F.col("cell") * RINGS + F.col("ring"))
    # How many members the rings have: a row a window, for itself and for the window before it.
    held = members.groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("held"), F.sum("n").alias("total"))
    held = held.join(held.select(F.col("bucket") - 1, F.col("held").alias("after")).toDF("bucket", "after"), "bucket", "left")
    part = lambda n: F.pmod(F.xxhash64("item_id"), F.ceil(n / BLOCK)).cast("int")
    members = members.join(held, "bucket")
    steps = F.sequence(F.lit(0), F.lit(len(pivots) - 1))

    def hits(rings: Column, bucket: Column) -> Column:
        """The rings in an item's reach that have members."""
        each = F.transform(steps, lambda c: F.struct(c.alias("to"), F.greatest(F.lit(0), ring(F.get("angles", c) - reach)).alias("least"), ring(F.get("angles", c) + reach).alias("most")))
        return F.flatten(F.transform(each, lambda e: F.transform(F.filter(F.sequence(e["least"], e["most"]), lambda r: F.try_element_at(rings, e["to"] * RINGS + r).isNotNull()), lambda r: F.struct(bucket.alias("bucket"), e["to"].alias("cell"), r.alias("ring"), F.get("angles", e["to"]).alias("at")))))

    here = hits(F.col("held"), F.col("bucket"))
    visits = members.withColumn("v", F.explode(F.when(F.col("after").isNull(), here).otherwise(F.concat(here, hits(F.col("after"), F.col("bucket") + 1)))))
    both = ["item_id", "minute", "embedding", "norm", "angles"]
    left = visits.groupBy(F.col("bucket").alias("own"), "v.bucket", "v.cell", "v.ring", part(F.col("total")).alias("part")).agg(F.collect_list(F.struct(*both, "cell", "v.at")).alias("visitors")).drop("part")
    right = members.groupBy("bucket", "cell", "ring", part(F.element_at("held", F.col("place"))).alias("part")).agg(F.collect_list(F.struct(*both, "angle")).alias("members")).drop("part")
    met = left.join(right, ["bucket", "cell", "ring"]).select("own", "bucket", "cell", "visitors", "members")
    kinds = dict(items.select("item_id").dtypes)
    met = met.mapInArrow(_met(reach, window, least), f"x {kinds['item_id']}, y {kinds['item_id']}, similarity double")
    # Vectors of other lengths than the pivots' meet their own kind by window, as there is nothing to tell them apart by.
    odd = other.withColumn("own", F.col("bucket")).withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1))).withColumn("size", F.size("embedding"))
    odd = odd.select("bucket", "own", "size", F.col("item_id").alias("x"), F.col("minute").alias("mx"), F.col("embedding").alias("ex"), F.col("norm").alias("nx")).join(other.withColumn("size", F.size("embedding")), ["bucket", "size"])
    odd = odd.where(((F.col("own") < F.col("bucket")) | (F.col("x") < F.col("item_id"))) & (F.abs(F.col("mx") - F.col("minute")) <= window))
    odd = odd.select("x", F.col("item_id").alias("y"), (dot(F.col("ex"), F.col("embedding")) / (F.col("nx") * F.col("norm"))).alias("similarity"))
    return met.unionByName(odd if least is None else odd.where(F.col("similarity") >= least))


def similar_pairs(items: DataFrame, threshold: float, window: int) -> DataFrame:
    """a, b, similarity of items (item_id, minute, embedding) at most `window` minutes apart, from the threshold on."""
    return candidates(items, threshold, window, threshold).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
