"""Document fingerprints: MinHash by universal hash permutations over five-word shingles, in numpy.

A fingerprint is 128 components of 8 bits in hex. Two fingerprints' likeness estimates the Jaccard likeness of
the shingle sets: the share of equal components, less what chance alone makes equal. `band_links` finds near
copies over buckets of equal bands of four components; documents with equal sets are one node. First each bucket's
members meet its smallest id; then members without a confirmed smaller one meet all smaller members of their buckets, in
units of bounded size (crowds.py). Pairs that differ in at most MAX_DIFFER components are confirmed on the full
sets. Of pairs at likeness 0.75, five in a million share no band, and less than one in a million differs in more
components.

Null texts are empty; texts without words share one fingerprint, all f, and have no near copy. Very long texts are
read whole, a slice of rows at a time. Extra columns are ignored; rows of one doc_id stand in the order of their
texts; rows without one come last and have no near copy; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import slices, small_batches, split_join, trimmed, written
from airlens.llm.crowds import BROADCAST_IDS, buckets, candidates, confirmed, in_units, listed, with_bucket
from airlens.llm.shingles import Shingles, buffers, minhash, set_digests, shingles, words

COMPONENTS, BAND = 128, 4
#: Mean of 0.249 * 128 differing components at likeness 0.75, and five standard deviations more.
MAX_DIFFER = 57


def _shingles(column: pa.Array) -> Shingles:
    return shingles(words(*buffers(column)))


def _signature(found: Shingles) -> np.ndarray:
    return minhash(found, COMPONENTS).astype(np.uint8)


def signature(column: pa.Array) -> np.ndarray:
    return _signature(_shingles(column))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a == b).mean(1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many of the following text's first ones."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_ROW = "doc_id long, n_chars long, edited_sha256 binary, print binary, edited_print binary, near_edited double, near_next double, set_a long, set_b long, n_shingles long"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
#: In a written part: 0 a whole row, 1 and 2 the part's first and last document, whose neighbours are in other parts.
_PART = f"{_ROW}, kind int, part int, text string"


def _rows(doc_ids: list, own: list[str], mine: tuple, following: list[str], next_sig: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(own, following)]
    sig = signature(pa.array(changed, pa.large_string()))
    own_sig, digests = mine
    return [
        pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).digest() for x in changed], pa.binary()),
        pa.array([x.tobytes() for x in own_sig], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()),
        pa.array(likeness(own_sig, sig)), pa.array(likeness(own_sig, next_sig)), *(pa.array(x) for x in digests.T),
    ]


def _described(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and set_a, set_b, n_shingles."""
    found = _shingles(column)
    return _signature(found), np.stack(set_digests(found), axis=1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order, each with the next one's text at hand; the part's first and last rows come out as they are."""
    held: tuple | None = None
    own_part = TaskContext.get().partitionId()
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("print", pa.binary()), ("edited_print", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n_shingles", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])

    def edge(row: tuple, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"doc_id": row[0], "text": row[1], "kind": kind, "part": own_part}], schema)

    for batch in batches:
        for part in slices(batch, "text"):
            doc_ids, texts = part.column("doc_id").to_pylist(), [x or "" for x in part.column("text").to_pylist()]
            sig, digests = _described(part.column("text"))
            if held is None:
                yield edge((doc_ids[0], texts[0]), 1)
                ids, own, mine, following, next_sig = doc_ids[:-1], texts[:-1], (sig[:-1], digests[:-1]), texts[1:], sig[1:]
            else:
                ids, own, mine = [held[0], *doc_ids[:-1]], [held[1], *texts[:-1]], (np.concatenate([held[2], sig[:-1]]), np.concatenate([held[3], digests[:-1]]))
                following, next_sig = texts, sig
            held = (doc_ids[-1], texts[-1], sig[-1:], digests[-1:])
            n = len(ids)
            columns = _rows(ids, own, mine, following, next_sig)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([0] * n, pa.int32()), pa.array([own_part] * n, pa.int32()), pa.nulls(n, pa.string())], schema=schema)
    if held is not None:
        yield edge(held, 2)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own, following = ([x or "" for x in batch.column(c).to_pylist()] for c in ("text", "following"))
            columns = _rows(batch.column("doc_id").to_pylist(), own, _described(batch.column("text")), following, signature(batch.column("following")))
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def neighbour_prints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint (print), that of its edited text, the likeness to it and to the next document's,
    in descending order of doc_id (after the last: the first), and what tells its set from others. Texts are
    shuffled once, by ranges of ids; a written table."""
    small_batches(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")
    done = written(ranged.mapInArrow(_neighbours, _PART), "prints")
    # Which part comes next is told by the parts' numbers alone, a row a part; then its first text is fetched.
    first, last = done.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following")), done.where("kind = 2").select("part", "doc_id", "text")
    order = Window.orderBy("part")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = done.where("kind = 1").select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(around)))
    edges = last.join(after, "part").join(first, "next").select("doc_id", "text", "following")
    return done.where("kind = 0").select(*_NAMES).union(written(edges.mapInArrow(_finish, _ROW), "part-ends"))


def readable(prints: DataFrame) -> list:
    """The columns of neighbour_prints that fingerprints() shows, hashes and fingerprints in hex."""
    hexed = {"edited_sha256": "edited_sha256", "print": "fingerprint", "edited_print": "edited_fingerprint"}
    return [F.lower(F.hex(prints[c])).alias(hexed[c]) if c in hexed else prints[c] for c in _NAMES[:7]]


def _matrix(prints: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), COMPONENTS)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            differ = (_matrix(batch.column("print_a")) != _matrix(batch.column("print_b"))).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(differ <= MAX_DIFFER))


def _close_in(unit: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An open member x and a smaller one y (or another open one), where this band is the first that they share and y is
    not the bucket's first, whom x has met."""
    node, first, opened = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("node", "first", "open"))
    out = ((node[y] < node[x]) | opened[y]) & (node[y] != first[y])
    at = np.flatnonzero(out)
    sig = _matrix(unit.column("print"))
    bands = sig.view(np.uint32)  # a band is four bytes
    ok = (bands[x[at]] == bands[y[at]]).argmax(1) == unit.column("slot")[0].as_py()
    at, out = at[ok], np.zeros(len(x), bool)
    out[at[(sig[x[at]] != sig[y[at]]).sum(1) <= MAX_DIFFER]] = True
    return out


def band_keys(nodes: DataFrame) -> DataFrame:
    """slot, band, node: a row for each band of each row of nodes (node, print)."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(COMPONENTS // BAND - 1)), lambda k: F.conv(F.hex(F.substring("print", k * BAND + 1, F.lit(BAND))), 16, 10).cast("long"))
    return nodes.select("node", F.posexplode(bands).alias("slot", "band")).select("slot", "band", "node")


def band_links(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, near_id, once for each document that has one: a smaller doc_id with the same set, or one that it shares a band
    with and is confirmed against (likeness 0.75 on full sets), the smallest of those compared.
    prints: doc_id, print, set_a, set_b, n_shingles (written)."""
    keyed = prints.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set_a", "set_b", "n_shingles", "print")
    least = keyed.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "print")).alias("x"))
    nodes = written(least.select("set_a", "set_b", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.print").alias("print")), "nodes")

    keys = ["slot", "band"]
    shared = buckets(nodes, band_keys, keys, "buckets")
    one, other = nodes.select(F.col("node").alias("a"), F.col("print").alias("print_a")), nodes.select(F.col("node").alias("b"), F.col("print").alias("print_b"))
    pairs = shared.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = split_join(pairs, one, ["a"], "b", pairs.count()).join(other, "b").select("a", "b", "print_a", "print_b")
    pairs = written(pairs.mapInArrow(trimmed(_close), "a long, b long"), "band-pairs")
    links = written(confirmed(written(listed(pairs), "lists"), docs), "links")

    # A bucket of two has been compared whole.
    near = links.select(F.col("b").alias("node"), F.lit(True).alias("near")).distinct()
    held = shared.where("n > 2").join(near, "node", "left").withColumn("open", F.col("near").isNull() & (F.col("node") != F.col("first"))).drop("near")
    held = with_bucket(held, keys, shared.count(), F.count_if("open").alias("m"), where="m > 0").join(nodes.select("node", "n_shingles", "print"), "node")
    units = in_units(held, keys, ["first", "n_shingles", "print"])
    links = links.union(confirmed(written(candidates(units, keys, _close_in), "more"), docs))

    near = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("near"))
    smaller = nodes.select("set_a", "set_b", "node").join(near, "node", "left")
    found = split_join(keyed.select("doc_id", "set_a", "set_b"), smaller, ["set_a", "set_b"], "doc_id", keyed.count())
    found = found.select("doc_id", F.coalesce("near", F.when(F.col("node") != F.col("doc_id"), F.col("node"))).alias("near_id")).where("near_id is not null")
    return found.groupBy("doc_id").agg(F.min("near_id").alias("near_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_id: a row per row."""
    prints = neighbour_prints(docs)
    near = written(band_links(prints, docs), "near")
    if near.count() <= BROADCAST_IDS:
        near = F.broadcast(near)
    return prints.join(near, "doc_id", "left").select(*readable(prints), "near_id")
