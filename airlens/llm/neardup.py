"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets.

1. Signatures: each document's distinct five-word shingles, 384 universal hashes; the minima of the first 64
   keep 16 bits, the others 8. Documents with equal shingle sets are one node from here on.
2. Multi-index: the first 64 components form 16 chunks of four. Two signatures that differ in at most
   MAX_DIFFER = 31 of 64 have, by pigeonhole, a chunk with at most one error. Every chunk is therefore
   entered under the four keys that leave one component out, which enumerates the allowed errors: all pairs
   under the threshold share a key. At a Jaccard likeness of 0.75 a pair differs in 16 on average and in more
   than 31 once in 100,000 pairs.
3. First round: in each key's bucket the most central node (the one in the fullest buckets) is compared with
   the others, each node with its best leader only; confirmed links give first components.
4. Second round: in buckets that still hold several components, every node outside the bucket's largest component is
   compared with all others, in units of bounded size (crowds.py), one pair in one bucket only; what passes the
   distance on all 384 components is confirmed on full sets. No pair under the threshold between different
   components is left out, and pairs inside a component are not needed.
5. Components by alternating large-star and small-star steps, each written to the shared folder.

Nulls and texts without words have no shingles, link with nothing and are their own component. Rows that
repeat a doc_id are one document, linked with whatever one of its texts is linked with. A row without a doc_id is no
node: it gets the component of the documents with its shingle set, or none and stays. Ties go to the smallest id.
Very long texts are read whole, a slice of rows at a time. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import slices, small_batches, split_join, trimmed, written
from airlens.llm.crowds import buckets, candidates, confirmed, in_units, listed, with_bucket
from airlens.llm.shingles import U, buffers, minhash, mix, set_digests, shingles, words

EXACT, CHUNK = 64, 4  # components under the index; components of a chunk
COMPONENTS = 384
MAX_DIFFER = 2 * (EXACT // CHUNK) - 1
#: Mean of 0.249 * 384 differing components at likeness 0.75, and nearly six standard deviations more: a pair differs in
#: more once in 100,000,000, far less often than the index misses it.
MAX_DIFFER_ALL = 145

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sig", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = shingles(words(*buffers(part.column("text"))))
            minima = minhash(found, COMPONENTS)
            low, rest = minima[:, :EXACT].astype("<u2"), minima[:, EXACT:].astype(np.uint8)
            a, b, size = set_digests(found)
            sig = [low[i].tobytes() + rest[i].tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(a), pa.array(b), pa.array(sig, pa.binary())], schema=_SIGNED)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (equal for equal sets, and together only then), sig."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(_sign), "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def _matrix(sigs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(len(sigs), -1)
    return np.ascontiguousarray(raw[:, : 2 * EXACT]).view("<u2"), raw[:, 2 * EXACT :]


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        low = _matrix(batch.column("sig"))[0].astype(U)
        keys = np.empty((batch.num_rows, EXACT), np.int64)
        for slot in range(EXACT):
            chunk, gap = divmod(slot, CHUNK)
            a, b, c = (low[:, chunk * CHUNK + k] for k in range(CHUNK) if k != gap)
            keys[:, slot] = mix((((a << U(16) | b) << U(16) | c) << U(8)) + U(slot)).astype(np.int64)
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), EXACT)
        slot = np.tile(np.arange(EXACT, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(slot), pa.array(node)], names=["key", "slot", "node"])


def index_keys(nodes: DataFrame) -> DataFrame:
    """key, slot, node: 64 rows for each row of nodes (node, sig)."""
    return nodes.select("node", "sig").mapInArrow(trimmed(_enter), "key long, slot int, node long")


def _close(unit: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs within both distances whose first common key is this bucket's: the pair comes from there only."""
    low, rest = _matrix(unit.column("sig"))
    same = (low[x] == low[y]).reshape(len(x), EXACT // CHUNK, CHUNK)
    hits = same.sum(2, dtype=np.uint8)
    chunk = (hits >= CHUNK - 1).argmax(1)
    gap = (~same[np.arange(len(x)), chunk]).argmax(1)
    ok = np.flatnonzero(chunk * CHUNK + gap == unit.column("slot")[0].as_py())
    differ = EXACT - hits[ok].sum(1, dtype=np.int64) + (rest[x[ok]] != rest[y[ok]]).sum(1, dtype=np.int64)
    out = np.zeros(len(x), bool)
    out[ok[differ <= MAX_DIFFER_ALL]] = True
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for all nodes of edges (a, b)."""
    edges = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        # Large star: all larger neighbours of a node to the smallest of its neighbours and itself.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v"), F.col("m").alias("u")).where("u < v").distinct()
        large = written(large, "large")
        # Small star: all smaller neighbours of a node, and itself, to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).union(joined.select(F.col("m").alias("u"), "v")).where("u < v").distinct()
        edges = written(small, "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id): a row per row."""
    sigs = written(signatures(docs), "signatures")
    sets = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"), F.count(F.lit(1)).alias("rows"))
    nodes = written(sets.select("set_a", "set_b", "rows", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.sig").alias("sig")), "nodes")

    # Rows whose set is their own or is met first under their id are nodes; the others are sent to theirs.
    some = sigs.where("n_shingles > 0")
    member = split_join(some.select("doc_id", "n_shingles", "set_a", "set_b"), nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"], "doc_id", sigs.count(), "left")
    member = written(member.select("doc_id", "n_shingles", "node"), "members")
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    own = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a < b").distinct()

    shared = buckets(nodes, index_keys, ["key", "slot"], "buckets").drop("first")
    rows = shared.count()
    central = shared.groupBy("node").agg(F.sum("n").alias("central"))
    star = with_bucket(shared.join(central, "node"), ["key", "slot"], rows, F.max(F.struct("central", (-F.col("node")).alias("less"))).alias("_lead"))
    star = star.withColumn("leader", -F.col("_lead.less")).where("leader <> node")
    best = star.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(F.max(F.struct("m", (-F.col("leader")).alias("less"))).alias("x"))
    pairs = written(best.select((-F.col("x.less")).alias("a"), F.col("node").alias("b")), "pairs")
    links = confirmed(written(listed(pairs), "lists"), docs).union(own)
    links = written(links, "links")

    known = components(links)
    held = shared.join(known, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    per = held.groupBy("key", "slot", "comp").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key", "slot").agg(F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    held = split_join(held, per.select("key", "slot", "most"), ["key", "slot"], "node", rows)
    held = held.withColumns({"open": F.col("comp") != F.col("most.comp"), "m": F.col("n") - F.col("most.c")}).join(nodes.select("node", "n_shingles", "sig"), "node")
    units = in_units(held, ["key", "slot"], ["comp", "n_shingles", "sig"])
    links = links.union(confirmed(written(candidates(units, ["key", "slot"], _close), "more"), docs))

    final = components(links)
    out = member.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    none = sigs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
