"""Ranked lexical search: the TOP = 20 best documents of every item of a query set, over all documents.

1. Items are taken in blocks of at most BLOCK_TERMS distinct terms together (an item of more is a block of its own), so what a task
   is sent is bounded, whatever the number of items. All documents are searched for each block.
2. Postings. One pass over the texts keeps, of each document, its number of terms and the block's terms in it with their counts, as a
   table. Terms are compared by 64-bit hashes of their bytes. Numbers of documents and terms, and of documents by term, are sums over it.
3. Presence masks. A task goes through its documents in slices and, for each item, groups them by their mask: one bit for each of
   the item's terms, packed from the slice's bitmap of terms by documents. The most that a mask can score is the sum, over its
   terms, of the most that the term scores in any document of the slice. Masks are evaluated by falling maximum; the rest is left once a
   maximum is below the item's twentieth best score so far in this task. An equal maximum is still evaluated, for a smaller id could win there.
4. Each task gives its twenty best an item; the window that ranks them cuts to twenty before its shuffle as well.

Null texts and texts without terms are found by no item. Rows that repeat are documents of their own; equal scores go by ascending doc_id,
those without one last. Items that repeat with one text are one item; an item without terms gives no rows. Long texts are read whole. Other columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import slices, small_batches, trimmed, written
from airlens.llm.shingles import U, buffers, words

TOP = 20
#: Distinct terms of a block of items; cells of a slice's bitmap (eight bytes each while it is scored); documents scored together.
BLOCK_TERMS, CELLS, CHUNK = 8192, 1 << 22, 64

#: Bytes of terms: 0-9, A-Z, a-z and all of other than ASCII characters; others become spaces.
_TERM = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
_SPACED = np.where(_TERM, np.arange(256), 32).astype(np.uint8)


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and for each text the index of its first one (with the end)."""
    raw, offsets = buffers(column)
    found = words(_SPACED[raw], offsets)
    return found.hashes, found.first


class Block:
    """Items with their terms as places in one sorted vocabulary."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([t for _, t in items])) if items else np.zeros(0, U)
        self.terms, self.times = [], []
        for _, hashes in items:
            own, many = np.unique(hashes, return_counts=True)
            self.terms.append(np.searchsorted(self.vocabulary, own))
            self.times.append(many.astype(np.int64))


def blocks_of(items: DataFrame) -> Iterator[Block]:
    held, seen = [], set()
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").distinct().toLocalIterator():
        hashes = term_hashes(pa.array([text], pa.string()))[0]
        if len(hashes) and held and len(seen | set(hashes.tolist())) > BLOCK_TERMS:
            yield Block(held)
            held, seen = [], set()
        if len(hashes):
            held.append((item_id, hashes))
            seen |= set(hashes.tolist())
    if held:
        yield Block(held)


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n, terms, counts: a row a document; terms are places in the vocabulary, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = term_hashes(part.column("text"))
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == hashes)
                doc = np.searchsorted(first, hit, "right") - 1
                pair, count = np.unique(doc * len(vocabulary) + at[hit], return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(part.num_rows + 1) * len(vocabulary)).astype(np.int32))
                terms, counts = pa.array((pair % len(vocabulary)).astype(np.int32)), pa.array(count.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, counts)], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, terms array<int>, counts array<int>")


def statistics(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and documents by term of the vocabulary: sums by task, then one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            sums[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            sums[size] += np.count_nonzero(n)
            sums[size + 1] += n.sum()
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["term", "many"])

    out = np.zeros(size + 2, np.int64)
    for term, many in found.select("n", "terms").mapInArrow(run, "term long, many long").groupBy("term").agg(F.sum("many")).collect():
        out[term] = many
    return int(out[size]), int(out[size + 1]), out[:size]


class Best:
    """The best scores of one item so far, and their rows."""

    def __init__(self):
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, object)

    @property
    def least(self) -> int:
        """What a document must score at least."""
        return int(self.scores[-1]) if len(self.scores) == TOP else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:TOP]
        self.scores, self.ids = scores[order], ids[order]


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """present: terms by documents. The documents that have some, ordered by mask; where each mask begins, and its bits (a row a mask)."""
    packed = np.packbits(present, axis=0)
    if len(packed) % 8:
        packed = np.vstack([packed, np.zeros((8 - len(packed) % 8, packed.shape[1]), np.uint8)])
    columns = np.ascontiguousarray(packed.T).view(U).T  # 64 terms each
    some = np.flatnonzero(columns.any(axis=0))
    order = some[np.lexsort(columns[:, some])]
    sorted_ = columns[:, order]
    begins = np.flatnonzero(np.append(True, (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, np.int64)
    return order, begins, present[:, order[begins]].T


def search_slice(value: np.ndarray, present: np.ndarray, ids: np.ndarray, block: Block, best: list[Best]) -> int:
    """value: what each term (row) scores in each document (column). Returns how many scores were computed."""
    most, done = value.max(axis=1), 0
    for terms, times, found in zip(block.terms, block.times, best):
        order, begins, bits = masks_of(present[terms])
        if not len(order):
            continue
        bound = bits.astype(np.int64) @ (times * most[terms])
        ends = np.append(begins[1:], len(order))
        by_bound = np.argsort(-bound, kind="stable")
        by_bound = by_bound[bound[by_bound] >= found.least]
        at = 0
        while at < len(by_bound) and bound[by_bound[at]] >= found.least:
            group, size = [], 0
            while at < len(by_bound) and size < CHUNK:
                group.append(order[begins[by_bound[at]] : ends[by_bound[at]]])
                size += len(group[-1])
                at += 1
            docs = np.concatenate(group)
            scores = times @ value[np.ix_(terms, docs)]
            done += len(docs)
            good = np.flatnonzero(scores >= found.least)
            if len(good):
                found.add(scores[good], ids[docs[good]])
    return done


def scored(found: DataFrame, block: Block, documents: int, length: int, by_term: np.ndarray) -> DataFrame:
    """item, doc_id, score: the best of each task."""
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in by_term], np.int64)
    size = len(block.vocabulary)

    def dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column("terms")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64)
        m = 75 + (25 * batch.column("n").to_numpy() * documents) // max(1, length)
        value, present = np.zeros((size, batch.num_rows), np.int64), np.zeros((size, batch.num_rows), bool)
        value[term, doc] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        present[term, doc] = True
        return value, present

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step, held = [Best() for _ in block.ids], max(1, CELLS // size), []
        waiting = 0

        def take() -> None:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                search_slice(*dense(part), np.array(part.column("doc_id").to_pylist(), object), block, best)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            if waiting >= step:
                take()
                held, waiting = [], 0
        if held:
            take()
        item = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        ids, scores = np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids.tolist(), pa.int64()), pa.array(scores)], names=["item", "doc_id", "score"])

    return found.mapInArrow(trimmed(run), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks_of(items):
        found = written(postings(docs, block.vocabulary), "postings")
        best = scored(found, block, *statistics(found, len(block.vocabulary)))
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        ids = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        top = best.withColumn("rank", rank).where(F.col("rank") <= TOP).join(F.broadcast(ids), "item")  # a row an item of the block
        out = out.unionByName(written(top.select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out
