"""Toxic documents by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features of a text, each once: its words, pairs of neighbouring words, and pairs with one or two words between
(a word is lower-cased, and only its letters and bytes of other scripts count), hashed into 2**BITS. FTRL-
proximal (McMahan and others, 2013) gives every coordinate its own learning rate and sets small weights to
exactly 0, so the model is a short list of weights; it has at most 2**BITS, 4 MB as numbers, and is broadcast.

Learning takes labelled rows of the training part, those of the smallest hash of the id: at most LEARN_ROWS of them
and at most LEARN_FEATURES features together, as lists of features, in one task (120 MB). A feature in so few rows that
its z can't pass L1 in all passes (each adds 1 at most) keeps the weight 0 and is left out beforehand.

A null or empty text has no features and gets the score of the intercept. Texts are read whole, whatever their length.
Rows that repeat are scored each; an id labelled twice counts as toxic if one label says so. Without labels the model is
empty and every score is 0. Extra columns are ignored (or kept as they are, by `clean`); an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import in_training, slices, small_batches, trimmed, written
from airlens.llm.shingles import _BASE, U, buffers, mix, words

BITS = 20
LEARN_ROWS, LEARN_FEATURES = 12_000, 30_000_000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
PASSES = 3

_KEEP = np.zeros(256, bool)
_KEEP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of many texts, and the text that each is of; with repeats."""
    found = words(raw, offsets, _KEEP)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
    keep = found.hashes != mix(np.zeros(1, U))[0]  # words without a letter
    h, of = found.hashes[keep], of[keep]
    parts, owners = [h], [of]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = of[gap:] == of[:-gap]
            parts.append(mix(h[:-gap] * U(_BASE) + h[gap:] + U(gap))[same])
            owners.append(of[gap:][same])
    return (np.concatenate(parts) >> U(64 - BITS)).astype(np.int32), np.concatenate(owners)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            feature, of = _features(*buffers(part.column("text")))
            both = np.unique((of.astype(np.int64) << 32) | feature)
            first = np.searchsorted(both >> 32, np.arange(part.num_rows + 1))
            rows = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array((both & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), rows], names=["doc_id", "toxic", "features"])


class Model(NamedTuple):
    feature: np.ndarray
    weight: np.ndarray
    intercept: float


def ftrl(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> Model:
    """One example after another; z and n are the two sums that FTRL-proximal keeps of each coordinate."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    intercept = 1 << BITS
    rows = [np.append(x, intercept) for x in rows]

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        l1 = np.where(at == intercept, 0.0, L1)
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for x, y in zip(rows, labels):
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
    at = np.flatnonzero(np.abs(z[:intercept]) > L1)
    return Model(at.astype(np.int32), weights(at), float(weights(np.array([intercept]))[0]))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, rows, labels = [], [], []
    count = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        labels += batch.column("toxic").to_pylist()
        own = [np.array(x, np.int32) for x in batch.column("features").to_numpy(zero_copy_only=False)]
        for x in own:  # a text has each feature once
            count[x] += 1
        rows += own
    if not rows:
        return
    rows = [x[PASSES * count[x] > L1] for x in rows]
    order = np.argsort(mix(np.asarray(ids, np.int64).astype(U)), kind="stable")
    got = ftrl([rows[i] for i in order], np.asarray(labels, float)[order])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(got.feature, -1).astype(np.int32)), pa.array(np.append(got.weight, got.intercept))], names=["feature", "weight"])


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> Model:
    """labels: doc_id, toxic (0 or 1; null rows are left out)."""
    small_batches(docs.sparkSession)
    ids = labels.where(F.col("toxic").isNotNull() & in_training()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("double"))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # LEARN_ROWS rows: a proven bound
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    lists = written(sample.mapInArrow(trimmed(_distinct), "doc_id long, toxic double, features array<int>"), "features")
    # LEARN_ROWS numbers (and repeated ids) in one window tell how far the features reach.
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rangeBetween(Window.unboundedPreceding, 0))
    taken = lists.select("doc_id", F.size("features").cast("long").alias("n")).withColumn("upto", upto).where(F.col("upto") <= LEARN_FEATURES)
    got = lists.join(F.broadcast(taken.select("doc_id").distinct()), "doc_id", "left_semi").repartition(1).mapInArrow(trimmed(_fit), "feature int, weight double").toPandas()
    if got.empty:
        return Model(np.zeros(0, np.int32), np.zeros(0), -30.0)
    rest = got[got.feature >= 0]
    return Model(rest.feature.to_numpy(np.int32), rest.weight.to_numpy(), float(got.weight[got.feature < 0].iloc[0]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[model.feature] = model.weight
        for batch in batches:
            for part in slices(batch, "text"):
                feature, of = _features(*buffers(part.column("text")))
                heavy = dense[feature] != 0
                both = np.unique((of[heavy].astype(np.int64) << 32) | feature[heavy])
                logit = model.intercept + np.bincount(both >> 32, dense[both & 0xFFFFFFFF], part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                others = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in others), pa.array(score)], names=[*others, "toxicity"])

    return run


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    small_batches(docs.sparkSession)
    run = _score(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                only = pa.RecordBatch.from_arrays([part.column("text")], names=["text"])
                score = pa.Table.from_batches(run(iter([only]))).column("toxicity").combine_chunks()
                yield part.filter(pc.less(score, threshold))

    return docs.mapInArrow(trimmed(kept), docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on); only the text is looked at."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), (~in_training()).alias("held_out"), "text")
    got = rows.mapInArrow(trimmed(_score(model)), "doc_id long, held_out boolean, toxicity double")
    return got.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
