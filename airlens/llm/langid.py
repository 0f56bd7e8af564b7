"""Language of a text by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is a language's PROFILE most frequent character n-grams (one to three letters, words padded by a
blank), in order. A text is given the language whose profile its own most frequent n-grams are least out of
place in: the sum over them of the difference of ranks, PROFILE where the profile lacks one.

score: 1 - distance / the largest possible distance, times the share of the text's n-grams that the nearest
profile knows; 0 for a text in none of the learned languages. A null text or one without letters has language
`und` and score 0. Ties go to the alphabetically first language. Without learned languages all are `und`.

Texts are read whole, whatever their length. Rows that repeat are predicted each; extra columns are ignored (or kept as
they are, by `known`); an empty table teaches no language and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import in_training, slices, small_batches, trimmed, written

PROFILE = 400
#: Learned from this many texts of each language at most, those of the smallest hash of the id.
LEARN_TEXTS = 1500
UNKNOWN = "und"
#: A text that scores less is in none of the learned languages, for a filter. Of 6,000 documents none scores under 0.23;
#: sentences in ten other languages score 0.16 at most.
MIN_SCORE = 0.18
#: The sample's ids (LEARN_TEXTS a language) are broadcast up to so many (16 MB); beyond, they are joined.
BROADCAST_IDS = 1_000_000

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, itself where it is a letter, else 0; built once a worker."""
    if not _letter:
        _letter.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.int64, 0x110000))
    return _letter[0]


def ngrams(text: str) -> np.ndarray:
    """The text's n-grams, each coded as up to three code points of 21 bits; a word's edge counts as a blank (1)."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.zeros(len(code) + 2, np.int64)
    x[1:-1] = _letters()[code]
    x = x[np.append((x[1:] > 0) | (x[:-1] > 0), True)]  # one blank between words
    if len(x) < 2:
        return x[:0]
    solid = x > 0
    y = np.where(solid, x, 1)
    two = (y[:-1] << 21) | y[1:]
    three = (two[:-1] << 21) | y[2:]
    return np.concatenate([y[solid], two[solid[:-1] | solid[1:]], three[solid[1:-1]]])


def _ranked(text: str) -> np.ndarray:
    """Distinct n-grams, the most frequent first, ties by code: PROFILE at most."""
    got = np.sort(ngrams(text))
    if not len(got):
        return got
    begin = np.flatnonzero(np.append(True, got[1:] != got[:-1]))
    count = np.diff(np.append(begin, len(got)))
    return got[begin[np.argsort(-count, kind="stable")[:PROFILE]]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, for a slice of the rows at a time."""
    for batch in batches:
        for part in slices(batch, "text"):
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                own.setdefault(lang, []).append(ngrams(text or ""))
            for lang, parts in own.items():
                gram, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(count)], names=["lang", "gram", "n"])


def learn(docs: DataFrame, texts: int = LEARN_TEXTS) -> dict[str, list[int]]:
    """Profiles from rows with a language in the training part: language -> n-grams in order of rank. Two scans of docs:
    one of ids and languages, one of the sample's texts. The driver gets PROFILE rows a language."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & in_training()).select(F.col("doc_id").cast("long"), "lang").withColumn("at", F.xxhash64("doc_id"))
    # The first ids of each language by their hash: of each of 64 parts first, so that no language meets in one task.
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("at", F.lit(64))).orderBy("at", "doc_id"))
    rows = rows.withColumn("rank", part).where(F.col("rank") <= texts)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))).where(F.col("rank") <= texts)
    chosen = written(rows.select("doc_id").distinct(), "language-sample")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    sample = docs.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), "lang", "text").join(chosen, "doc_id", "left_semi").select("lang", "text")
    counts = sample.mapInArrow(trimmed(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.collect():
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(rows)] for lang, rows in sorted(profiles.items())}


def _predict(profiles: dict[str, list[int]]):
    names = sorted(profiles)
    known = np.unique(np.concatenate([np.asarray(p, np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
    ranks = np.full((len(known) + 1, len(names)), -1, np.int64)  # the last row is for n-grams that no profile has
    for k, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), k] = np.arange(len(profiles[name]))

    def one(text: str | None) -> tuple[str, float]:
        own = _ranked(text or "")
        if not len(own) or not names:
            return UNKNOWN, 0.0
        at = np.searchsorted(known, own)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        theirs = ranks[at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own))[:, None]))
        distance = apart.sum(0)
        best = int(distance.argmin())
        near = 1 - distance[best] / (PROFILE * len(own))
        return names[best], float(near * (theirs[:, best] >= 0).mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n != "text"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score; only the text is looked at."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), (~in_training()).alias("held_out"), "text")
    return rows.mapInArrow(trimmed(_predict(profiles)), "doc_id long, held_out boolean, lang_pred string, score double")


def known(docs: DataFrame, profiles: dict[str, list[int]], least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose text has letters and scores `least` or more."""
    small_batches(docs.sparkSession)
    run = _predict(profiles)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (got,) = run(iter([pa.RecordBatch.from_arrays([batch.column("text")], names=["text"])]))
            yield batch.filter(pc.and_(pc.not_equal(got.column("lang_pred"), UNKNOWN), pc.greater_equal(got.column("score"), least)))

    return docs.mapInArrow(trimmed(kept), docs.schema)
