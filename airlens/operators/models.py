"""Pluggable scorers over partitions, with retries, a second scorer to fall back on, and failures as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.operators.arrays import filter_transcripts
from airlens.operators.words import filter_words


class Transient(Exception):
    """Worth another attempt."""


class LengthScorer:
    """A deterministic scorer for tests and demonstrations: the summary's length modulo 7."""

    def __init__(self, add: float = 0.0, fail_on: Callable[[dict], bool] | None = None):
        self.add, self.fail_on = add, fail_on

    def __call__(self, row: dict) -> float:
        if self.fail_on and self.fail_on(row):
            raise ValueError("refused")
        return len(row["summary"]) % 7 + self.add


def attempt(fn: Callable[[dict], float], row: dict, waits: tuple[float, ...]) -> float:
    """Three attempts by default: waits between them after transient errors; other errors end it at once."""
    for wait in (*waits, None):
        try:
            return fn(row)
        except Transient:
            if wait is None:
                raise
            time.sleep(wait)
    raise AssertionError


def apply_model(rows: DataFrame, fn: Callable[[dict], float], fallback: Callable[[dict], float] | None = None, waits: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """rows with score, via (model, fallback or failed) and error, by Arrow batches; scorers are any callables of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for row in batch.to_dict("records"):
                error = None
                for via, scorer in (("model", fn), ("fallback", fallback)):
                    if scorer is None:
                        continue
                    try:
                        got.append((float(attempt(scorer, row, waits)), via, error))
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a scorer becomes a row
                        error = f"{type(e).__name__}: {e}"
                else:
                    got.append((None, "failed", error))
            yield batch.assign(score=[x[0] for x in got], via=[x[1] for x in got], error=[x[2] for x in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, score double, via string, error string")


def _junk_ranges(blocks: DataFrame, threshold: float) -> DataFrame:
    junk = blocks.where(~F.coalesce("failed", F.lit(False)) & F.col("tipo").isin("publicidad", "musica") & (F.col("confidence") >= threshold))
    return junk.select("rec_id", F.col("start_word").alias("lo"), F.col("end_word").alias("hi"))


def distil(words: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """The words left for segmentation: without adverts and music of at least that confidence; recordings whose
    classification failed keep all their words."""
    return filter_words(words, _junk_ranges(blocks, threshold))


def distil_transcripts(transcripts: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """The same for transcripts as arrays: `kept` has what is left."""
    return filter_transcripts(transcripts, _junk_ranges(blocks, threshold))
