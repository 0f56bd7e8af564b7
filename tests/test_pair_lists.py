"""Pairs met by lists of items: few rows meet, the pairs and their likenesses are those of single pairs; runs lie in few files."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airlens.functions.text import dot
from airlens.operators import pivots as pv, stories as st

SCHEMA = "item_id long, minute long, embedding array<float>"


def made(seed, many, minutes):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, 8))
    return [(i, int(r.integers(0, minutes)), [float(x) for x in centres[r.integers(9)] + 0.4 * r.normal(size=8)]) for i in range(many)]


@pytest.mark.parametrize("threshold", [-2.0, 0.25, 0.83])
@pytest.mark.parametrize("block, at_once", [(1, 1), (7, 50), (128, 1 << 20)])
def test_same_pairs_and_likenesses(spark, monkeypatch, threshold, block, at_once):
    monkeypatch.setattr(pv, "BLOCK", block)
    monkeypatch.setattr(pv, "AT_ONCE", at_once)
    df = spark.createDataFrame(made(1, 160, 900), SCHEMA)
    got = {(r.a, r.b): r.similarity for r in pv.similar_pairs(df, threshold, 250).collect()}
    y = df.toDF("b", "m", "v")
    norm = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    pairs = df.join(y, (F.col("item_id") < F.col("b")) & (F.abs(F.col("m") - F.col("minute")) <= 250)).select("item_id", "b", (dot(F.col("embedding"), F.col("v")) / (norm("embedding") * norm("v"))).alias("likeness"))
    assert got == {(r.item_id, r.b): r.likeness for r in pairs.where(F.col("likeness") >= threshold).collect()}


def test_few_rows_meet(spark, monkeypatch):
    """2,000 items of one window at a wide reach: some thousand rows of lists meet, not two million pairs."""

    def counted(*_):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([0]), pa.array([2.0])], names=["x", "y", "similarity"])

        return run

    monkeypatch.setattr(pv, "_met", counted)
    df = spark.createDataFrame(made(2, 2_000, 1_000), SCHEMA)
    assert 0 < pv.similar_pairs(df, 0.25, 100_000).agg(F.sum("b")).first()[0] < 4_000


def test_runs_lie_in_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(st, "RUN", 50)
    monkeypatch.setattr(st, "shared_folder", lambda spark: str(tmp_path))
    rows = [(i, m, v, i % 2) for i, m, v in made(3, 2_000, 3_000)]
    df = spark.createDataFrame(rows, SCHEMA + ", component long").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert st.stories_by_runs(df, 0.8, 400).count() == 2_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    runs = len(glob.glob(f"{tmp_path}/stories-*/run=*"))
    files = [f for f in glob.glob(f"{tmp_path}/stories-*/run=*/*.parquet") if "-found" not in f]
    assert runs >= 19 and len(files) <= runs + 8
