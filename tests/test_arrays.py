"""Transcripts as arrays: equal to the forms with a row a word, and no row a word in any plan."""

import random

import pytest
from pyspark.sql import functions as F

from airlens.operators import arrays as ar
from airlens.operators import evaluate as ev
from airlens.operators import words as w

_WORDS = "rec_id long, index int, word string, start double, end double"


def made(spark, seed=1, gaps=True):
    r = random.Random(seed)
    rows = [(rec, i, f"w{i}", i * 0.3, i * 0.3 + 0.28) for rec in range(12) for i in range(r.choice([1, 5, 40, 130])) if not gaps or r.random() < 0.8]
    return spark.createDataFrame(rows, _WORDS)


def ranges(spark, seed=2):
    r = random.Random(seed)
    rows = [(rec, lo, lo + r.randrange(-2, 25)) for rec in range(13) for lo in (r.randrange(-3, 120) for _ in range(r.randrange(6)))]
    return spark.createDataFrame(rows, "rec_id long, lo int, hi int")


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


@pytest.mark.parametrize("gaps", [True, False])
def test_equal_to_rows_of_words(spark, gaps):
    words, gone = made(spark, 3, gaps), ranges(spark)
    arrays = ar.from_words(words)
    left_rows, left_arrays = w.filter_words(words, gone), ar.filter_transcripts(arrays, gone)
    counted = left_rows.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_words"), F.min("index").alias("first_word"), F.max("index").alias("last_word"), F.sum("index").alias("index_sum"))
    same(counted, ar.word_counts(left_arrays))
    segments = gone.select("rec_id", F.monotonically_increasing_id().alias("seg"), F.col("lo").alias("start_word"), F.col("hi").alias("end_word"))
    segments = spark.createDataFrame(segments.collect(), segments.schema)
    same(w.segment_text_times(segments, words), ar.segment_texts(segments, arrays))
    same(w.segment_text_times(segments, left_rows), ar.segment_texts(segments, left_arrays))
    for size in (1, 7, 600):
        same(w.chunk_words(left_rows, size), ar.chunks(left_arrays, size))
        same(w.build_requests(left_rows, size, 3), ar.requests(left_arrays, size, 3))
    news = segments.select("rec_id", "seg", F.lit("m").alias("medio"), F.lit("c").alias("categoria"), (F.col("start_word") * 0.3).alias("inicio"), (F.col("end_word") * 0.3 + 4.1).alias("fin"))
    # Times are asked for of all words here, for a place without a word has none.
    if not gaps:
        same(ev.policy_damage(words, news, gone.where("lo <= hi")), ar.policy_damage(arrays, news, gone))


def test_merged_ranges(spark):
    rows = [(1, 5, 9), (1, 0, 3), (1, 4, 4), (1, 20, 30), (1, 22, 25), (1, 33, 32), (2, 7, 7)]
    got = {r.rec_id: [tuple(x) for x in r.gone] for r in ar.merged_ranges(spark.createDataFrame(rows, "rec_id long, lo int, hi int")).collect()}
    assert got == {1: [(0, 9), (20, 30)], 2: [(7, 7)]}


def test_empty_and_all_gone(spark):
    t = spark.createDataFrame([(1, []), (2, ["a", "b"]), (3, None)], "rec_id long, words array<string>")
    gone = spark.createDataFrame([(2, -5, 90)], "rec_id long, lo int, hi int")
    assert ar.word_counts(ar.filter_transcripts(t, gone)).collect() == []
    assert [tuple(r) for r in ar.chunks(t).collect()] == [(2, 0, 0, 1, 2)]
    with pytest.raises(ValueError):
        ar.chunks(t, 0)


def test_below(spark):
    values = [0.0, 0.3, 0.3, 0.9, 5.0]
    rows = [(values[:n], x / 10) for n in range(6) for x in range(-1, 60)]
    df = spark.createDataFrame(rows, "v array<double>, x double").select("v", "x", ar.below(F.col("v"), F.col("x")).alias("a"), ar.below(F.col("v"), F.col("x"), equal=True).alias("b"))
    assert all(r.a == sum(v < r.x for v in r.v) and r.b == sum(v <= r.x for v in r.v) for r in df.collect())


def test_no_row_a_word(spark, sf):
    """Words are never exploded, and a transcript is shuffled once at most."""
    from airlens.plans.registry import QUERIES

    for name in ("t1_chunk_words", "t2_build_requests", "t7_segment_text_times", "t10_materialise_news", "t14_filter_words", "r2_literal_text", "v18_policy_regression"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode(words" not in plan and "explode(sequence(start_word" not in plan and "explode(sequence(lo" not in plan, name
