"""What the third review found: queries against their SQL on documents made for the fault, and what a plan must not hold."""

import random

import duckdb
import pytest

from airlens.plans.registry import QUERIES, SQL

from tests.test_oracle import rows


def same_as_sql(spark, folder, name, texts):
    data = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(SQL[name])
    assert got == rows([c[0] for c in want.description], want.fetchall()) and got
    return got


@pytest.mark.parametrize("name", ["e5_entity_links", "e6_top_terms"])
def test_titles_inside_a_hyphenated_name_stay(spark, tmp_path, name):
    got = same_as_sql(spark, tmp_path, name, ["", "La-hhmc vio El-Dr en Casa ayer", "Don vio a La-Paz por la Sra tarde"])
    assert "la hhmc" in str(got)


def test_entity_search_keeps_titles_inside_names(spark, tmp_path):
    texts = [""] * 60 + ["La-The in casa verde ahora", "The in casa verde ahora", "La-The in casa roja ahora"]
    assert ("all", 1) in [(r[0], r[1]) for r in same_as_sql(spark, tmp_path, "q17_entity_search", texts)]


def test_rounds_of_leaders_write_vectors_twice_at_most(spark, tmp_path, monkeypatch):
    """Many rounds, nearly all of them leaders: what is on disk doesn't grow with the rounds."""
    import os

    from airlens.operators import leaders as ld

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/checkpoints")
    monkeypatch.setattr(ld, "shared_folder", lambda spark: f"file://{tmp_path}", raising=False)
    monkeypatch.setattr(ld, "FIRST", 10)
    monkeypatch.setattr(ld, "MOST", 10)
    r = random.Random(1)
    rows = [(i, sorted(r.sample(range(1 << 60), 400)), [r.uniform(0.04, 0.06) for _ in range(400)]) for i in range(120)]
    got = ld.leader_clusters(spark.createDataFrame(rows, "id long, tokens array<long>, weights array<double>"), 0.5).collect()
    assert {r.id: r.leader for r in got} == {i: i for i in range(120)}
    written = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files)
    assert written < 2.5 * 120 * 400 * 16


def test_keys_with_frequent_words_dont_meet(spark):
    """Keys that share two frequent words and no more are no candidates; near ones are."""
    from pyspark.sql import functions as F

    from airlens.operators import entities as en

    r = random.Random(2)
    keys = list({"the and " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(300)})
    frame = spark.createDataFrame([("p", k, i, len(k)) for i, k in enumerate([*keys, keys[0] + "s", keys[1][:-1]])], "tipo string, key string, seen long, n int")
    got = {(x.x, x.y) for x in en._by_halves(frame, lambda both: F.floor(0.08 * both + 1e-9).cast("int")).collect()}
    assert {(keys[0], keys[0] + "s"), (keys[1][:-1], keys[1])} <= got and len(got) < 50


@pytest.mark.parametrize("name, word", [("s4_load_words", "Exchange"), ("u2_distil_then_segment", "posexplode"), ("d1_normalize_partition", "Join"), ("v10_pairwise_agreement", "Join"), ("v11_unanimity", "Join"), ("v13_disagreement_groups", "Join"), ("v14_category_terms", "Join")])
def test_plans_hold_no_step_that_grew(spark, sf, name, word):
    assert word not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
