"""Queues with several sinks, counts merged by bucket, state that ends, and the smaller report counts."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airlens.functions.text import custom_id
from airlens.operators import entities as en
from airlens.operators import repeat
from airlens.operators import report as rp
from airlens.operators import search as se
from airlens.sources import ingest as ig
from airlens.streaming import jobs, versioned


def files(spark, path, schema, *parts):
    """A stream of one batch a part."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_consumer_equals_the_batch_form(spark, tmp_path, seed):
    """Results and failures in shuffled batches: outcomes and states as S5 and S6 give them on all messages at once."""
    r = random.Random(seed)
    rows = []
    for k in range(60):
        rec = r.randrange(14)
        body = r.choice([f'{{"recording_id": {rec}, "words_uri": "u"}}'] * 4 + ['{"recording_id": 1', '{"words_uri": "u"}', f'{{"recording_id": {rec}}}'])
        rows.append((k, "result", body, k) if r.random() < 0.7 else (k, "failure", f'{{"recording_id": {rec}, "error": "e{k}"}}', k))
    r.shuffle(rows)
    schema = "message_id long, kind string, body string, at long"
    known = spark.createDataFrame([(i,) for i in range(12)] * 2, "rec_id long")
    done = spark.createDataFrame([(3,), (3,), (4,)], "rec_id long")
    recordings = known.distinct().withColumn("estado", F.when(F.col("rec_id").isin(3, 4), "procesada").otherwise("procesando"))
    base = str(tmp_path / "base")
    jobs.consumed(files(spark, str(tmp_path / "in"), schema, rows[:20], rows[20:35], rows[35:]), known, done, base)
    batch = spark.createDataFrame(rows, schema)
    results = ig.ingest_results(batch.where("kind = 'result'"), known, done)
    count = lambda df: Counter((x.rec_id, x.outcome) for x in df.collect())
    assert count(jobs.consumed_outcomes(spark, base)) == count(results)
    fresh = {x.rec_id for x in results.where("outcome = 'procesada'").collect()}
    now = recordings.withColumn("estado", F.when(F.col("rec_id").isin(*fresh), "procesada").otherwise(F.col("estado")))
    want = {x.rec_id: (x.estado, x.error_mensaje) for x in ig.ingest_failures(batch.where("kind = 'failure'"), now).collect()}
    got = {x.rec_id: (x.estado, x.error_mensaje) for x in jobs.recording_states(spark, base, recordings).collect()}
    assert {k: v for k, v in got.items() if k in want} == want and set(got) == set(want) | fresh


def test_second_batch_writes_only_what_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "counts"), "k string, n long"
    first = versioned.merge(spark.createDataFrame([(f"k{i}", i) for i in range(200)], schema), 0, path, "k", 16)
    change = spark.createDataFrame([("k3", 99), ("new", 1)], schema)
    second = versioned.merge(change, 1, path, "k", 16)
    assert len(first) == 16 and 1 <= len(second) <= 2
    assert len(list((tmp_path / "counts" / "v=1").glob("bucket=*"))) == len(second)
    want = {f"k{i}": i for i in range(200)} | {"k3": 99, "new": 1}
    assert {r.k: r.n for r in versioned.latest(spark, path, schema).collect()} == want
    assert versioned.merge(change, 1, path, "k", 16) == second  # run again after a failure
    assert {r.k: r.n for r in versioned.latest(spark, path, schema).collect()} == want
    versioned.merge(change.limit(0), 2, path, "k", 16)
    assert {r.k: r.n for r in versioned.latest(spark, path, schema).collect()} == want


def test_merged_counts_over_batches(spark, tmp_path):
    rows = [("a", 1), ("b", 1), ("a", 2), ("c", 3), ("a", 3), ("b", 4)]
    stream = files(spark, str(tmp_path / "in"), "huella string, rec_id long", rows[:2], rows[2:4], rows[4:])
    path = str(tmp_path / "out")
    jobs.merged_counts(jobs.running_counts(stream), path)
    assert {r.huella: r.recordings for r in versioned.latest(spark, path, "huella string, recordings long").collect()} == {"a": 3, "b": 2, "c": 1}


def test_state_of_reviews_ends(spark, tmp_path):
    """48 hours after a decision nothing is held; an item that is pending again holds nothing; a late command is a row."""
    t0 = datetime(2024, 1, 1)
    at = lambda hours: t0 + timedelta(hours=hours)
    schema = "ts timestamp, news_id long, event_id long, action string, who string"
    parts = [
        [(at(0), n, 10 * n, "start", "u") for n in range(5)] + [(at(0.2), n, 10 * n + 1, "approve", "u") for n in range(4)],
        [(at(30), 90, 900, "start", "u")], [(at(100), 91, 910, "start", "u")], [(at(1), 92, 920, "start", "u"), (at(101), 93, 930, "nonsense", "u")], [(at(102), 94, 940, "nonsense", "u")],
    ]
    stream = files(spark, str(tmp_path / "in"), schema, *parts)
    sizes, base = [], str(tmp_path / "out")
    query = jobs.review_machine(stream).writeStream.outputMode("append").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).format("parquet").option("path", f"{base}/o").start()
    query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(sizes) >= 5 and sizes[-1] <= 2
    applied = spark.read.parquet(f"{base}/o")
    commands = spark.createDataFrame([x for part in parts for x in part], schema)
    assert [(r.event_id, r.reason) for r in jobs.rejected(commands, applied).collect()] == [(920, "late")]


def test_state_of_topics_ends(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    row = lambda i, hours, topic: (i, topic, int(60 * hours), [1.0, float(i % 3)], t0 + timedelta(hours=hours))
    schema = "item_id long, topic long, minute long, embedding array<double>, ts timestamp"
    stream = files(spark, str(tmp_path / "in"), schema, [row(i, i, i) for i in range(6)], [row(10, 200, 50)], [row(11, 201, 50)], [row(12, 202, 50)])
    query = jobs.online_stories(stream, 0.6).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "o")).start()
    query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(sizes) >= 6 and sizes[-1] == 1
    assert spark.read.parquet(str(tmp_path / "o")).count() == 9


def test_queue_sizes(spark):
    r = random.Random(3)
    rows = [(c := r.randrange(1440 * 1200), r.choice([None, c + r.randrange(5000)])) for _ in range(400)]
    got = {x.day: x.queue for x in rp.queue_sizes(spark.createDataFrame(rows, "created long, reviewed long")).collect()}
    days = sorted({c // 1440 for c, _ in rows} | {v // 1440 for _, v in rows if v is not None})
    assert got == {d: sum(c // 1440 <= d for c, _ in rows) - sum(v is not None and v // 1440 <= d for _, v in rows) for d in days}
    assert rp.queue_sizes(spark.createDataFrame([], "created long, reviewed long")).collect() == []


def test_coverage_counts(spark):
    rows = [(0, 0, 0, 0), (4, 2, 1, 0), (4, 3, 3, 3), (2, 2, 1, 0)]
    got = sorted(tuple(r) for r in repeat.coverage_counts(spark.createDataFrame(rows, "windows long, in_2 long, in_3 long, in_5 long")).collect())
    assert got == [(2, 4, 1, 3, 2), (3, 4, 1, 2, 1), (5, 4, 1, 1, 1)]


def test_request_ids_have_sixty_four_letters_at_most(spark):
    ids = lambda n: spark.createDataFrame([("x" * n, 12)], "r string, c int").select(custom_id(F.col("r"), F.col("c")).alias("i")).collect()[0].i
    assert ids(60) == "x" * 60 + "__12"
    with pytest.raises(Exception, match="request id too long"):
        ids(61)


def test_entity_search_with_resolved_names(spark):
    """E5 links the names, E3 resolves spellings and acronyms, the search intersects their postings."""
    v = [("v1", ["Ana Maria Lopez Zelaya"], ["Banco Central de Hondo"]), ("v2", ["Ana Maria Lopes Zelaya"], ["BCH"]), ("v3", ["ana maría lópez zelaya"], []), ("v4", ["Luis Paz"], ["banco central de hondo"])]
    versions = spark.createDataFrame([(*x, []) for x in v], "version_id string, people array<string>, organizations array<string>, locations array<string>")
    links = en.entity_links(versions, versions.limit(0))
    mentions = spark.createDataFrame([("persona", "Ana Maria Lopez Zelaya", 1), ("persona", "Ana Maria Lopes Zelaya", 2), ("institucion", "Banco Central Hondo", 1), ("institucion", "BCH", 2), ("institucion", "Banco Central de Hondo", 3)], "tipo string, name string, seen long")
    resolved = en.resolve_mentions(mentions)
    news = spark.createDataFrame([("v1", 1, 5), ("v2", 2, 6), ("v3", 3, 7), ("v4", 4, 8)], "version_id string, news_id long, day long")
    postings = se.entity_postings(links, resolved, news)
    find = lambda *w, **k: sorted(r.news_id for r in se.news_naming(postings, spark.createDataFrame(list(w), "tipo string, name string"), resolved, **k).collect())
    assert find(("persona", "ANA MARIA LOPES ZELAYA")) == [1, 2, 3]
    assert find(("persona", "Ana María López Zelaya"), first=F.lit(6), last=F.lit(6)) == [2]
    both = find(("persona", "Ana María López Zelaya"), ("institucion", "BCH"))
    assert 2 in both and 4 not in both and 3 not in both
    notes = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, "a", "y")], "news_id long, medio string, tone string")
    got = sorted(map(tuple, se.faceted_search(notes, postings, spark.createDataFrame([("persona", "Ana María López Zelaya")], "tipo string, name string"), resolved, ["medio", "tone"]).collect()), key=str)
    assert got == sorted([("all", None, 3), ("medio", "a", 1), ("medio", "b", 1), ("medio", None, 1), ("tone", "x", 2), ("tone", "y", 1)], key=str)
