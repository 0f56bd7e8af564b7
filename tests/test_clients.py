"""Reports of many clients: one scan, terms against regular expressions, the report sink; joins with repeated right sides."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from airlens.operators import clients as cl
from airlens.operators import editorial as ed
from airlens.plans import report as plans
from airlens.sources import ingest as ig

_NOTES = "rec_id long, seg int, medio string, momento timestamp_ntz, sentiment string, title string, summary string, people array<string>, keywords array<string>, quote string, texto string"


def notes(spark, many=300, seed=1):
    r = random.Random(seed)
    words = ["agua", "Energía", "Ana", "López", "Juan", "puente", "ley", "de", "marco", "la"]
    rows = []
    for i in range(many):
        line = [r.choice(words) for _ in range(12)]
        title, text = " ".join(line[:4]), " ".join(line)
        rows.append((i // 3, i % 3, f"m{i % 4}", dt.datetime(2024, 1, 31) + dt.timedelta(hours=i % 60), r.choice(["positivo", "negativo", "neutral"]), title, text, ["Ana López de Juan", None][: i % 3], line[4:7], r.choice([None, title, "nobody said so"]), text))
    return spark.createDataFrame(rows, _NOTES)


def terms(spark, many=50):
    r = random.Random(2)
    words = ["agua", "energia", "ana", "lopez", "juan lopez", "puente", "ley de", "marco", "LA", "ana  López", "ñ", " "]
    rows = [(f"c{k:02d}", r.choice(words), r.choice([None, "t1", "t2"])) for k in range(many) for _ in range(3)]
    return spark.createDataFrame([*rows, (None, "agua", None)], "client string, term string, topic string"), rows


def test_hits_match_whole_words(spark):
    table, rows = terms(spark)
    block = next(cl.term_blocks(table))
    plain = lambda t: re.sub(r"\s+", " ", t.lower().replace("ó", "o").replace("í", "i").replace("ñ", "n")).strip()
    df = notes(spark).select(F.concat_ws(" ", "title", "summary").alias("t"))
    got = df.select("t", cl.hits_of(cl.normalize_text(F.col("t")), block).alias("h")).collect()
    for row in got:
        want = {}
        for client, term, topic in rows:
            if plain(term) and re.search(rf"(^| ){re.escape(plain(term))}( |$)", plain(row.t)):
                own = want.setdefault(client, [False, set()])
                own[0] |= topic is None
                own[1] |= {topic} - {None}
        assert [(h.client, h.mention, h.topics) for h in row.h] == [(c, m, sorted(t)) for c, (m, t) in sorted(want.items())]


def test_fifty_clients_from_one_scan(spark, sf):
    block = next(cl.term_blocks(plans._watched(spark, sf)))
    found = cl.cells(cl.tag_clients(plans._client_notes(spark, sf), block), block, (), {})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 or plan.split("Initial Plan")[-1].count("FileScan") == 1
    table, _ = terms(spark)
    got = cl.client_reports(notes(spark), table)
    assert got.select("client").distinct().count() == 50
    # Counts of a client alone are those of the same client among fifty.
    one = cl.client_reports(notes(spark), table.where("client = 'c07'"))
    assert sorted(map(str, one.collect())) == sorted(map(str, got.where("client = 'c07'").collect()))


def test_blocks_of_terms_give_the_same_reports(spark, monkeypatch):
    table, _ = terms(spark, 8)
    want = sorted(map(str, cl.client_reports(notes(spark), table).collect()))
    monkeypatch.setattr(cl, "TERMS", 5)
    assert len(list(cl.term_blocks(table))) > 1
    assert sorted(map(str, cl.client_reports(notes(spark), table).collect())) == want


def test_shares_and_ranks(spark):
    table, _ = terms(spark)
    rows = cl.client_reports(notes(spark), table).collect()
    by = {}
    for r in rows:
        by.setdefault((r.client, r.period, r.section), []).append(r)
    for (client, period, section), own in by.items():
        assert sorted(r.rank for r in own) == list(range(1, len(own) + 1))
        if section == "stations":
            total = by[client, period, "summary"][0]
            assert sum(r.notes for r in own) == total.notes and sum(r.universe for r in own) == total.universe
    assert {r.section for r in rows} == {"summary", "stations", "day", "hour", "axes", "actors", "quotes", "topics", "observations"}


def test_no_terms_and_no_notes(spark):
    table, _ = terms(spark)
    assert cl.client_reports(notes(spark), table.limit(0)).collect() == []
    assert cl.client_reports(notes(spark).limit(0), table).collect() == []


def test_reports_written_twice(spark, tmp_path):
    """A period written again replaces itself and leaves others alone."""
    table, _ = terms(spark, 6)
    got = cl.client_reports(notes(spark), table)
    path = str(tmp_path / "reports")
    cl.write_reports(got, path)
    cl.write_reports(got.where("client = 'c01' and period = '2024-01'").withColumn("notes", F.lit(-1).cast("long")), path)
    back = spark.read.parquet(path)
    assert back.count() == got.count()
    assert {(r.client, r.period) for r in back.where("notes = -1").select("client", "period").distinct().collect()} == {("c01", "2024-01")}


def test_repeated_right_sides(spark):
    keys = spark.createDataFrame([("a/2024/01/2024-01-01T05Z.mp3",)], "s3_key string")
    assert ig.discover_recordings(keys, spark.createDataFrame([("a",)], "station string"), keys.union(keys)).count() == 1
    message = spark.createDataFrame([(1, '{"recording_id": 7, "words_uri": "u"}', 0)], "message_id long, body string, at long")
    twice = spark.createDataFrame([(7,), (7,)], "rec_id long")
    assert [tuple(r) for r in ig.ingest_results(message, twice, twice).collect()] == [(1, 7, "already transcribed")]
    item = spark.createDataFrame([("f", "g", 3)], "fuente_id string, guid string, dia int")
    seen = spark.createDataFrame([("f", "g"), ("f", "g")], "fuente_id string, guid string")
    assert [r.outcome for r in ig.upsert_articles(item, spark.createDataFrame([("f", 1)], "fuente_id string, corte int"), seen).collect()] == ["repeated"]
    news = spark.createDataFrame([("c", "n", "confirmada")], "client string, news_id string, estado string")
    assert [r.published for r in ed.publish_approved(news, spark.createDataFrame([("n", 4), ("n", 3)], "news_id string, day int")).collect()] == [3]
