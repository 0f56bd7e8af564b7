"""Streaming queries W1 to W6, run over the tables as file streams until they are drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.text import tokens
from airlens.operators import repeat
from airlens.operators.graph import shared_folder
from airlens.plans.register import registrar
from airlens.plans.transcripts import PRINTS as _PRINTS
from airlens.streaming import jobs, versioned

QUERIES, SQL, query = registrar()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("w1_stream_results", "", "select distinct user_id rec_id from events where event_type = 'view'")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drained(jobs.first_results(_events(spark, d).where("event_type = 'view'").select("ts", F.col("user_id").alias("rec_id"))), "append").select("rec_id")


@query("w2_stream_articles", "", "select distinct event_type fuente_id, user_id guid from events where event_id >= 20")
def w2(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("ts", F.col("event_type").alias("fuente_id"), F.col("user_id").alias("guid"), F.col("event_id").alias("dia"))
    return jobs.drained(jobs.new_articles(rows, 20), "append").select("fuente_id", "guid")


@query("w1_stream_outcomes", "", """with m as (select user_id rec_id, case when event_id % 11 = 0 then 'bad json' when event_id % 7 = 0 then 'no id' when event_id % 5 = 0 then 'no words' end reason from events where event_type = 'view')
    select 'procesada' outcome, count(distinct rec_id) n from m where reason is null union all select 'quarantine: ' || reason, count(*) from m where reason is not null group by 1""")
def w1b(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""case when event_id % 11 = 0 then '{"recording_id": 1' when event_id % 7 = 0 then '{"words_uri": "x"}' when event_id % 5 = 0 then concat('{"recording_id": ', user_id, '}')
        else concat('{"recording_id": ', user_id, ', "words_uri": "s/', user_id, '.json"}') end""")
    rows = _events(spark, d).where("event_type = 'view'").select("ts", F.col("event_id").alias("message_id"), body.alias("body"))
    return jobs.drained(jobs.result_outcomes(rows), "append").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_QUEUE = """with m as (select event_id, user_id rec_id, event_type, case when event_id % 11 = 0 then 'bad json' when event_id % 7 = 0 then 'no id' when event_id % 5 = 0 then 'no words' end reason from events where event_type in ('view', 'error')),
    good as (select * from m where event_type = 'view' and reason is null),
    processed as (select distinct rec_id from good where rec_id % 10 <> 3 and rec_id % 10 <> 4)"""


def _consumed(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Views are results, errors failures; recordings of a station aren't known, others have a transcript already."""
    body = F.expr("""case when event_type = 'error' then concat('{"original_job": {"recording_id": ', user_id, '}, "error": "e', event_id, '"}')
        when event_id % 11 = 0 then '{"recording_id": 1' when event_id % 7 = 0 then '{"words_uri": "x"}' when event_id % 5 = 0 then concat('{"recording_id": ', user_id, '}')
        else concat('{"recording_id": ', user_id, ', "words_uri": "s/', user_id, '.json"}') end""")
    kind = F.when(F.col("event_type") == "view", "result").otherwise("failure")
    rows = _events(spark, d).where("event_type in ('view', 'error')").select(F.col("event_id").alias("message_id"), kind.alias("kind"), body.alias("body"), F.col("event_id").alias("at"))
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("rec_id")).distinct()
    base = f"{shared_folder(spark).rstrip('/')}/queue-{uuid.uuid4().hex}"
    jobs.consumed(rows, users.where("rec_id % 10 <> 3"), users.where("rec_id % 10 = 4"), base)
    return base, users


@query("w1_stream_consumer", "", _QUEUE + """ select 'procesada' outcome, (select count(*) from processed) n union all select 'quarantine: unknown recording', count(*) from good where rec_id % 10 = 3
    union all select 'already transcribed', (select count(*) from good where rec_id % 10 <> 3) - (select count(*) from processed) union all select 'quarantine: ' || reason, count(*) from m where event_type = 'view' and reason is not null group by 1""")
def w1c(spark: SparkSession, d: str) -> DataFrame:
    base, _ = _consumed(spark, d)
    return jobs.consumed_outcomes(spark, base).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("w1_stream_failures", "", _QUEUE + """, f as (select rec_id, arg_max('e' || event_id, event_id) error from m where event_type = 'error' group by 1)
    select coalesce(f.rec_id, p.rec_id) rec_id, case when p.rec_id is not null then 'procesada' else 'error' end estado, case when p.rec_id is null then error end error_mensaje from f full join processed p using (rec_id)""")
def w1d(spark: SparkSession, d: str) -> DataFrame:
    base, users = _consumed(spark, d)
    return jobs.recording_states(spark, base, users.withColumn("estado", F.lit("procesando")))


@query("w3_merged_fingerprints", "transcripts", _PRINTS + " select huella, count(distinct rec_id) recordings from prints group by 1 having count(distinct rec_id) > 1")
def w3b(spark: SparkSession, d: str) -> DataFrame:
    docs = jobs.stream(spark, f"{d}/documents.parquet").select(F.col("doc_id").alias("rec_id"), F.col("source").alias("medio"), tokens(F.col("text")).alias("words"))
    path = f"{shared_folder(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"
    jobs.merged_counts(jobs.running_counts(repeat.different_prints(docs)), path)
    return versioned.latest(spark, path, "huella string, recordings long").where("recordings > 1")


@query("w3_stream_fingerprints", "transcripts", _PRINTS + " select huella, count(distinct rec_id) recordings from prints group by 1 having count(distinct rec_id) > 1")
def w3(spark: SparkSession, d: str) -> DataFrame:
    docs = jobs.stream(spark, f"{d}/documents.parquet").select(F.col("doc_id").alias("rec_id"), F.col("source").alias("medio"), tokens(F.col("text")).alias("words"))
    return jobs.drained(jobs.running_counts(repeat.different_prints(docs)), "complete").where("recordings > 1")


@query("w4_hourly_mentions", "", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n from events group by 1, 2")
def w4(spark: SparkSession, d: str) -> DataFrame:
    got = jobs.drained(jobs.hourly(_events(spark, d), "event_type"), "complete")
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("w4_two_day_volume", "", "with s as (select date_trunc('hour', ts) - to_hours(k) as start from events, (select unnest(range(0, 48)) k)) select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) n from s group by 1")
def w4b(spark: SparkSession, d: str) -> DataFrame:
    got = jobs.drained(jobs.two_days(_events(spark, d)), "complete")
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("w5_stream_review")
def w5(spark: SparkSession, d: str) -> DataFrame:
    action = F.expr("case event_type when 'view' then 'start' when 'click' then 'draft' when 'purchase' then 'approve' when 'error' then 'reject' else 'nonsense' end")
    rows = _events(spark, d).select("ts", F.col("user_id").alias("news_id"), "event_id", action.alias("action"), F.concat(F.lit("u"), F.col("event_id") % 2).alias("who"))
    return jobs.drained(jobs.review_machine(rows), "append")


@query("w6_stream_stories")
def w6(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.stream(spark, f"{d}/embeddings.parquet").select(F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 1200).alias("ts"), F.col("label").alias("topic"), F.col("vec_id").alias("item_id"), (F.col("vec_id") * 20).alias("minute"), "embedding")
    return jobs.drained(jobs.online_stories(rows, 0.35), "append")
