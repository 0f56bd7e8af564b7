"""Streaming forms of the operators: deduplication under a watermark, running counts, windows, state machines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from airlens.operators.editorial import step
from airlens.operators.graph import shared_folder
from airlens.sources.ingest import ingest_failures, ingest_results, read_messages
from airlens.streaming import versioned


#: Bytes of a micro-batch of a file stream.
BATCH_BYTES = 1 << 30


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over Parquet; the schema is that of the files there. A plain path would have to be a folder; as a
    pattern (its last letter in brackets) it may be a single file as well. Each micro-batch takes whole files, up to
    BATCH_BYTES of them."""
    return spark.readStream.option("maxBytesPerTrigger", str(BATCH_BYTES)).schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(rows: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is (trigger availableNow) into a table of the shared folder, and reads that. Modes:
    append writes each batch to a folder of its own, over what an attempt before may have left there; complete keeps the
    last batch's whole result."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    written = []

    def put(batch: DataFrame, number: int) -> None:
        written.append(number)
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(out if mode == "complete" else f"{out}/batch=*")


def first_results(messages: DataFrame, delay: str = "60 days") -> DataFrame:
    """The first message of each recording under the watermark; repeats within it are dropped, later ones are late. messages: ts, rec_id."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["rec_id"])


def result_outcomes(messages: DataFrame, delay: str = "60 days") -> DataFrame:
    """message_id, rec_id, outcome: a recording's first usable message under the watermark is processed, repeats of it are
    dropped, and messages that can't be used are quarantined with the reason. messages: ts, message_id, body."""
    read = read_messages(messages.withWatermark("ts", delay))
    good = read.where("reason is null").dropDuplicatesWithinWatermark(["rec_id"]).select("message_id", "rec_id", F.lit("procesada").alias("outcome"))
    bad = read.where("reason is not null").select("message_id", "rec_id", F.concat(F.lit("quarantine: "), "reason").alias("outcome"))
    return good.union(bad)


def consumed(messages: DataFrame, known: DataFrame, transcribed: DataFrame, base: str) -> None:
    """Runs the queue of results and failures dry, against the recordings that are known and those that have a transcript: a
    stream joined with tables. Each batch writes its messages by outcome (procesada, already transcribed, quarantine: unknown recording and other
    reasons) under base/outcomes and its failures under base/failures, into a folder of its own number, so that a batch that is run
    again replaces itself. A recording processed by an earlier batch is transcribed for later ones. messages: message_id, kind (result or
    failure), body, at."""
    spark = messages.sparkSession
    schema = "message_id long, rec_id long, outcome string"

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        earlier = spark.createDataFrame([], "rec_id long")
        if number:
            before = [f"{base}/outcomes/batch={k}" for k in range(number)]
            earlier = spark.read.schema(schema).parquet(*before).where("outcome = 'procesada'").select("rec_id")
        results = ingest_results(batch.where("kind = 'result'"), known, transcribed.select("rec_id").unionByName(earlier))
        results.write.mode("overwrite").parquet(f"{base}/outcomes/batch={number}")
        batch.where("kind = 'failure'").select("message_id", "body", "at").write.mode("overwrite").parquet(f"{base}/failures/batch={number}")
        batch.unpersist()

    messages.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def consumed_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """message_id, rec_id, outcome of all batches of consumed()."""
    return spark.read.schema("message_id long, rec_id long, outcome string").parquet(f"{base}/outcomes/batch=*")


def recording_states(spark: SparkSession, base: str, recordings: DataFrame) -> DataFrame:
    """rec_id, estado, error_mensaje after consumed(), of recordings with a result or a failure: one that was processed, in whatever
    batch, stays so. recordings: rec_id, estado."""
    done = consumed_outcomes(spark, base).where("outcome = 'procesada'").select("rec_id").distinct().withColumn("_done", F.lit(True))
    now = recordings.select("rec_id", "estado").join(done, "rec_id", "left").select("rec_id", F.when(F.col("_done"), "procesada").otherwise(F.col("estado")).alias("estado"))
    failures = spark.read.schema("message_id long, body string, at long").parquet(f"{base}/failures/batch=*")
    failed = ingest_failures(failures, now)
    rest = now.join(done, "rec_id", "left_semi").join(failed.select("rec_id"), "rec_id", "left_anti")
    return failed.unionByName(rest.select("rec_id", "estado", F.lit(None).cast("string").alias("error_mensaje")))


def new_articles(items: DataFrame, cutoff: int, delay: str = "60 days") -> DataFrame:
    """Articles once a source and guid, none before the cut-off. items: ts, fuente_id, guid, dia."""
    return items.where(F.col("dia") >= cutoff).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fuente_id", "guid"])


def running_counts(prints: DataFrame) -> DataFrame:
    """huella with the recordings seen so far, in update or complete mode. prints: different_prints."""
    return prints.groupBy("huella").agg(F.count(F.lit(1)).alias("recordings"))


def merged_counts(counts: DataFrame, path: str, key: str = "huella") -> None:
    """Runs a counting stream dry in update mode: each batch takes its changed counts into a table by bucket (versioned.py) and
    rewrites only the buckets they fall in."""
    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query.foreachBatch(lambda batch, number: versioned.merge(batch.persist(), number, path, key)).start().awaitTermination()


def hourly(mentions: DataFrame, *by: str, delay: str = "2 hours") -> DataFrame:
    """Mentions in tumbling hours. mentions: ts."""
    return mentions.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def two_days(mentions: DataFrame, *by: str, delay: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """Volume of 48 hours, sliding."""
    return mentions.withWatermark("ts", delay).groupBy(F.window("ts", "48 hours", slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


LEASE_MS = 45 * 60 * 1000
#: How long a review that is over, and a topic without new items, are remembered, in event time.
KEPT_MS = 48 * 60 * 60 * 1000


def review_machine(commands: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The editorial commands as a stream: a row for each command with the state after it; a review whose holder is silent for 45
    minutes of event time goes back to the queue. An item that is pending again has no state; one that is decided loses its own 48
    hours after its last command, and begins anew after that. Commands behind the watermark aren't applied: rejected() lists them.
    commands: ts, news_id, event_id, action, who."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("pendiente", None)
        if state.hasTimedOut:
            state.remove()
            if now[0] != "en_revision":
                return
            yield pd.DataFrame([(key[0], -1, "pendiente", None, "lease expired")], columns=["news_id", "event_id", "estado", "holder", "reason"])
            return
        out, last = [], 0
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        for e, action, who, ts in zip(rows["event_id"], rows["action"], rows["who"], rows["ts"]):
            now, reason = step(tuple(now), action, who)
            out.append((key[0], e, now[0], now[1], reason))
            last = int(ts.timestamp() * 1000)
        if now[0] == "pendiente":
            state.remove()
        else:
            state.update(tuple(now))
            state.setTimeoutTimestamp(max(last + (LEASE_MS if now[0] == "en_revision" else KEPT_MS), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["news_id", "event_id", "estado", "holder", "reason"])

    out = "news_id long, event_id long, estado string, holder string, reason string"
    return commands.withWatermark("ts", delay).groupBy("news_id").applyInPandasWithState(fold, out, "estado string, holder string", "append", GroupStateTimeout.EventTimeTimeout)


def rejected(commands: DataFrame, applied: DataFrame) -> DataFrame:
    """The reject table: commands (a table) that review_machine left out because they came behind the watermark, as rows with a reason.
    applied: its output. The stream's own log is what it is compared with, so no late row is lost without a trace."""
    return commands.join(applied.where("event_id >= 0").select("event_id"), "event_id", "left_anti").withColumn("reason", F.lit("late"))


def online_stories(items: DataFrame, threshold: float = 0.83, window_minutes: int = 48 * 60, delay: str = "48 hours") -> DataFrame:
    """Stories opened and joined as items come, apart for each topic (a story that spans topics is split; the batch form isn't).
    A story is dropped from the state 48 hours after its last item: at the topic's next one, or by a timer where none
    comes. items: ts, topic, item_id, minute, embedding."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, counts, lasts, sums = ([list(x) for x in state.get] if state.exists else ([], [], [], []))
        sums = [np.asarray(s, float) for s in sums]
        out = []
        rows = pd.concat(batches).sort_values(["minute", "item_id"])
        for item, minute, vector in zip(rows["item_id"], rows["minute"], rows["embedding"]):
            v = np.asarray(vector, float)
            live = [k for k in range(len(ids)) if lasts[k] >= minute - window_minutes]
            ids, counts, lasts, sums = ([x[k] for k in live] for x in (ids, counts, lasts, sums))
            near = [float(v @ s / max(np.linalg.norm(v) * np.linalg.norm(s), 1e-12)) for s in sums]
            k = int(np.argmax(near)) if near else -1
            if k < 0 or near[k] < threshold:
                ids, counts, lasts, sums = [*ids, int(item)], [*counts, 0], [*lasts, int(minute)], [*sums, np.zeros_like(v)]
                k = len(ids) - 1
            sums[k], counts[k], lasts[k] = sums[k] + v, counts[k] + 1, max(lasts[k], int(minute))
            out.append((int(item), ids[k]))
        state.update((ids, counts, lasts, [s.tolist() for s in sums]))
        ends = int(rows["ts"].max().timestamp() * 1000) + window_minutes * 60_000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["item_id", "story"])

    kept = "ids array<long>, counts array<int>, lasts array<long>, sums array<array<double>>"
    return items.withWatermark("ts", delay).groupBy("topic").applyInPandasWithState(fold, "item_id long, story long", kept, "append", GroupStateTimeout.EventTimeTimeout)


