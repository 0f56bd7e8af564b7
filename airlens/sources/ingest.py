"""Discovery of recordings, queue results and failures, retries, backfill, feeds and articles."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Codes of the object store and names of exceptions, by whether another try can help.
TRANSIENT = (
    "SlowDown", "InternalError", "RequestTimeout", "RequestTimeTooSkewed", "ServiceUnavailable", "Throttling", "ThrottlingException",
    "ProvisionedThroughputExceededException", "EndpointConnectionError", "RateLimitError", "APITimeoutError", "APIConnectionError",
    "InternalServerError", "TimeoutError", "ConnectionError",
)
PERMANENT = (
    "NoSuchKey", "NoSuchBucket", "AccessDenied", "InvalidObjectState", "InvalidArgument", "404", "403", "BadRequestError",
    "AuthenticationError", "PermissionDeniedError", "NotFoundError", "JSONDecodeError", "ValidationError", "CalledProcessError",
)
WAITS = (30, 90, 240)


def parse_recording_keys(keys: DataFrame) -> DataFrame:
    """s3_key -> station, fecha_inicio (UTC), fecha_fin an hour later, status. Known names:
    `st/YYYY/MM/YYYY-MM-DDTHHZ.mp3` or `.ts`, and the older `..._HHh.mp3`, which tells local time (UTC-6)."""
    key = F.col("s3_key")
    new = r"^([^/]+)/\d{4}/\d{2}/(\d{4}-\d{2}-\d{2})T(\d{2})Z\.(?:mp3|ts)$"
    old = r"^([^/]+)/(?:.*/)?[^/]*?(\d{4}-\d{2}-\d{2})_(\d{2})h\.mp3$"
    is_new, is_old = key.rlike(new), key.rlike(old)
    at = lambda p: F.concat_ws(" ", F.regexp_extract(key, p, 2), F.concat(F.regexp_extract(key, p, 3), F.lit(":00:00"))).try_cast("timestamp_ntz")
    start = F.when(is_new, at(new)).when(is_old, at(old) + F.expr("interval 6 hours"))
    station = F.when(is_new, F.regexp_extract(key, new, 1)).when(is_old, F.regexp_extract(key, old, 1))
    return keys.select("s3_key", station.alias("station"), start.alias("fecha_inicio"), (start + F.expr("interval 1 hour")).alias("fecha_fin"), F.when(start.isNotNull(), "ok").otherwise("unrecognised").alias("status"))


def discover_recordings(keys: DataFrame, stations: DataFrame, existing: DataFrame) -> DataFrame:
    """Every key with its outcome: created, existing, ignored (not recognised) or no station. stations: station."""
    parsed = parse_recording_keys(keys.select("s3_key").distinct())
    known = parsed.join(stations.select("station", F.lit(True).alias("_known")).distinct(), "station", "left")
    seen = existing.select("s3_key", F.lit(True).alias("_seen")).distinct()
    outcome = F.when(F.col("status") != "ok", "ignored").when(F.col("_seen"), "existing").when(F.col("_known"), "created").otherwise("no station")
    return known.join(seen, "s3_key", "left").withColumn("outcome", outcome).drop("_known", "_seen")


def discover_from_coverage(coverage: DataFrame, cutoffs: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploaded audio after its station's cut-off that is not known yet. coverage: s3_key, medio, media_type, status, fecha;
    cutoffs: medio, desde."""
    ready = coverage.where("media_type = 'audio' and status = 'uploaded'").join(cutoffs, "medio", "left")
    return ready.where(F.col("desde").isNull() | (F.col("fecha") >= F.col("desde"))).join(existing.select("s3_key"), "s3_key", "left_anti").drop("desde")


RESULT = "recording_id long, words_uri string, status string"


def read_messages(messages: DataFrame) -> DataFrame:
    """Queue bodies with `reason` where they can't be used: bad json, no id, no words."""
    m = F.from_json("body", RESULT, {"mode": "PERMISSIVE"})
    got = messages.withColumn("m", m).withColumn("valid", F.try_parse_json("body").isNotNull())
    reason = F.when(~F.col("valid"), "bad json").when(F.col("m.recording_id").isNull(), "no id").when(F.coalesce("m.words_uri", F.lit("")) == "", "no words")
    return got.select(*messages.columns, F.col("m.recording_id").alias("rec_id"), F.col("m.words_uri").alias("words_uri"), reason.alias("reason"))


def ingest_results(messages: DataFrame, known: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Each message with its outcome; a recording delivered more than once is new once only (the first by `at`)."""
    read = read_messages(messages)
    first = F.row_number().over(Window.partitionBy("rec_id", F.col("reason").isNull()).orderBy("at", "message_id")) == 1
    got = read.withColumn("first", first).join(known.select("rec_id", F.lit(True).alias("_known")).distinct(), "rec_id", "left").join(transcribed.select("rec_id", F.lit(True).alias("_done")).distinct(), "rec_id", "left")
    outcome = F.when(F.col("reason").isNotNull(), F.concat(F.lit("quarantine: "), F.col("reason"))).when(F.col("_known").isNull(), "quarantine: unknown recording").when(F.col("_done") | ~F.col("first"), "already transcribed").otherwise("procesada")
    return got.select("message_id", "rec_id", outcome.alias("outcome"))


def ingest_failures(messages: DataFrame, recordings: DataFrame, default: str = "transcription failed") -> DataFrame:
    """rec_id, estado, error_mensaje of recordings with a failure message: `{original_job, error}` or the bare job. One
    already transcribed stays so."""
    got = F.from_json("body", "original_job struct<recording_id:long>, error string, recording_id long")
    rows = messages.select(F.coalesce(got["original_job"]["recording_id"], got["recording_id"]).alias("rec_id"), F.coalesce(got["error"], F.lit(default)).alias("error"), "at")
    last = rows.where("rec_id is not null").groupBy("rec_id").agg(F.max_by("error", F.struct("at", "error")).alias("error"))
    done = F.col("estado") == "procesada"
    return recordings.join(last, "rec_id").select("rec_id", F.when(done, F.col("estado")).otherwise("error").alias("estado"), F.when(~done, F.col("error")).alias("error_mensaje"))


def classify_errors(errors: DataFrame) -> DataFrame:
    """errors (code, message) with kind: by code, unknown codes are transient. A program that failed because no space was
    left is worth another try, any other way it fails is not."""
    full = (F.col("code") == "CalledProcessError") & F.coalesce(F.lower("message").contains("no space left on device"), F.lit(False))
    kind = F.when(full, "transient").when(F.col("code").isin(*PERMANENT), "permanent").otherwise("transient")
    return errors.withColumn("kind", kind)


def retry_plan(failures: DataFrame) -> DataFrame:
    """failures (kind, attempt) with action (dead letter, retry, invalid) and wait_s: 30, 90, 240 s, then 300."""
    attempt = F.col("attempt")
    wait = F.when(attempt <= len(WAITS), F.element_at(F.array(*map(F.lit, WAITS)), F.greatest(F.least(attempt, F.lit(len(WAITS))), F.lit(1)))).otherwise(300)
    action = F.when(attempt <= 0, "invalid").when(F.col("kind") == "permanent", "dead letter").otherwise("retry")
    return failures.withColumn("action", action).withColumn("wait_s", F.when(action == "retry", wait))


def reconcile_backfill(recordings: DataFrame, objects: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Recordings left in `procesando` with the transcript found for them by `station/hour`: outcome existing,
    backfilled (from words.json before txt) or missing. recordings: rec_id, job_key; objects: path."""
    path = F.regexp_extract("path", r"^transcripts/(.*)\.(words\.json|txt)$", 1)
    kind = F.regexp_extract("path", r"^transcripts/(.*)\.(words\.json|txt)$", 2)
    found = objects.select(path.alias("job_key"), kind.alias("kind")).where("kind <> ''").groupBy("job_key").agg(F.max("kind").alias("kind"))
    got = recordings.where("estado = 'procesando'").join(found, "job_key", "left").join(transcribed.select("rec_id", F.lit(True).alias("_done")).distinct(), "rec_id", "left")
    return got.select("rec_id", F.when(F.col("_done"), "existing").when(F.col("kind").isNotNull(), "backfilled").otherwise("missing").alias("outcome"), F.when(F.col("_done").isNull(), F.col("kind")).alias("kind"))


#: Entities that XML itself knows.
_XML = ("&amp;", "&lt;", "&gt;", "&quot;", "&apos;")


def _named(bodies: pd.Series) -> pd.Series:
    import re

    swap = lambda m: m[0] if m[0] in _XML else html.unescape(m[0])
    return bodies.map(lambda x: None if x is None else re.sub(r"&[A-Za-z][A-Za-z0-9]*;", swap, x))


def repair_entities(body: Column) -> Column:
    """Named HTML entities as characters; numeric ones and XML's five stay. Only for bodies that failed to parse."""
    return F.pandas_udf(_named, "string")(body)


def rfc2822(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT)\b", "+0000")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")))


_RSS = "channel struct<item:array<struct<guid:string,link:string,title:string,description:string,pubDate:string,author:string,`dc:creator`:string,`content:encoded`:string>>>, _corrupt_record string"


def _root(body: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(body, r"(?s)^\s*(<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*", ""), r"^<([A-Za-z0-9:_-]+)", 1)


def parse_rss(feeds: DataFrame) -> DataFrame:
    """fuente_id, error, guid (cut at 512), url (1024), titulo, publicado_at, cuerpo, autor; items without a guid or link, a link
    or a date are dropped; a feed that is no RSS gives one row with its error. feeds: fuente_id, body."""
    plain = F.regexp_replace("body", "<guid[^>]*>", "<guid>")
    parsed = feeds.withColumn("x", F.from_xml(plain, _RSS))
    broken = parsed.where(F.col("x._corrupt_record").isNotNull()).select("fuente_id", "body", F.from_xml(repair_entities(plain), _RSS).alias("x"))
    rows = parsed.where("x._corrupt_record is null").select("fuente_id", "body", "x").union(broken)
    error = F.when(_root(F.col("body")) != "rss", "not rss").when(F.col("x._corrupt_record").isNotNull(), "bad xml")
    each = rows.withColumn("error", error).select("fuente_id", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("x.channel.item"))).alias("i"))
    guid, link = F.coalesce(F.nullif(F.trim("i.guid"), F.lit("")), F.trim("i.link")), F.trim("i.link")
    got = each.select("fuente_id", "error", F.substring(guid, 1, 512).alias("guid"), F.substring(link, 1, 1024).alias("url"), F.col("i.title").alias("titulo"), rfc2822(F.col("i.pubDate")).alias("publicado_at"), F.coalesce(F.col("i.content:encoded"), F.col("i.description")).alias("cuerpo"), F.coalesce(F.col("i.dc:creator"), F.col("i.author")).alias("autor"))
    return got.where("error is not null or (guid <> '' and url <> '' and publicado_at is not null)")


_SITEMAP = "url array<struct<loc:string,`news:news`:struct<`news:title`:string,`news:publication_date`:string>>>, _corrupt_record string"


def parse_news_sitemap(feeds: DataFrame) -> DataFrame:
    """fuente_id, guid = url, titulo, publicado (ISO text, its offset kept); entries with a news block and an address only."""
    rows = feeds.select("fuente_id", F.explode(F.from_xml("body", _SITEMAP)["url"]).alias("u")).where("u.`news:news` is not null and trim(u.loc) <> ''")
    return rows.select("fuente_id", F.trim("u.loc").alias("guid"), F.trim("u.loc").alias("url"), F.col("u.news:news.news:title").alias("titulo"), F.col("u.news:news.news:publication_date").alias("publicado"))


def upsert_articles(items: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """items (fuente_id, guid, dia) with outcome: before cut-off, repeated or new; repeats inside a feed collapse to the
    earliest. sources: fuente_id, corte."""
    one = F.row_number().over(Window.partitionBy("fuente_id", "guid").orderBy("dia"))
    rows = items.withColumn("_r", one).where("_r = 1").drop("_r").join(sources, "fuente_id", "left").join(existing.select("fuente_id", "guid", F.lit(True).alias("_seen")).distinct(), ["fuente_id", "guid"], "left")
    outcome = F.when(F.col("dia") < F.coalesce("corte", F.lit(-1)), "before cut-off").when(F.col("_seen"), "repeated").otherwise("new")
    return rows.withColumn("outcome", outcome).drop("_seen", "corte")


def source_health(polls: DataFrame) -> DataFrame:
    """fuente_id, last result, consecutive errors since the last success, last validator. polls: fuente_id, seq, result, etag;
    a 304 keeps the validator, an error saves none."""
    good = F.col("result").isin("ok", "304")
    last_good = F.max(F.when(good, F.col("seq"))).over(Window.partitionBy("fuente_id"))
    rows = polls.withColumn("_good", F.coalesce(last_good, F.lit(-1)))
    return rows.groupBy("fuente_id").agg(F.max_by("result", "seq").alias("last_result"), F.count_if((F.col("seq") > F.col("_good")) & ~good).alias("consecutive_errors"), F.max_by(F.when(F.col("result") == "ok", F.col("etag")), F.when(F.col("result") == "ok", F.col("seq"))).alias("etag"))


def split_archive(files: DataFrame) -> DataFrame:
    """file, pos, block of text archives parted by lines of `=` only; blank parts are dropped. files: file, text."""
    rows = files.select("file", F.posexplode(F.split("text", r"(?m)^=+$\n?")).alias("part", "block")).where(F.trim(F.regexp_replace("block", r"\s", " ")) != "")
    return rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("part")) - 1).alias("pos"), "block")


def write_requests(requests: DataFrame, path: str) -> None:
    """JSON lines of custom_id, method, url, body."""
    requests.select("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), "body").write.mode("overwrite").json(path)


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet by partition columns; rows are dealt by them first, so that each folder gets few files."""
    (rows.repartition(*by) if by else rows).write.mode("overwrite").partitionBy(*by).parquet(path)
