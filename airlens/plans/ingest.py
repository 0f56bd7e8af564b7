"""Queries on discovery, queues, feeds and archives: S1 to S16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.plans import demo
from airlens.plans.register import registrar
from airlens.sources import ingest as ig

QUERIES, SQL, query = registrar()


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Object names of the demo's recordings: new, older and unknown ones in turn."""
    r = demo.recordings(spark, d)
    name = F.expr("""case rec_id % 4
        when 0 then concat(medio, '/', date_format(fecha_inicio, 'yyyy/MM/yyyy-MM-dd'), 'T', date_format(fecha_inicio, 'HH'), 'Z.mp3')
        when 1 then concat(medio, '/', date_format(fecha_inicio, 'yyyy/MM/yyyy-MM-dd'), 'T', date_format(fecha_inicio, 'HH'), 'Z.ts')
        when 2 then concat(medio, '/viejo_', date_format(fecha_inicio - interval 6 hours, 'yyyy-MM-dd'), '_', date_format(fecha_inicio - interval 6 hours, 'HH'), 'h.mp3')
        else concat(medio, '/notes-', rec_id, '.txt') end""")
    return r.select("rec_id", "medio", name.alias("s3_key"), "fecha_inicio")


_KEYS = """, keys as (select rec_id, medio, fecha_inicio, case rec_id % 4 when 0 then medio || '/' || strftime(fecha_inicio, '%Y/%m/%Y-%m-%dT%H') || 'Z.mp3' when 1 then medio || '/' || strftime(fecha_inicio, '%Y/%m/%Y-%m-%dT%H') || 'Z.ts'
    when 2 then medio || '/viejo_' || strftime(fecha_inicio - interval 6 hours, '%Y-%m-%d_%H') || 'h.mp3' else medio || '/notes-' || rec_id || '.txt' end s3_key from recordings)"""


@query("s1_parse_recording_keys", "recordings", _KEYS + """ select s3_key, case when rec_id % 4 < 3 then medio end station, case when rec_id % 4 < 3 then strftime(fecha_inicio, '%Y-%m-%d %H:%M:%S') end fecha_inicio, case when rec_id % 4 < 3 then 'ok' else 'unrecognised' end status from keys""")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return ig.parse_recording_keys(_keys(spark, d)).select("s3_key", "station", F.date_format("fecha_inicio", "yyyy-MM-dd HH:mm:ss").alias("fecha_inicio"), "status")


@query("s2_discover_recordings", "recordings", _KEYS + """, each as (select s3_key, min(rec_id % 4) kind, bool_or(rec_id % 5 = 0) seen, min(medio) medio from keys group by s3_key)
    select case when kind = 3 then 'ignored' when seen then 'existing' when medio <> 'src3' then 'created' else 'no station' end outcome, count(*) n from each group by 1""")
def s2(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys(spark, d)
    stations = keys.where("medio <> 'src3'").select(F.col("medio").alias("station")).distinct()
    return ig.discover_recordings(keys, stations, keys.where("rec_id % 5 = 0")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s3_discover_from_coverage", "recordings", _KEYS + """ select rec_id from keys where rec_id % 3 <> 1 and rec_id % 7 <> 2 and rec_id >= 100 * (length(medio) - 3) and rec_id % 10 <> 4""")
def s3(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys(spark, d)
    coverage = keys.select("rec_id", "medio", F.col("rec_id").cast("string").alias("s3_key"), F.when(F.col("rec_id") % 3 != 1, "audio").otherwise("video").alias("media_type"), F.when(F.col("rec_id") % 7 != 2, "uploaded").otherwise("failed").alias("status"), F.col("rec_id").alias("fecha"))
    cutoffs = keys.select("medio", (100 * (F.length("medio") - 3)).alias("desde")).distinct()
    existing = keys.where("rec_id % 10 = 4").select(F.col("rec_id").cast("string").alias("s3_key"))
    return ig.discover_from_coverage(coverage, cutoffs, existing).select("rec_id")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""case when event_id % 11 = 0 then '{"recording_id": 1' when event_id % 7 = 0 then '{"words_uri": "x"}' when event_id % 5 = 0 then concat('{"recording_id": ', user_id, '}')
        else concat('{"recording_id": ', user_id, ', "words_uri": "s/', user_id, '.json"}') end""")
    return demo.log(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("message_id"), F.col("minute").alias("at"), body.alias("body"))


@query("s5_ingest_results", "log", """, m as (select *, case when event_id % 11 = 0 then 'bad json' when event_id % 7 = 0 then 'no id' when event_id % 5 = 0 then 'no words' end reason from log where event_type = 'view'),
    r as (select *, row_number() over (partition by user_id, reason is null order by event_id) n from m)
    select event_id message_id, case when reason is not null then 'quarantine: ' || reason when user_id % 10 = 3 then 'quarantine: unknown recording' when user_id % 10 = 4 or n > 1 then 'already transcribed' else 'procesada' end outcome from r""")
def s5(spark: SparkSession, d: str) -> DataFrame:
    users = demo.log(spark, d).select(F.col("user_id").alias("rec_id")).distinct()
    return ig.ingest_results(_messages(spark, d), users.where("rec_id % 10 <> 3"), users.where("rec_id % 10 = 4")).select("message_id", "outcome")


@query("s6_ingest_failures", "recordings log", """, m as (select user_id rec_id, case when event_id % 2 = 0 then 'code ' || k else 'transcription failed' end error, event_id from log where event_type = 'error'),
    last as (select rec_id, arg_max(error, event_id) error from m group by 1)
    select rec_id, case when estado = 'procesada' then estado else 'error' end estado, case when estado <> 'procesada' then error end error_mensaje from recordings join last using (rec_id)""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""case when event_id % 2 = 0 then concat('{"original_job": {"recording_id": ', user_id, '}, "error": "code ', k, '"}') else concat('{"recording_id": ', user_id, '}') end""")
    rows = demo.log(spark, d).where("event_type = 'error'").select(body.alias("body"), F.col("event_id").alias("at"))
    return ig.ingest_failures(rows, demo.recordings(spark, d))


_KNOWN = (*ig.TRANSIENT, *ig.PERMANENT, "other")
_FAILS = f""", f as (select event_id, ({list(_KNOWN)})[event_id % {len(_KNOWN)} + 1] code, case when k % 8 = 0 then 'No space left on device' else 'x' end message, (event_id % 6 - 1)::int attempt from log),
    c as (select *, case when code = 'CalledProcessError' and message = 'No space left on device' then 'transient' when code in {ig.PERMANENT} then 'permanent' else 'transient' end kind from f)"""


def _failures(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _KNOWN)), (F.col("event_id") % len(_KNOWN) + 1).cast("int"))
    message = F.when(F.col("k") % 8 == 0, "No space left on device").otherwise("x")
    rows = demo.log(spark, d).select("event_id", code.alias("code"), message.alias("message"), (F.col("event_id") % 6 - 1).cast("int").alias("attempt"))
    return ig.classify_errors(rows)


@query("s7_retry_plan", "log", _FAILS + " select event_id, case when attempt <= 0 then 'invalid' when kind = 'permanent' then 'dead letter' else 'retry' end as action, case when attempt > 0 and kind = 'transient' then case attempt when 1 then 30 when 2 then 90 when 3 then 240 else 300 end end wait_s from c")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return ig.retry_plan(_failures(spark, d)).select("event_id", "action", "wait_s")


@query("s8_classify_errors", "log", _FAILS + " select code, kind, count(*) n from c group by 1, 2")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("s9_reconcile_backfill", "recordings", "select rec_id, case when rec_id % 9 = 0 then 'existing' when rec_id % 3 <> 0 then 'backfilled' else 'missing' end outcome, case when rec_id % 9 <> 0 and rec_id % 3 <> 0 then case when rec_id % 3 = 1 then 'words.json' else 'txt' end end kind from recordings where estado = 'procesando'")
def s9(spark: SparkSession, d: str) -> DataFrame:
    r = demo.recordings(spark, d).withColumn("job_key", F.concat_ws("/", "medio", "rec_id"))
    paths = F.array_compact(F.array(F.when(F.col("rec_id") % 3 != 0, F.concat(F.lit("transcripts/"), F.col("job_key"), F.lit(".txt"))), F.when(F.col("rec_id") % 3 == 1, F.concat(F.lit("transcripts/"), F.col("job_key"), F.lit(".words.json")))))
    return ig.reconcile_backfill(r, r.select(F.explode(paths).alias("path")), r.where("rec_id % 9 = 0"))


#: Pages of a feed: a hundred, whatever the table holds.
_FEED = "page_id div 100"


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    """A feed of a hundred items, a page each, some without a date, one in five without a guid; and one that is no feed."""
    a = demo.articles(spark, d)
    date = F.expr("concat('Mon, ', 1 + page_id % 28, ' Jan 2024 ', lpad(page_id % 24, 2, '0'), ':00:00 ', if(page_id % 2 = 0, 'GMT', '-0600'))")
    item = F.concat(F.lit("<item>"), F.when(F.col("page_id") % 5 != 0, F.concat(F.lit('<guid isPermaLink="false">g'), F.col("page_id"), F.lit("</guid>"))).otherwise(""), F.lit("<link>http://h/"), F.col("page_id"), F.lit("</link><title>t&eacute;"), F.col("page_id"), F.lit("</title>"), F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("<pubDate>"), date, F.lit("</pubDate>"))).otherwise(""), F.lit("<dc:creator>someone</dc:creator></item>"))
    one = a.select(F.expr(_FEED).alias("fuente_id"), "page_id", item.alias("item")).groupBy("fuente_id").agg(F.concat_ws("", F.sort_array(F.collect_list("item"))).alias("items"))
    feeds = one.select("fuente_id", F.concat(F.lit("<rss><channel>"), F.col("items"), F.lit("</channel></rss>")).alias("body"))
    return feeds.union(spark.createDataFrame([(-1, "<html><body/></html>")], "fuente_id long, body string"))


@query("s10_parse_rss", "articles", """select page_id // 100 fuente_id, null::varchar error, case when page_id % 5 = 0 then 'http://h/' || page_id else 'g' || page_id end guid, 'té' || page_id titulo, ((1 + page_id % 28 - 1) * 24 + page_id % 24 + case when page_id % 2 = 0 then 0 else 6 end)::bigint as hours from articles where page_id % 7 <> 0
    union all select -1, 'not rss', null, null, null""")
def s10(spark: SparkSession, d: str) -> DataFrame:
    hours = (F.unix_timestamp("publicado_at") - F.lit(1704067200)) / 3600
    return ig.parse_rss(_feeds(spark, d)).select("fuente_id", "error", "guid", "titulo", hours.cast("long").alias("hours"))


@query("s11_parse_news_sitemap", "articles", "select page_id // 100 fuente_id, 'http://h/' || page_id guid, 't' || page_id titulo, '2024-01-0' || (1 + page_id % 9) || 'T00:00:00-06:00' publicado from articles where page_id % 3 <> 0")
def s11(spark: SparkSession, d: str) -> DataFrame:
    a = demo.articles(spark, d)
    news = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<news:news><news:publication_date>2024-01-0"), 1 + F.col("page_id") % 9, F.lit("T00:00:00-06:00</news:publication_date><news:title>t"), F.col("page_id"), F.lit("</news:title></news:news>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>http://h/"), F.col("page_id"), F.lit("</loc>"), news, F.lit("</url>"))
    body = a.select(F.expr(_FEED).alias("fuente_id"), entry.alias("e")).groupBy("fuente_id").agg(F.concat(F.lit("<urlset>"), F.concat_ws("", F.collect_list("e")), F.lit("</urlset>")).alias("body"))
    return ig.parse_news_sitemap(body).select("fuente_id", "guid", "titulo", "publicado")


@query("s13_upsert_articles", "articles", """, i as (select host, guid, day, row_number() over (partition by host, guid order by day) r from articles)
    select case when day < 20 then 'before cut-off' when day % 4 = 0 then 'repeated' else 'new' end outcome, count(*) n from i where r = 1 group by 1""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    a = demo.articles(spark, d).select(F.col("host").alias("fuente_id"), "guid", F.col("day").alias("dia"))
    first = a.groupBy("fuente_id", "guid").agg(F.min("dia").alias("dia"))
    sources = a.select("fuente_id", F.lit(20).alias("corte")).distinct()
    return ig.upsert_articles(a, sources, first.where("dia % 4 = 0")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s14_source_health", "log", """, p as (select user_id fuente_id, event_id seq, case event_type when 'error' then 'error' when 'view' then '304' else 'ok' end result, 'e' || k etag from log),
    g as (select *, coalesce(max(seq) filter (result <> 'error') over (partition by fuente_id), -1) good from p)
    select fuente_id, arg_max(result, seq) last_result, count(*) filter (seq > good and result = 'error') consecutive_errors, arg_max(etag, seq) filter (result = 'ok') etag from g group by 1""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    result = F.expr("case event_type when 'error' then 'error' when 'view' then '304' else 'ok' end")
    return ig.source_health(demo.log(spark, d).select(F.col("user_id").alias("fuente_id"), F.col("event_id").alias("seq"), result.alias("result"), F.concat(F.lit("e"), F.col("k")).alias("etag")))


@query("s15_split_archive", "", "with l as (select doc_id, string_split(text, chr(10)) l from documents), b as (select doc_id, l[i] block, i from (select *, unnest(range(1, len(l) + 1)) i from l)) select doc_id file, (row_number() over (partition by doc_id order by i) - 1)::int pos, sha256(block || chr(10)) block_hash from b where trim(regexp_replace(block, '\\s', ' ', 'g')) <> ''")
def s15(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.array_join(F.split("text", "\n"), "\n====\n"), F.lit("\n"))
    files = demo.table(spark, d, "documents").select(F.col("doc_id").alias("file"), text.alias("text"))
    return ig.split_archive(files).select("file", "pos", F.sha2("block", 256).alias("block_hash"))
