"""Queries of the reading surface and the editorial state: Q1 to Q18."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.text import titled_entity
from airlens.operators import editorial as ed
from airlens.operators import entities as en
from airlens.operators import search as se
from airlens.plans import demo
from airlens.plans.register import registrar

QUERIES, SQL, query = registrar()


def _news(spark: SparkSession, d: str) -> DataFrame:
    """News are conversations; a fifth have no recording."""
    v = demo.versions(spark, d)
    news = v.select("news_id").distinct().withColumn("rec_id", F.when(F.col("news_id") % 5 != 0, F.col("news_id")))
    last = ed.version_history(v, "titulo").where("current").select("news_id", "numero", F.substring("titulo", 1, 80).alias("titulo"))
    recs = demo.recordings(spark, d).select("rec_id", F.concat_ws("/", "medio", F.hour("fecha_inicio")).alias("programa_id"), "lang", "estado")
    programmes = demo.recordings(spark, d).where("hour(fecha_inicio) <> 3").select(F.concat_ws("/", "medio", F.hour("fecha_inicio")).alias("programa_id"), F.concat(F.lit("Hora "), F.hour("fecha_inicio").cast("string")).alias("programa"), "medio").distinct()
    stations = programmes.where("medio <> 'src2'").select("medio", F.concat(F.lit("Radio "), F.col("medio")).alias("station")).distinct()
    return ed.news_list(news, last, recs, programmes, stations)


_NEWS = """, filled as (select *, last_value(titulo ignore nulls) over (partition by news_id order by numero rows between unbounded preceding and current row) t, max(numero) over (partition by news_id) m from versions),
    news as (select v.news_id, numero, substr(t, 1, 80) titulo, r.rec_id, case when hour(fecha_inicio) <> 3 then r.medio end medio, case when hour(fecha_inicio) <> 3 and r.medio is not null then 'Hora ' || hour(fecha_inicio) end programa, lang, estado, case when hour(fecha_inicio) <> 3 and r.medio <> 'src2' then 'Radio ' || r.medio end station
        from filled v left join recordings r on r.rec_id = v.news_id and v.news_id % 5 <> 0 where numero = m)"""
_F = "versions recordings"


@query("q1_news_list", _F, _NEWS + " select news_id, numero, titulo, medio, programa, station from news order by news_id desc limit 200")
def q1(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).orderBy(F.desc("news_id")).limit(200).select("news_id", F.col("numero").cast("long").alias("numero"), "titulo", "medio", "programa", "station")


@query("q2_news_detail", _F, _NEWS + " select news_id, titulo, medio, station, lang, estado from news where news_id = 7")
def q2(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).where("news_id = 7").select("news_id", "titulo", "medio", "station", "lang", "estado")


@query("q3_tabs", _F, _NEWS + " select coalesce(medio, '-') medio, count(*) n from news group by 1 union all select 'total', count(*) from news")
def q3(spark: SparkSession, d: str) -> DataFrame:
    return ed.tabs(_news(spark, d))


@query("q3_local_days", "segments", "select medio, count(*) n from segments where cast(momento - interval 6 hours as date) between date '2024-01-05' and date '2024-01-09' group by 1")
def q3b(spark: SparkSession, d: str) -> DataFrame:
    return demo.segments(spark, d).where(ed.in_local_days(F.col("momento"), "2024-01-05", "2024-01-09")).groupBy("medio").agg(F.count(F.lit(1)).alias("n"))




def _by() -> list:
    return [F.desc("momento"), "rec_id", "seg"]


@query("q4_search", "segments", "select rec_id, seg from segments where title ilike '%licensed%' or summary ilike '%licensed%' or medio ilike '%licensed%' or title ilike '%ouen_re%' or summary ilike '%ouen_re%' or medio ilike '%ouen_re%' order by momento desc, rec_id, seg limit 50")
def q4(spark: SparkSession, d: str) -> DataFrame:
    return ed.search(demo.segments(spark, d), "a licensed ouen_re", ["title", "summary", "medio"], 50, _by()).select("rec_id", "seg")


@query("q5_search_expanded", "segments", """, a as (select rec_id, seg from segments where summary ilike '%zzzzqq%' order by momento desc, rec_id, seg limit 20),
    b as (select rec_id, seg from segments where summary ilike '%apache%' or summary ilike '%gnu%' order by momento desc, rec_id, seg limit 20)
    select rec_id, seg, 1 part from a union all select rec_id, seg, 2 from b where (rec_id, seg) not in (select (rec_id, seg) from a) and (select count(*) from a) < 3""")
def q5(spark: SparkSession, d: str) -> DataFrame:
    return ed.search_expanded(demo.segments(spark, d), "zzzzqq", ["Apache", "ZZZZQQ", "gnu"], ["summary"], 20, _by(), ["rec_id", "seg"]).select("rec_id", "seg", "part")


@query("q6_pending_fifo", "recordings", "select rec_id from recordings where estado = 'pendiente' order by fecha_inicio, rec_id limit 100")
def q6(spark: SparkSession, d: str) -> DataFrame:
    return demo.recordings(spark, d).where("estado = 'pendiente'").orderBy("fecha_inicio", "rec_id").limit(100).select("rec_id")


def _commands(spark: SparkSession, d: str) -> DataFrame:
    action = F.expr("case event_type when 'view' then 'start' when 'click' then 'draft' when 'purchase' then 'approve' when 'error' then 'reject' else 'nonsense' end")
    return demo.log(spark, d).select(F.col("user_id").alias("news_id"), F.col("minute").alias("at"), "event_id", action.alias("action"), F.concat(F.lit("u"), F.col("k") % 2).alias("who"))


@query("q7_apply_editorial_log", "log", """, c as (select user_id news_id, event_id, case event_type when 'view' then 'start' when 'click' then 'draft' when 'purchase' then 'approve' when 'error' then 'reject' else 'nonsense' end as act, 'u' || (k % 2) who, row_number() over (partition by user_id order by event_id) n from log),
    f as (with recursive r as (select news_id, 0::bigint n, null::bigint event_id, 'pendiente' estado, null::varchar holder, null::varchar reason from (select distinct news_id from c)
        union all select c.news_id, c.n, c.event_id,
            case when act = 'start' and estado = 'pendiente' then 'en_revision' when act = 'approve' and estado = 'en_revision' and holder = who then 'aprobada' when act = 'reject' and estado = 'en_revision' and holder = who then 'rechazada' else estado end,
            case when act = 'start' and estado = 'pendiente' then who when act in ('approve', 'reject') and estado = 'en_revision' and holder = who then null else holder end,
            case when act = 'start' then case when estado <> 'pendiente' then 'not pending' end when act = 'nonsense' then 'unknown command' when estado <> 'en_revision' then 'not in review' when holder <> who then 'held by another' end
        from r join c on c.news_id = r.news_id and c.n = r.n + 1) select * from r)
    select news_id, event_id, estado, holder, reason from f where n > 0""")
def q7(spark: SparkSession, d: str) -> DataFrame:
    return ed.apply_commands(_commands(spark, d))


@query("q7_assign_queue", "log recordings", """, a as (select event_id, 'u' || (k % 2) who, row_number() over (order by event_id) n from log where event_type = 'view'),
    q as (select rec_id news_id, row_number() over (order by rec_id) n from recordings where estado = 'pendiente')
    select event_id, who, news_id, case when news_id is null then 'empty queue' end reason from a left join q using (n)""")
def q7b(spark: SparkSession, d: str) -> DataFrame:
    asks = _commands(spark, d).join(demo.log(spark, d).where("event_type = 'view'").select("event_id"), "event_id")
    queue = demo.recordings(spark, d).where("estado = 'pendiente'").select(F.col("rec_id").alias("news_id"), F.col("rec_id").alias("created"))
    return ed.assign_queue(asks, queue)


@query("q8_version_history", "versions", ", f as (select news_id, numero::int numero, last_value(titulo ignore nulls) over (partition by news_id order by numero rows between unbounded preceding and current row) t, numero = max(numero) over (partition by news_id) as current from versions) select news_id, numero, sha256(t) title_hash, current from f")
def q8(spark: SparkSession, d: str) -> DataFrame:
    return ed.version_history(demo.versions(spark, d), "titulo").select("news_id", "numero", F.sha2("titulo", 256).alias("title_hash"), "current")


@query("q8_corrections", "versions", ", b as (select role, titulo, lag(titulo) over (partition by news_id order by numero) b from versions where titulo is not null) select role, count(*) filter (b <> titulo) changed from b group by 1")
def q8b(spark: SparkSession, d: str) -> DataFrame:
    return ed.corrections(demo.versions(spark, d), "titulo")


@query("q9_press_list", "articles", "select page_id, host, title, has_body from articles where host <> '' order by day desc, page_id limit 500")
def q9(spark: SparkSession, d: str) -> DataFrame:
    a = demo.articles(spark, d)
    hosts = a.where("host <> ''").select("host").distinct()
    return a.join(hosts, "host").orderBy(F.desc("day"), "page_id").limit(500).select("page_id", "host", "title", "has_body")


@query("q10_pending_segmentation", "recordings", "select rec_id from recordings where estado = 'procesada' and rec_id % 3 <> 0 order by fecha_inicio desc, rec_id limit 100 offset 20")
def q10(spark: SparkSession, d: str) -> DataFrame:
    r = demo.recordings(spark, d)
    return ed.pending(r.where("estado = 'procesada'"), r.where("rec_id % 3 = 0"), "rec_id", [F.desc("fecha_inicio"), "rec_id"], 100, 20).select("rec_id")


@query("q11_pending_transcription", "recordings", "select rec_id, 'transcripts/' || medio || '/' || strftime(fecha_inicio, '%Y-%m-%dT%H') output_key from recordings where estado = 'pendiente' and fecha_inicio >= timestamp '2024-01-03' order by fecha_inicio, rec_id limit 50")
def q11(spark: SparkSession, d: str) -> DataFrame:
    r = demo.recordings(spark, d).where("estado = 'pendiente' and fecha_inicio >= timestamp_ntz'2024-01-03 00:00:00'").orderBy("fecha_inicio", "rec_id").limit(50)
    key = F.concat(F.lit("transcripts/"), F.col("medio"), F.lit("/"), F.date_format("fecha_inicio", "yyyy-MM-dd"), F.lit("T"), F.date_format("fecha_inicio", "HH"))
    return r.select("rec_id", key.alias("output_key"))


@query("q12_requeue_order", "recordings", "select rec_id, row_number() over (order by rec_id % 10 = 7 desc, rec_id) - 1 as position from recordings where estado = 'procesando'")
def q12(spark: SparkSession, d: str) -> DataFrame:
    rows = demo.recordings(spark, d).where("estado = 'procesando'").withColumn("t", F.col("rec_id"))
    return ed.requeue_order(rows, F.col("rec_id") % 10 == 7).select("rec_id", F.col("position").cast("long").alias("position"))


@query("q13_pending_materialisation", "recordings", "select rec_id, ((row_number() over (order by rec_id desc) - 1) % 4)::int slot from recordings where estado = 'procesada' and rec_id % 5 <> 0")
def q13(spark: SparkSession, d: str) -> DataFrame:
    from airlens.operators.words import ranked_by_id

    rows = demo.recordings(spark, d).where("estado = 'procesada' and rec_id % 5 <> 0").select("rec_id", (-F.col("rec_id")).alias("newest"))
    return ranked_by_id(rows, "newest").select("rec_id", (F.col("rank") % 4).cast("int").alias("slot"))


@query("q14_latest_completed_run", "log", "select user_id rec_id, max(event_id) run_id from log where event_type = 'purchase' group by 1")
def q14(spark: SparkSession, d: str) -> DataFrame:
    return ed.latest_run(demo.log(spark, d).select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("run_id"), F.col("minute").alias("finished"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("estado")))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile a nation: its name as a person, its region's as a topic."""
    n = demo.table(spark, d, "nation")
    profiles = n.select(F.col("n_nationkey").alias("tenant_id"), F.array(F.substring("n_name", 1, 2)).alias("persons"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("licensed"))).alias("bodies"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("apache"), F.lit("gnu"))).alias("topics"))
    return ed.client_profiles(profiles, n.select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name")))


@query("q15_client_profiles", "", "select n_nationkey tenant_id, n_name as name, 1 + (n_nationkey % 2 = 0)::int + 2 * (n_nationkey % 3 = 0)::int terms from nation")
def q15(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("tenant_id", "name", (F.size("persons") + F.size("bodies") + F.size("topics")).alias("terms"))


@query("q16_profile_match", "segments", """, t as (select rec_id, seg, lower(title || ' ' || summary) t from segments), m as (select n_nationkey tenant_id, rec_id, seg, contains(t, lower(substr(n_name, 1, 2))) p, n_nationkey % 2 = 0 and contains(t, 'licensed') b, n_nationkey % 3 = 0 and (contains(t, 'apache') or contains(t, 'gnu')) o,
        1 + (n_nationkey % 2 = 0)::int + (n_nationkey % 3 = 0)::int n from t, nation)
    select tenant_id, p::int + b::int + o::int hits, count(*) notes, round((p::int + b::int + o::int) / max(n)::double, 6) score from m where p or b or o group by tenant_id, hits""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    got = ed.profile_match(demo.segments(spark, d), _profiles(spark, d))
    return got.groupBy("tenant_id", F.size(F.split("matched_on", "\\|")).alias("hits")).agg(F.count(F.lit(1)).alias("notes"), F.max("score").alias("score"))


_FACETS = ", s as (select * from segments where list_contains(people, 'The') and sentiment = 'negativo' and cast(momento - interval 6 hours as date) between date '2024-01-03' and date '2024-01-24')"


@query("q17_faceted_search", "segments", _FACETS + " select 'medio' dimension, medio as value, count(*) n from s group by 2 union all select 'sentiment', sentiment, count(*) from s group by 2")
def q17(spark: SparkSession, d: str) -> DataFrame:
    rows = ed.filtered(demo.segments(spark, d), "2024-01-03", "2024-01-24", people="The", sentiment="negativo", medio=None)
    return ed.facets(rows, "medio", "sentiment")


@query("q17_entity_search", "segments", """, m as (select rec_id || '-' || seg news_id, cast(momento - interval 6 hours as date) as day, unnest(people) as name, 'persona' tipo from segments
        union all select rec_id || '-' || seg, cast(momento - interval 6 hours as date), unnest(keywords), 'institucion' from segments),
    k as (select distinct news_id, day, tipo, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as key from m),
    e as (select distinct news_id, tipo, case when tipo = 'persona' and key in ('that', 'than') then 'the' else key end entity from k where key <> '' and day between date '2024-01-03' and date '2024-01-24'),
    hit as (select news_id from e where (tipo = 'persona' and entity = 'the') or (tipo = 'institucion' and entity = 'in') group by 1 having count(*) = 2),
    s as (select medio, sentiment from segments where rec_id || '-' || seg in (select news_id from hit))
    select 'medio' dimension, medio as value, count(*) n from s group by 2 union all select 'sentiment', sentiment, count(*) from s group by 2 union all select 'all', null, count(*) from s""")
def q17b(spark: SparkSession, d: str) -> DataFrame:
    """News that name a person (by an alias) and an institution; aliases as resolve_mentions gives them."""
    notes = demo.segments(spark, d).withColumn("news_id", F.concat_ws("-", "rec_id", "seg"))
    versions = notes.select(F.col("news_id").alias("version_id"), "people", F.col("keywords").alias("organizations"), F.array().cast("array<string>").alias("locations"))
    links = en.entity_links(versions, versions.limit(0), titled_entity)
    resolved = spark.createDataFrame([("persona", "that", "the"), ("persona", "than", "the"), ("persona", "the", "the")], "tipo string, key string, entity string")
    news = notes.select(F.col("news_id").alias("version_id"), "news_id", F.to_date(F.col("momento") - F.expr("interval 6 hours")).alias("day"))
    wanted = spark.createDataFrame([("persona", "THAN"), ("persona", "that"), ("institucion", "In")], "tipo string, name string")
    return se.faceted_search(notes, se.entity_postings(links, resolved, news), wanted, resolved, ["medio", "sentiment"], F.lit("2024-01-03").cast("date"), F.lit("2024-01-24").cast("date"))


@query("q18_publish_approved", "recordings", """, s as (select o_orderkey, o_custkey client, o_orderkey % 1000 news_id, case o_orderstatus when 'F' then 'descartada' when 'O' then 'confirmada' else 'sugerida' end estado from orders)
    select estado, published, count(*) n from (select case when rec_id is not null and s.estado = 'confirmada' then 'publicada' else s.estado end estado, case when rec_id is not null and s.estado = 'confirmada' then rec_id // 24 end published from s left join recordings r on r.rec_id = s.news_id and r.estado = 'procesada') group by 1, 2""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    estado = F.expr("case o_orderstatus when 'F' then 'descartada' when 'O' then 'confirmada' else 'sugerida' end")
    suggestions = demo.table(spark, d, "orders").select(F.col("o_custkey").alias("client"), (F.col("o_orderkey") % 1000).alias("news_id"), estado.alias("estado"))
    approved = demo.recordings(spark, d).where("estado = 'procesada'").select(F.col("rec_id").alias("news_id"), F.expr("rec_id div 24").alias("day"))
    return ed.publish_approved(suggestions, approved).groupBy("estado", "published").agg(F.count(F.lit(1)).alias("n"))
