"""Queries on client reports and exports: R1 to R15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import normalize_text
from airlens.operators import clients as cl
from airlens.operators import report as rp
from airlens.operators.graph import checkpointed
from airlens.plans import demo
from airlens.plans.register import registrar

QUERIES, SQL, query = registrar()

#: Word borders spelled out, for engines differ on \b beside accented letters.
CLIENT = r"(^|[^\p{L}])the([^\p{L}]|$)"
TOPICS = {"agua": r"(^|[^\p{L}])de([^\p{L}]|$)", "energia": r"(^|[^\p{L}])les?([^\p{L}]|$)"}
NOISE = ("the", "de", "la", "en")
_FROM, _TO = "timestamp_ntz'2024-01-02 00:00:00'", "timestamp_ntz'2024-02-01 00:00:00'"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    rows = demo.segments(spark, d).withColumn("sentiment", rp.canonical(F.col("sentiment")))
    return rp.tag_notes(rows, CLIENT, TOPICS, F.expr(_FROM), F.expr(_TO))


_TAGGED = """, blobs as (select *, title || ' ' || summary || ' ' || array_to_string(people, ' ') || ' ' || array_to_string(keywords, ' ') blob from segments where momento >= timestamp '2024-01-02' and momento < timestamp '2024-02-01'),
    tagged as (select * exclude (blob, sentiment), case sentiment when 'neutro' then 'neutral' else sentiment end sentiment, regexp_matches(blob, '(?i)(^|[^\\p{L}])the([^\\p{L}]|$)') mention, regexp_matches(blob, '(?i)(^|[^\\p{L}])de([^\\p{L}]|$)') agua, regexp_matches(blob, '(?i)(^|[^\\p{L}])les?([^\\p{L}]|$)') energia from blobs)"""
_TONES = "count(*) filter (mention and sentiment = 'positivo') pos, count(*) filter (mention and sentiment = 'neutral') neu, count(*) filter (mention and sentiment = 'negativo') neg"


@query("r1_tag_notes", "segments", _TAGGED + " select rec_id, seg, mention, case when agua and energia then 'agua|energia' when agua then 'agua' when energia then 'energia' else '' end topics, mention or agua or energia relevant from tagged")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("rec_id", "seg", "mention", F.array_join("topics", "|").alias("topics"), "relevant")


@query("r1_universe", "segments", _TAGGED + " select medio, count(*) universe from tagged group by 1")
def r1b(spark: SparkSession, d: str) -> DataFrame:
    return rp.universe(tagged(spark, d))


@query("r2_literal_text", "segments transcripts", _TAGGED + " select rec_id, seg, sha256(array_to_string(words[start_word + 1:end_word + 1], ' ')) text_hash from tagged join transcripts using (rec_id) where mention")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return rp.literal_text(tagged(spark, d).where("mention"), demo.timed(spark, d)).select("rec_id", "seg", F.sha2("texto", 256).alias("text_hash"))


@query("r3_share_summary", "segments", _TAGGED + f", s as (select count(*) universe, count(*) filter (mention) notes, {_TONES} from tagged) select *, round(100 * notes / universe::double, 6) as percent, round_even(universe / notes::double, 0)::bigint one_in, case when pos > neg then 'favorable' when neg > pos then 'adverso' else 'equilibrado' end balance from s")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return rp.share_summary(tagged(spark, d))


_MEDIA = _TAGGED + f""", m as (select medio, count(*) universe, count(*) filter (mention) notes, {_TONES} from tagged group by 1),
    media as (select *, round(100 * notes / universe::double, 6) as percent, case when notes = 0 then 'silent' when notes < 5 then 'low volume' when neg >= pos + 3 then 'critical' when pos >= neg + 3 then 'favourable' when neu >= 0.6 * notes then 'factual' else 'mixed' end reading from m)"""


@query("r4_media_table", "segments", _MEDIA + " select * from media")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return rp.media_table(tagged(spark, d))


_TIME = _TAGGED + """, t as (select 'day' section, strftime(momento - interval 6 hours, '%Y-%m-%d') as key from tagged where mention union all select 'hour', strftime(momento - interval 6 hours, '%H') from tagged where mention), profile as (select section, key, count(*) notes from t group by 1, 2)"""


@query("r5_time_profile", "segments", _TIME + " select * from profile")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return rp.time_profile(tagged(spark, d))


@query("r5_peak_hours", "segments", _TIME + " select key, notes from profile where section = 'hour' order by notes desc, key limit 3")
def r5b(spark: SparkSession, d: str) -> DataFrame:
    return rp.peak_hours(rp.time_profile(tagged(spark, d)))


_DROP = "(select arg_min(notes, key) f, arg_max(notes, key) l, count(*) n from profile where section = 'day')"


@query("r5_day_drop", "segments", _TIME + f' select f as "first", l as "last", round(100 * (f - l) / f::double, 1) as percent from {_DROP} where n > 1 and f > l')
def r5c(spark: SparkSession, d: str) -> DataFrame:
    return rp.day_drop(rp.time_profile(tagged(spark, d)))


_AXES = _TAGGED + """, ax as (select *, array_to_string((list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(array_to_string(keywords, ' '))), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ('the', 'de', 'la', 'en')))[1:2], ' ') axis from tagged where mention),
    all_axes as (select axis, count(*) notes, count(*) filter (sentiment = 'positivo') pos, count(*) filter (sentiment = 'neutral') neu, count(*) filter (sentiment = 'negativo') neg from ax where axis <> '' group by 1),
    axes as (select * from all_axes order by notes desc, axis limit 6)"""


@query("r6_axes", "segments", _AXES + " select * from axes")
def r6(spark: SparkSession, d: str) -> DataFrame:
    return rp.top_axes(rp.axes(tagged(spark, d), NOISE))


@query("r6_axes_share", "segments", _AXES + " select round(100 * (select sum(notes) from (select notes from all_axes order by notes desc, axis limit 10)) / sum(notes)::double, 6) as percent from all_axes")
def r6c(spark: SparkSession, d: str) -> DataFrame:
    return rp.axes_share(rp.axes(tagged(spark, d), NOISE))


@query("r6_axis_samples", "segments", _AXES + " select axis, r, rec_id, seg, title from (select *, row_number() over (partition by axis order by momento, rec_id, seg)::int r from ax where axis <> '') where r <= 2")
def r6b(spark: SparkSession, d: str) -> DataFrame:
    return rp.axis_samples(tagged(spark, d), NOISE)


_ACTORS = """, p as (select rec_id, seg, unnest(list_transform(people, lambda x, i: case when i % 2 = 0 then x || ' de ' || keywords[1] else x end)) said from tagged where mention), n as (select said, lower(strip_accents(said)) alias from p),
    k as (select *, list_filter(string_split_regex(replace(alias, '.', ' '), '\\s+'), lambda w: w <> '' and w not in ('de', 'del', 'la')) w from n),
    acts as (select case when alias in ('the', 'of') then 'Alguien Importante' when len(w) >= 2 then array_to_string(list_transform(w[1:2], lambda x: upper(x[1]) || x[2:]), ' ') else said end actor, count(*) notes
    from k where alias in ('the', 'of') or len(w) = 0 or len(list_filter(w, lambda x: x not in ('in', 'joh', 'expresidente'))) > 0 group by 1 order by notes desc, actor limit 10)"""


@query("r7_actors", "segments", _TAGGED + _ACTORS + " select * from acts")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return rp.actors(_named(tagged(spark, d)), _aliases(spark), "In")


def _named(rows: DataFrame) -> DataFrame:
    """Every other person has a second name, the note's first keyword."""
    return rows.withColumn("people", F.transform("people", lambda x, i: F.when(i % 2 == 1, F.concat_ws(" de ", x, F.element_at("keywords", 1))).otherwise(x)))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("the", "Alguien Importante"), ("of", "Alguien Importante")], "alias string, name string")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """Each note quotes its title, in one of four with a word that wasn't said."""
    return tagged(spark, d).where("mention").withColumns({"quote": _quote(), "texto": F.col("summary")})


def _quote() -> Column:
    return F.concat(F.lit("«"), F.when((F.col("rec_id") + F.col("seg")) % 4 == 0, F.concat(F.lit("zzz "), F.col("title"))).otherwise(F.col("title")), F.lit("»"))


_NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_QUOTES = _TAGGED + f""", q as (select *, '«' || case when (rec_id + seg) % 4 = 0 then 'zzz ' || title else title end || '»' quote, {_NORM.format('summary')} said from tagged where mention),
    b as (select *, substr({_NORM.format('quote')}, 1, 60) bare, substr({_NORM.format('quote')}, 1, 70) k from q)"""


@query("r8_verify_quotes", "segments", _QUOTES + " select rec_id, seg, quote from b where bare <> '' and contains(said, bare)")
def r8(spark: SparkSession, d: str) -> DataFrame:
    return rp.verify_quotes(_quotes(spark, d)).select("rec_id", "seg", "quote")


@query("r9_dedup_quotes", "segments", _QUOTES + """, o as (select * from (select *, row_number() over (partition by k order by momento, rec_id, seg) r from b) where r = 1)
    select rec_id, seg, sentiment, rank from (select *, row_number() over (partition by sentiment order by momento, rec_id, seg)::int as rank from o) where rank <= case sentiment when 'positivo' then 6 when 'negativo' then 8 else 5 end""")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return rp.dedup_quotes(_quotes(spark, d)).select("rec_id", "seg", "sentiment", "rank")


@query("r10_topic_section", "segments", _TAGGED + """, t as (select *, 'agua' topic from tagged where not mention and agua union all select *, 'energia' from tagged where not mention and energia),
    c as (select *, count(*) over (partition by topic) notes, count(*) filter (sentiment = 'negativo') over (partition by topic) neg, row_number() over (partition by topic order by momento, rec_id, seg)::int as rank from t)
    select topic, rank, rec_id, seg, notes, neg from c where rank <= 12""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return rp.topic_section(tagged(spark, d))


_OBS = f"""select case when reading = 'critical' then 'critical station' else 'factual station' end as rule, medio as detail from media where reading = 'critical' or (notes >= 10 and neu >= 0.6 * notes)
    union all select 'silent stations', count(*)::varchar from media where reading = 'silent' having count(*) > 0
    union all select 'more criticism than praise', round(sum(neg) / sum(pos)::double, 1)::varchar from media having sum(pos) > 0 and sum(neg) > sum(pos)
    union all select 'falling volume', round(100 * (f - l) / f::double, 1)::varchar from {_DROP} where n > 1 and f > l"""


@query("r11_observations", "segments", _MEDIA + _TIME.removeprefix(_TAGGED) + " " + _OBS)
def r11(spark: SparkSession, d: str) -> DataFrame:
    t = tagged(spark, d)
    return rp.observations(rp.share_summary(t), rp.media_table(t), rp.time_profile(t))


@query("r12_report_tables", "segments", _MEDIA + _AXES.removeprefix(_TAGGED) + _TIME.removeprefix(_TAGGED) + _ACTORS + _QUOTES.removeprefix(_TAGGED) + f""", obs as ({_OBS}),
    kept as (select * from (select *, row_number() over (partition by k order by momento, rec_id, seg) r1 from b where bare <> '' and contains(said, bare)) where r1 = 1),
    tones as (select sentiment, least(count(*), case sentiment when 'positivo' then 6 when 'negativo' then 8 else 5 end) notes from kept group by 1),
    topics as (select topic, count(*) notes, count(*) filter (sentiment = 'negativo') neg from (select *, 'agua' topic from tagged where not mention and agua union all select *, 'energia' from tagged where not mention and energia) group by 1), total as (select sum(notes)::bigint notes, sum(pos)::bigint pos, sum(neu)::bigint neu, sum(neg)::bigint neg from media),
    whole as (select 'summary' section, '' as key, notes, pos, neu, neg, case when pos > neg then 'favorable' when neg > pos then 'adverso' else 'equilibrado' end as text from total
        union all select 'stations', medio, notes, pos, neu, neg, reading from media union all select section, key, notes, null, null, null, null from profile
        union all select 'axes', axis, notes, pos, neu, neg, null from axes union all select 'actors', actor, notes, null, null, null, null from acts
        union all select 'quotes', sentiment, notes, null, null, null, null from tones union all select 'topics', topic, notes, null, null, neg, null from topics union all select 'observations', rule, null, null, null, null, detail from obs)
    select 'client-1' client, '2024-01' as period, * from whole""")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """The tagged notes are written once, and all sections are made from them."""
    return rp.report_tables(_named(checkpointed(tagged(spark, d))), "client-1", "2024-01", NOISE, _aliases(spark), "In", _quotes(spark, d))


def _watched(spark: SparkSession, d: str) -> DataFrame:
    """A client for each item of benchmark: it is named by the item's longest word and watches the second longest."""
    words = demo.table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(normalize_text(F.col("text")), " "))).alias("term")).where("term <> ''")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.length("term").desc(), "term"))
    return words.withColumn("r", place).where("r <= 2").select(F.concat(F.lit("client-"), "item_id").alias("client"), "term", F.when(F.col("r") == 2, F.col("term")).alias("topic"))


def _client_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(demo.segments(spark, d)).withColumn("sentiment", rp.canonical(F.col("sentiment")))
    return rows.select("rec_id", "seg", "medio", "momento", "sentiment", "title", "summary", "people", "keywords", _quote().alias("quote"), F.col("summary").alias("texto"))


_CLIENTS = f""", watched as (select 'client-' || item_id client, w term, case when r = 2 then w end topic from
        (select item_id, w, row_number() over (partition by item_id order by length(w) desc, w) r from (select item_id, unnest(list_distinct(string_split({_NORM.format('text')}, ' '))) w from benchmark) where w <> '') where r <= 2),
    own as (select client, list(term) own from watched where topic is null group by client),
    people2 as (select * exclude (people), list_transform(people, lambda x, i: case when i % 2 = 0 then x || ' de ' || keywords[1] else x end) people from segments),
    notes as (select * exclude (sentiment), case sentiment when 'neutro' then 'neutral' else sentiment end sentiment, strftime(momento - interval 6 hours, '%Y-%m') as period,
        '«' || case when (rec_id + seg) % 4 = 0 then 'zzz ' || title else title end || '»' quote, ' ' || {_NORM.format("title || ' ' || summary || ' ' || array_to_string(people, ' ') || ' ' || array_to_string(keywords, ' ')")} || ' ' blob from people2),
    hit as (select rec_id, seg, client, bool_or(topic is null) mention, list_filter(list(distinct topic), lambda x: x is not null) topics from notes join watched on contains(blob, ' ' || term || ' ') group by 1, 2, 3),
    tagged as (select n.*, client, mention, topics, own from notes n join hit using (rec_id, seg) left join own using (client)),
    named as (select *, array_to_string((list_filter(string_split({_NORM.format("array_to_string(keywords, ' ')")}, ' '), lambda w: w <> '' and w not in ('the', 'de', 'la', 'en') and not list_contains(own, w)))[1:2], ' ') axis,
        substr({_NORM.format('quote')}, 1, 60) bare, substr({_NORM.format('quote')}, 1, 70) k, {_NORM.format('summary')} said from tagged where mention),
    acts as (select *, lower(strip_accents(actor0)) alias, list_filter(string_split_regex(replace(lower(strip_accents(actor0)), '.', ' '), '\\s+'), lambda w: w <> '' and w not in ('de', 'del', 'la')) w from (select *, unnest(people) actor0 from named)),
    spread as (select client, period, 'summary' section, '' as key, sentiment, momento, rec_id, seg, quote from named
        union all select client, period, 'stations', medio, sentiment, momento, rec_id, seg, quote from named
        union all select client, period, 'day', strftime(momento - interval 6 hours, '%Y-%m-%d'), sentiment, momento, rec_id, seg, quote from named
        union all select client, period, 'hour', strftime(momento - interval 6 hours, '%H'), sentiment, momento, rec_id, seg, quote from named
        union all select client, period, 'axes', axis, sentiment, momento, rec_id, seg, quote from named where axis <> ''
        union all select client, period, 'quote', k, sentiment, momento, rec_id, seg, quote from named where bare <> '' and contains(said, bare)
        union all select client, period, 'actors', case when alias in ('the', 'of') then 'Alguien Importante' when len(w) >= 2 then array_to_string(list_transform(w[1:2], lambda x: upper(x[1]) || x[2:]), ' ') else actor0 end, sentiment, momento, rec_id, seg, quote
            from acts where alias in ('the', 'of') or len(w) = 0 or len(list_filter(w, lambda x: x not in ('joh', 'expresidente') and not list_contains(own, x))) > 0
        union all select client, period, 'topics', unnest(topics), sentiment, momento, rec_id, seg, quote from tagged where not mention),
    cells as (select client, period, section, key, count(*) notes, count(*) filter (sentiment = 'positivo') pos, count(*) filter (sentiment = 'neutral') neu, count(*) filter (sentiment = 'negativo') neg,
        first(sentiment order by momento, rec_id, seg) tone, first(quote order by momento, rec_id, seg) quote,
        first(momento order by momento, rec_id, seg) fm, first(rec_id order by momento, rec_id, seg) fr, first(seg order by momento, rec_id, seg) fs from spread group by 1, 2, 3, 4),
    whole as (select period, medio, count(*) universe from notes group by 1, 2), reports as (select distinct client, period from cells),
    total as (select client, period, sum(universe)::bigint universe from reports join whole using (period) group by 1, 2),
    summary as (select client, period, 'summary' section, '' as key, coalesce(notes, 0) notes, coalesce(pos, 0) pos, coalesce(neu, 0) neu, coalesce(neg, 0) neg, universe from total left join (select * from cells where section = 'summary') c using (client, period)),
    stations as (select r.client, r.period, 'stations' section, w.medio as key, coalesce(notes, 0) notes, coalesce(pos, 0) pos, coalesce(neu, 0) neu, coalesce(neg, 0) neg, universe
        from reports r join whole w on w.period = r.period left join cells c on c.section = 'stations' and c.client = r.client and c.period = r.period and c.key = w.medio),
    read as (select *, case when notes = 0 then 'silent' when notes < 5 then 'low volume' when neg >= pos + 3 then 'critical' when pos >= neg + 3 then 'favourable' when neu >= 0.6 * notes then 'factual' else 'mixed' end as text from stations),
    days as (select client, period, arg_min(notes, key) a, arg_max(notes, key) b, count(*) n from cells where section = 'day' group by 1, 2),
    tones as (select client, period, tone, count(*) many, first(quote order by fm, fr, fs) quote from cells where section = 'quote' group by 1, 2, 3),
    rows as (select client, period, section, key, notes, pos, neu, neg, universe, round(100 * notes / universe::double, 6) as percent, case when pos > neg then 'favorable' when neg > pos then 'adverso' else 'equilibrado' end as text from summary
        union all select client, period, section, key, notes, pos, neu, neg, universe, round(100 * notes / universe::double, 6), text from read
        union all select client, period, section, key, notes, pos, neu, neg, null, null, case when section = 'topics' then quote end from cells where section in ('day', 'hour', 'axes', 'actors', 'topics')
        union all select client, period, 'quotes', tone, least(many, case tone when 'positivo' then 6 when 'negativo' then 8 else 5 end), null, null, null, null, null, quote from tones
        union all select client, period, 'observations', case when text = 'critical' then 'critical station' else 'factual station' end, null, null, null, null, null, null, key from read where text = 'critical' or (notes >= 10 and neu >= 0.6 * notes)
        union all select client, period, 'observations', 'silent stations', null, null, null, null, null, null, count(*)::varchar from read where text = 'silent' group by 1, 2
        union all select client, period, 'observations', 'more criticism than praise', null, null, null, null, null, null, round(neg / pos::double, 1)::varchar from summary where pos > 0 and neg > pos
        union all select client, period, 'observations', 'falling volume', null, null, null, null, null, null, round(100 * (a - b) / a::double, 1)::varchar from days where n > 1 and a > b),
    placed as (select *, (row_number() over (partition by client, period, section order by case when section in ('day', 'hour') then null else notes end desc nulls last, key, text nulls first))::int as rank from rows)
    select client, period, section, rank, key, notes, pos, neu, neg, universe, percent, text from placed where rank <= case section when 'axes' then 6 when 'actors' then 10 else 1000000000 end"""


@query("r12_client_reports", "segments", _CLIENTS)
def r12b(spark: SparkSession, d: str) -> DataFrame:
    """Every client's report by month, from one scan of the notes."""
    return cl.client_reports(_client_notes(spark, d), _watched(spark, d), NOISE, {"the": "Alguien Importante", "of": "Alguien Importante"})


@query("r10_topic_counts", "segments", _QUOTES + """, t as (select *, 'agua' topic from alltags where not mention and agua union all select *, 'energia' from alltags where not mention and energia)
    select topic, count(*) notes, count(*) filter (sentiment = 'positivo') pos, count(*) filter (sentiment = 'neutral') neu, count(*) filter (sentiment = 'negativo') neg, first(quote order by momento, rec_id, seg) first_quote from t group by topic""".replace("alltags", "(select *, '«' || case when (rec_id + seg) % 4 = 0 then 'zzz ' || title else title end || '»' quote from tagged)"))
def r10b(spark: SparkSession, d: str) -> DataFrame:
    return rp.topic_counts(tagged(spark, d).withColumn("quote", _quote()))


@query("r13_mentions_export", "segments", """, rows as (select *, case when medio = 'src1' then null else 'Radio ' || medio end as name, (length(medio) * 137 % 100) / 1000.0::double audience from segments where medio <> 'src1' and momento >= timestamp '2024-01-20' - interval 48 hours and momento <= timestamp '2024-01-20')
    select rec_id, seg, name, strftime(momento, '%Y-%m-%d %H:%M:%S') momento, array_to_string(people[1:8], '|') people, case sentiment when 'positivo' then 'Bueno' else 'Otro' end topic, (round_even(audience * 4e6 / 100, 0) * 100)::bigint reach from rows order by momento desc, rec_id, seg limit 4000""")
def r13(spark: SparkSession, d: str) -> DataFrame:
    notes = demo.segments(spark, d).withColumns({"texto": F.col("summary"), "tipo": F.col("sentiment")})
    stations = demo.recordings(spark, d).where("medio <> 'src1'").select("medio", F.concat(F.lit("Radio "), F.col("medio")).alias("name"), (F.length("medio") * 137 % 100 / F.lit(1000.0)).alias("audience")).distinct()
    topics = spark.createDataFrame([("positivo", "Bueno")], "tipo string, topic string")
    got = rp.mentions_export(notes, stations, topics, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    return got.select("rec_id", "seg", "name", F.date_format("momento", "yyyy-MM-dd HH:mm:ss").alias("momento"), F.array_join("people", "|").alias("people"), "topic", "reach")


@query("r14_weekly_draft", "segments", "select rec_id % 4 client, strftime(date_trunc('week', momento), '%Y-%m-%d') as week, count(*) news, count(*) filter (seg % 3 = 0) included from segments group by 1, 2")
def r14(spark: SparkSession, d: str) -> DataFrame:
    rows = demo.segments(spark, d).select((F.col("rec_id") % 4).alias("client"), F.concat_ws("-", "rec_id", "seg").alias("news_id"), "momento", "seg")
    return rp.weekly_draft(rows.drop("seg"), rows.where("seg % 3 = 0").select("client", "news_id"))


@query("r15_kpis", "log", "select (minute // 1440)::bigint as day, count(*) processed, count(*) filter (event_type = 'purchase') published, round(avg(k), 6) review_minutes from log group by 1")
def r15(spark: SparkSession, d: str) -> DataFrame:
    rows = demo.log(spark, d).select(F.col("minute").alias("created"), (F.col("minute") + F.col("k")).alias("reviewed"), F.when(F.col("event_type") == "purchase", "publicada").otherwise("pendiente").alias("estado"))
    return rp.daily_kpis(rows)


@query("r15_queue", "log", """, e as (select (minute // 1440)::bigint as day, 1 d from log union all select ((minute + k * 700) // 1440)::bigint, -1 from log where k % 4 <> 0),
    s as (select day, sum(d) d from e where day is not null group by 1) select day, sum(d) over (order by day)::bigint as queue from s""")
def r15c(spark: SparkSession, d: str) -> DataFrame:
    reviewed = F.when(F.col("k") % 4 != 0, F.col("minute") + F.col("k") * 700)
    return rp.queue_sizes(demo.log(spark, d).select(F.col("minute").alias("created"), reviewed.alias("reviewed")))


@query("r15_precision", "", "select o_custkey % 50 client, count(*) suggested, count(*) filter (o_orderstatus <> 'F') kept, round(count(*) filter (o_orderstatus <> 'F') / count(*)::double, 6) as precision from orders group by 1")
def r15b(spark: SparkSession, d: str) -> DataFrame:
    rows = demo.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("client"), F.when(F.col("o_orderstatus") == "F", "descartada").otherwise("confirmada").alias("estado"))
    return rp.precision(rows)
