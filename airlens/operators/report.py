"""Client reports: tagged notes, shares, tables by station and time, axes, actors, quotes, rules, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import normalize_text, share, unmarked
from airlens.operators.arrays import segment_texts

#: Particles that are no part of an actor's key, and words that may stand for any client.
PARTICLES = ("de", "del", "la")
CLIENT_WORDS = ("joh", "expresidente")


def tag_notes(segments: DataFrame, client: str, topics: dict[str, str], start: Column, end: Column) -> DataFrame:
    """Notes of the half-open window with mention (the client's pattern, without regard to case), topics and relevant."""
    blob = F.concat_ws(" ", "title", "summary", F.array_join("people", " "), F.array_join("keywords", " "))
    rows = segments.where((F.col("momento") >= start) & (F.col("momento") < end)).withColumn("_blob", blob)
    hits = F.array_compact(F.array(*(F.when(F.col("_blob").rlike(f"(?i){p}"), t) for t, p in sorted(topics.items()))))
    got = rows.withColumns({"mention": F.col("_blob").rlike(f"(?i){client}"), "topics": hits}).drop("_blob")
    return got.withColumn("relevant", F.col("mention") | (F.size("topics") > 0))


def universe(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("medio").agg(F.count(F.lit(1)).alias("universe"))


def literal_text(notes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """T7 for recordings with hits only: the transcripts (arrays) are reduced first."""
    return segment_texts(notes, transcripts.join(notes.select("rec_id").distinct(), "rec_id", "left_semi"))


def _tone(kind: str) -> Column:
    return F.count_if(F.col("sentiment") == kind)


def canonical(sentiment: Column) -> Column:
    return F.when(sentiment == "neutro", "neutral").otherwise(sentiment)


def share_summary(tagged: DataFrame) -> DataFrame:
    """One row over direct mentions: universe, notes, percent, one in n, pos, neu, neg, balance."""
    got = tagged.agg(F.count(F.lit(1)).alias("universe"), F.count_if("mention").alias("notes"), *(F.count_if(F.col("mention") & (F.col("sentiment") == k)).alias(a) for k, a in (("positivo", "pos"), ("neutral", "neu"), ("negativo", "neg"))))
    balance = F.when(F.col("pos") > F.col("neg"), "favorable").when(F.col("neg") > F.col("pos"), "adverso").otherwise("equilibrado")
    return got.withColumns({"percent": F.round(100 * F.coalesce(F.try_divide("notes", "universe"), F.lit(0.0)), 6), "one_in": F.bround(F.try_divide("universe", "notes"), 0).cast("long"), "balance": balance})


def media_table(tagged: DataFrame) -> DataFrame:
    """medio, notes, percent of its agenda, tones, reading; stations without a mention have reading `silent`."""
    got = tagged.groupBy("medio").agg(F.count(F.lit(1)).alias("universe"), F.count_if("mention").alias("notes"), *(F.count_if(F.col("mention") & (F.col("sentiment") == k)).alias(a) for k, a in (("positivo", "pos"), ("neutral", "neu"), ("negativo", "neg"))))
    n, pos, neu, neg = (F.col(c) for c in ("notes", "pos", "neu", "neg"))
    reading = F.when(n == 0, "silent").when(n < 5, "low volume").when(neg >= pos + 3, "critical").when(pos >= neg + 3, "favourable").when(neu >= 0.6 * n, "factual").otherwise("mixed")
    return got.withColumns({"percent": F.round(100 * n / F.col("universe"), 6), "reading": reading})


def local(ts: Column) -> Column:
    """Fixed offset of six hours behind UTC."""
    return ts - F.expr("interval 6 hours")


def time_profile(tagged: DataFrame) -> DataFrame:
    """section (day, hour), key, notes of direct mentions."""
    own = tagged.where("mention").select(local(F.col("momento")).alias("t"))
    cell = F.explode(F.array(F.struct(F.lit("day").alias("section"), F.date_format("t", "yyyy-MM-dd").alias("key")), F.struct(F.lit("hour").alias("section"), F.date_format("t", "HH").alias("key"))))
    return own.select(cell.alias("c")).groupBy("c.section", "c.key").agg(F.count(F.lit(1)).alias("notes"))


def peak_hours(profile: DataFrame, top: int = 3) -> DataFrame:
    """The local hours with the most notes; of equal ones the earliest. profile: time_profile."""
    return profile.where("section = 'hour'").orderBy(F.desc("notes"), "key").limit(top).select("key", "notes")


def day_drop(profile: DataFrame) -> DataFrame:
    """One row, first, last, percent: by how much the last day's notes are below the first one's; none if they aren't."""
    days = profile.where("section = 'day'")
    ends = days.agg(F.min_by("notes", "key").alias("first"), F.max_by("notes", "key").alias("last"), F.count(F.lit(1)).alias("days"))
    return ends.where("days > 1 and first > last").select("first", "last", F.round(100 * (F.col("first") - F.col("last")) / F.col("first"), 1).alias("percent"))


def axes(tagged: DataFrame, noise: tuple[str, ...]) -> DataFrame:
    """axis, notes, tones: what notes are about, from their first keyword without noise and client words."""
    words = F.filter(F.split(normalize_text(F.array_join("keywords", " ")), " "), lambda w: (w != "") & ~w.isin(*noise))
    rows = tagged.where("mention").withColumn("axis", F.array_join(F.slice(words, 1, 2), " ")).where("axis <> ''")
    return rows.groupBy("axis").agg(F.count(F.lit(1)).alias("notes"), _tone("positivo").alias("pos"), _tone("neutral").alias("neu"), _tone("negativo").alias("neg"))


def top_axes(found: DataFrame, top: int = 6) -> DataFrame:
    return found.orderBy(F.desc("notes"), "axis").limit(top)


def axes_share(found: DataFrame, top: int = 10) -> DataFrame:
    """One row, percent: the share of notes that the most frequent axes have. found: axes()."""
    best = found.orderBy(F.desc("notes"), "axis").limit(top).select("notes", F.lit(True).alias("best"))
    both = best.union(found.select("notes", F.lit(False)))
    return both.agg(F.round(100 * F.sum(F.when(F.col("best"), F.col("notes"))) / F.sum(F.when(~F.col("best"), F.col("notes"))), 6).alias("percent"))


def axis_samples(tagged: DataFrame, noise: tuple[str, ...], each: int = 2) -> DataFrame:
    words = F.filter(F.split(normalize_text(F.array_join("keywords", " ")), " "), lambda w: (w != "") & ~w.isin(*noise))
    rows = tagged.where("mention").withColumn("axis", F.array_join(F.slice(words, 1, 2), " ")).where("axis <> ''")
    r = F.row_number().over(Window.partitionBy("axis").orderBy("momento", "rec_id", "seg"))
    return rows.withColumn("r", r).where(F.col("r") <= each).select("axis", "r", "rec_id", "seg", "title")


def actors(tagged: DataFrame, aliases: DataFrame, client: str, top: int = 10) -> DataFrame:
    """actor, notes: people by an alias map (alias, name; in lower case without marks; a person's hand made it, so it is
    broadcast), else by their first two words that are no particles, capitalised; a single word stays as it is. A name
    made of the client's words alone is left out. Each time a note names an actor counts."""
    people = tagged.where("mention").select("rec_id", "seg", F.explode("people").alias("said"))
    named = people.withColumn("alias", unmarked(F.trim("said"))).join(aliases, "alias", "left")
    own = F.array_union(F.array_distinct(F.filter(F.split(unmarked(F.lit(client)), r"\s+"), lambda w: w != "")), F.array(*map(F.lit, CLIENT_WORDS)))
    parts = F.filter(F.split(F.replace("alias", F.lit("."), F.lit(" ")), r"\s+"), lambda w: (w != "") & ~w.isin(*PARTICLES))
    short = F.when(F.size(parts) >= 2, F.initcap(F.array_join(F.slice(parts, 1, 2), " "))).otherwise(F.trim("said"))
    clients = (F.size(parts) > 0) & (F.size(F.array_except(parts, own)) == 0)
    keyed = named.where(F.col("name").isNotNull() | ~clients).select("rec_id", "seg", F.coalesce("name", short).alias("actor")).where("actor <> ''")
    return keyed.groupBy("actor").agg(F.count(F.lit(1)).alias("notes")).orderBy(F.desc("notes"), "actor").limit(top)


def bare(text: Column) -> Column:
    return F.substring(normalize_text(F.regexp_replace(text, r"^[\p{P}\s]+|[\p{P}\s]+$", "")), 1, 60)


def verify_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes whose first 60 normalised characters stand in the normalised transcript. quotes: quote, texto."""
    return quotes.where((bare(F.col("quote")) != "") & F.contains(normalize_text(F.col("texto")), bare(F.col("quote"))))


def dedup_quotes(quotes: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The earliest of equal quotes (first 70 normalised characters), a few of each tone in order of time."""
    caps = caps or {"positivo": 6, "negativo": 8, "neutral": 5}
    rows = quotes.withColumn("_k", F.substring(normalize_text(F.col("quote")), 1, 70))
    order = ["momento", "rec_id", "seg"]
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_r = 1")
    cap = F.coalesce(*(F.when(F.col("sentiment") == k, v) for k, v in caps.items()), F.lit(0))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("sentiment").orderBy(*order))).where(F.col("rank") <= cap).drop("_k", "_r")


def topic_section(tagged: DataFrame, first: int = 12) -> DataFrame:
    """Notes that touch a topic but don't name the client: topic, rank by time, counts of the topic."""
    rows = tagged.where(~F.col("mention") & (F.size("topics") > 0)).withColumn("topic", F.explode("topics"))
    own = Window.partitionBy("topic")
    got = rows.withColumn("notes", F.count(F.lit(1)).over(own)).withColumn("neg", F.count_if(F.col("sentiment") == "negativo").over(own))
    return got.withColumn("rank", F.row_number().over(own.orderBy("momento", "rec_id", "seg"))).where(F.col("rank") <= first).select("topic", "rank", "rec_id", "seg", "notes", "neg")


def topic_counts(tagged: DataFrame) -> DataFrame:
    """topic, notes, pos, neu, neg, first_quote over notes that touch a topic but don't name the client; the earliest quote."""
    rows = tagged.where(~F.col("mention") & (F.size("topics") > 0)).withColumn("topic", F.explode("topics"))
    first = F.min_by("quote", F.when(F.col("quote").isNotNull(), F.struct("momento", "rec_id", "seg"))).alias("first_quote")
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("notes"), _tone("positivo").alias("pos"), _tone("neutral").alias("neu"), _tone("negativo").alias("neg"), first)


def observations(summary: DataFrame, stations: DataFrame, profile: DataFrame) -> DataFrame:
    """rule, detail: what the tables of shares, stations and times call for."""
    each = stations.select(F.when(F.col("reading") == "critical", "critical station").when((F.col("notes") >= 10) & (F.col("neu") >= 0.6 * F.col("notes")), "factual station").alias("rule"), F.col("medio").alias("detail")).where("rule is not null")
    silent = stations.agg(F.count_if(F.col("reading") == "silent").alias("n")).where("n > 0").select(F.lit("silent stations").alias("rule"), F.col("n").cast("string").alias("detail"))
    ratio = summary.where("pos > 0 and neg > pos").select(F.lit("more criticism than praise").alias("rule"), F.round(F.col("neg") / F.col("pos"), 1).cast("string").alias("detail"))
    drop = day_drop(profile).select(F.lit("falling volume").alias("rule"), F.col("percent").cast("string").alias("detail"))
    return each.union(silent).union(ratio).union(drop)


def report_tables(tagged: DataFrame, client: str, period: str, noise: tuple[str, ...], aliases: DataFrame, name: str, quotes: DataFrame) -> DataFrame:
    """One long frame: client, period, section, key, notes, pos, neu, neg, text. aliases and name: the client's as in
    actors(); quotes: those of the client's notes, of which the verified and different ones are counted by tone."""
    stations, summary, profile = media_table(tagged), share_summary(tagged), time_profile(tagged)
    said = dedup_quotes(verify_quotes(quotes)).groupBy("sentiment").agg(F.count(F.lit(1)).alias("notes"))
    topics = topic_section(tagged).select(F.col("topic").alias("key"), "notes", "neg").distinct()
    parts = [
        summary.select(F.lit("summary").alias("section"), F.lit("").alias("key"), "notes", "pos", "neu", "neg", F.col("balance").alias("text")),
        stations.select(F.lit("stations").alias("section"), F.col("medio").alias("key"), "notes", "pos", "neu", "neg", F.col("reading").alias("text")),
        profile.select("section", "key", "notes"),
        top_axes(axes(tagged, noise)).select(F.lit("axes").alias("section"), F.col("axis").alias("key"), "notes", "pos", "neu", "neg"),
        actors(tagged, aliases, name).select(F.lit("actors").alias("section"), F.col("actor").alias("key"), "notes"),
        said.select(F.lit("quotes").alias("section"), F.col("sentiment").alias("key"), "notes"),
        topics.select(F.lit("topics").alias("section"), "key", "notes", "neg"),
        observations(summary, stations, profile).select(F.lit("observations").alias("section"), F.col("rule").alias("key"), F.col("detail").alias("text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(F.lit(client).alias("client"), F.lit(period).alias("period"), "section", "key", "notes", "pos", "neu", "neg", "text")


def mentions_export(notes: DataFrame, stations: DataFrame, topics: DataFrame, now: Column, most: int = 4000) -> DataFrame:
    """The newest notes of 48 hours with their station's name and reach, text cut at 1,500 characters back to a space, lists of
    eight, and a topic. notes: rec_id, seg, medio, momento, texto, people, tipo; stations: medio, name, audience; topics: tipo, topic."""
    rows = notes.where((F.col("momento") >= now - F.expr("interval 48 hours")) & (F.col("momento") <= now)).join(stations, "medio").join(topics, "tipo", "left")
    cut = F.concat(F.regexp_extract(F.substring("texto", 1, 1500), r"(?s)^(.*)\s", 1), F.lit("…"))
    got = rows.select("rec_id", "seg", "name", "momento", F.when(F.length("texto") > 1500, cut).otherwise(F.col("texto")).alias("texto"), F.slice("people", 1, 8).alias("people"), F.coalesce("topic", F.lit("Otro")).alias("topic"), (F.bround(F.col("audience") * 4e6 / 100) * 100).cast("long").alias("reach"))
    return got.orderBy(F.desc("momento"), "rec_id", "seg").limit(most)


def weekly_draft(approved: DataFrame, kept: DataFrame) -> DataFrame:
    """client, week, news, included. approved: client, news_id, momento; kept: client, news_id."""
    rows = approved.join(kept.withColumn("included", F.lit(True)), ["client", "news_id"], "left").withColumn("week", F.date_format(F.date_trunc("week", "momento"), "yyyy-MM-dd"))
    return rows.groupBy("client", "week").agg(F.count(F.lit(1)).alias("news"), F.count("included").alias("included"))


def daily_kpis(news: DataFrame) -> DataFrame:
    """day, processed, published, mean review minutes. news: created (minutes), reviewed, estado."""
    day = F.floor(F.col("created") / 1440).cast("long")
    return news.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("estado") == "publicada").alias("published"), F.round(F.avg(F.col("reviewed") - F.col("created")), 6).alias("review_minutes"))


def queue_sizes(news: DataFrame) -> DataFrame:
    """day, queue: how many news wait at the end of each day on which one came or left. news: created and reviewed (minutes; reviewed null:
    still waiting). Arrivals and departures are summed by day, and those sums over stretches of days, then inside each stretch:
    the windows see a row a day and a row a stretch, and none holds all days."""
    day = lambda c: F.floor(F.col(c) / 1440).cast("long")
    ends = F.array(F.struct(day("created").alias("day"), F.lit(1).alias("d")), F.struct(day("reviewed").alias("day"), F.lit(-1).alias("d")))
    moves = news.select(F.explode(ends).alias("e")).where("e.day is not null").groupBy("e.day").agg(F.sum("e.d").alias("d"))
    moves = moves.withColumn("stretch", F.floor(F.col("day") / 512))
    before = F.coalesce(F.sum("d").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = moves.groupBy("stretch").agg(F.sum("d").alias("d")).select("stretch", before.alias("base"))
    own = F.sum("d").over(Window.partitionBy("stretch").orderBy("day"))
    return moves.withColumn("own", own).join(base, "stretch").select("day", (F.col("own") + F.col("base")).alias("queue"))


def precision(suggestions: DataFrame) -> DataFrame:
    """client, suggested, kept, precision."""
    got = suggestions.groupBy("client").agg(F.count(F.lit(1)).alias("suggested"), F.count_if(F.col("estado") != "descartada").alias("kept"))
    return got.withColumn("precision", share(F.col("kept"), F.col("suggested")))
