"""Reports for many clients at once: one scan of the notes finds every client's terms, one aggregation counts every section.

1. Terms. All terms of all clients (names and watched topics) form one Aho-Corasick automaton over normalised text, built once a
   worker process from a list of bounded size. Terms match whole words. A note leaves the scan as one row a client that it concerns, and one more for
   the count of all notes.
2. Cells. Each such row is spread over the cells it counts in (summary, station, day, hour, axis, actors, topics, quote), and one `groupBy`
   with partial sums counts all cells of all clients and periods. Cells are few, and written once.
3. Sections are made from the cells alone: shares, readings, ranks, first quotes, observations.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import normalize_text, unmarked
from airlens.operators.graph import checkpointed
from airlens.operators.report import CLIENT_WORDS, PARTICLES, bare, local

#: Terms that one automaton holds; more are taken in blocks of whole clients, each with a scan of its own.
TERMS = 100_000
TONES = (("positivo", "pos"), ("neutral", "neu"), ("negativo", "neg"))
#: Quotes of a tone that a report counts at most, rows of ranked sections, and letters that tell quotes apart.
QUOTES, TOP_AXES, TOP_ACTORS, QUOTE_KEY = {"positivo": 6, "negativo": 8, "neutral": 5}, 6, 10, 70
_HITS = "array<struct<client string, mention boolean, topics array<string>>>"


def term_blocks(terms: DataFrame) -> Iterator[list[tuple[str, str, str | None]]]:
    """terms: client, term, topic (null: the term names the client). Normalised, without repeats, in blocks of whole clients."""
    rows = terms.select("client", normalize_text(F.col("term")).alias("term"), "topic").where("client is not null and term <> ''").distinct()
    held: list[tuple[str, str, str | None]] = []
    for row in rows.orderBy("client", "term", "topic").toLocalIterator():
        if len(held) >= TERMS and row.client != held[-1][0]:
            yield held
            held = []
        held.append((row.client, row.term, row.topic))
    if held:
        yield held


def hits_of(text: Column, terms: list[tuple[str, str, str | None]]) -> Column:
    """For normalised text the clients that it concerns: client, mention, topics."""
    by_term = defaultdict(list)
    for client, term, topic in terms:
        by_term[term].append((client, topic))
    built = []

    def automaton() -> ahocorasick.Automaton:
        if not built:
            found = ahocorasick.Automaton()
            for term, owners in by_term.items():
                found.add_word(f" {term} ", owners)
            found.make_automaton()
            built.append(found)
        return built[0]

    def one(line: str | None) -> list[dict]:
        got: dict[str, tuple[list[bool], set[str]]] = {}
        for _, owners in automaton().iter(f" {line or ''} ") if by_term else ():
            for client, topic in owners:
                mention, topics = got.setdefault(client, ([], set()))
                mention.append(True) if topic is None else topics.add(topic)
        return [{"client": client, "mention": bool(mention), "topics": sorted(topics)} for client, (mention, topics) in sorted(got.items())]

    @F.pandas_udf(_HITS)
    def found(lines: pd.Series) -> pd.Series:
        return lines.map(one)

    return found(text)


def tag_clients(notes: DataFrame, terms: list[tuple[str, str, str | None]]) -> DataFrame:
    """Notes by client, and each once more with client null. notes: rec_id, seg, medio, momento, sentiment, title, summary, people,
    keywords, and quote and texto (may be null). Adds period (local month), client, mention, topics."""
    blob = normalize_text(F.concat_ws(" ", "title", "summary", F.array_join("people", " "), F.array_join("keywords", " ")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("client"), F.lit(False).alias("mention"), F.array().cast("array<string>").alias("topics")))
    rows = notes.withColumn("_hit", F.explode(F.concat(hits_of(blob, terms), none)))
    return rows.select(*notes.columns, F.date_format(local(F.col("momento")), "yyyy-MM").alias("period"), "_hit.*")


def actor_names(people: Column, own: Column, aliases: dict[str, str]) -> Column:
    """Canonical names of people, as in report.actors: by alias, else their first two words without particles; names made
    of the client's own words alone are left out. aliases: written by hand, in lower case without marks."""
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else None

    def name(said: Column) -> Column:
        alias = unmarked(F.trim(said))
        parts = F.filter(F.split(F.replace(alias, F.lit("."), F.lit(" ")), r"\s+"), lambda w: (w != "") & ~w.isin(*PARTICLES))
        short = F.when(F.size(parts) >= 2, F.initcap(F.array_join(F.slice(parts, 1, 2), " "))).otherwise(F.trim(said))
        kept = F.when((F.size(parts) > 0) & (F.size(F.array_except(parts, own)) == 0), None).otherwise(short)
        return F.coalesce(F.try_element_at(known, alias), kept) if known is not None else kept

    return F.filter(F.transform(people, name), lambda a: a.isNotNull() & (a != ""))


def cells(tagged: DataFrame, terms: list[tuple[str, str, str | None]], noise: tuple[str, ...], aliases: dict[str, str]) -> DataFrame:
    """client, period, section, key, notes, pos, neu, neg, first (the earliest note's tone and quote among those with a
    quote). Sections of a client: summary, stations, day, hour, axes, actors, quote of notes that name it, topics of others; client
    null: stations alone, all notes. A client's own words are those of its names."""
    names = defaultdict(set)
    for client, term, topic in terms:
        if topic is None:
            names[client] |= set(term.split())
    words = tagged.sparkSession.createDataFrame([(c, sorted(w)) for c, w in names.items()], "client string, own array<string>")
    # As many rows as the block has clients.
    rows = tagged.join(F.broadcast(words), "client", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    at = local(F.col("momento"))
    spoken = F.filter(F.split(normalize_text(F.array_join("keywords", " ")), " "), lambda w: (w != "") & ~w.isin(*noise))
    axis = F.array_join(F.slice(F.filter(spoken, lambda w: ~F.array_contains(F.col("own"), w)), 1, 2), " ")
    cell = lambda section, key: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))
    said = F.when((bare(F.col("quote")) != "") & F.contains(normalize_text(F.col("texto")), bare(F.col("quote"))), F.substring(normalize_text(F.col("quote")), 1, QUOTE_KEY))
    own = F.array_union(F.col("own"), F.array(*map(F.lit, CLIENT_WORDS)))
    no = F.array().cast("array<struct<section string, key string>>")
    named = F.concat(
        F.array(cell("summary", F.lit("")), cell("stations", F.col("medio")), cell("day", F.date_format(at, "yyyy-MM-dd")), cell("hour", F.date_format(at, "HH"))),
        F.when(axis != "", F.array(cell("axes", axis))).otherwise(no),
        F.transform(actor_names(F.col("people"), own, aliases), lambda a: cell("actors", a)),
        F.when(said.isNotNull(), F.array(cell("quote", said))).otherwise(no),
    )
    spread = F.when(F.col("client").isNull(), F.array(cell("stations", F.col("medio")))).when(F.col("mention"), named).otherwise(F.transform("topics", lambda t: cell("topics", t)))
    out = rows.select("client", "period", "momento", "rec_id", "seg", "sentiment", "quote", F.explode(spread).alias("c"))
    first = F.min(F.when(F.col("quote").isNotNull() & F.col("section").isin("quote", "topics"), F.struct("momento", "rec_id", "seg", "sentiment", "quote")))
    out = out.select("client", "period", "momento", "rec_id", "seg", "sentiment", "quote", "c.*")
    return out.groupBy("client", "period", "section", "key").agg(F.count(F.lit(1)).alias("notes"), *(F.count_if(F.col("sentiment") == k).alias(a) for k, a in TONES), first.alias("first"))


def sections(found: DataFrame) -> DataFrame:
    """The report's rows from its cells (a table): client, period, section, rank, key, notes, pos, neu, neg, universe,
    percent, text."""
    whole = found.where("client is null").select("period", F.col("key").alias("medio"), F.col("notes").alias("universe"))
    own = found.where("client is not null")
    reports = own.select("client", "period").distinct()
    counts = ["notes", "pos", "neu", "neg"]
    n, pos, neu, neg = (F.col(c) for c in counts)
    percent = F.round(100 * F.coalesce(F.try_divide(n, F.col("universe")), F.lit(0.0)), 6).alias("percent")
    balance = F.when(pos > neg, "favorable").when(neg > pos, "adverso").otherwise("equilibrado")
    total = reports.join(whole.groupBy("period").agg(F.sum("universe").alias("universe")), "period")
    summary = total.join(own.where("section = 'summary'"), ["client", "period"], "left").na.fill(0, counts)
    summary = summary.select("client", "period", F.lit("summary").alias("section"), F.lit("").alias("key"), *counts, "universe", percent, balance.alias("text"))
    reading = F.when(n == 0, "silent").when(n < 5, "low volume").when(neg >= pos + 3, "critical").when(pos >= neg + 3, "favourable").when(neu >= 0.6 * n, "factual").otherwise("mixed")
    stations = reports.join(whole, "period").join(own.where("section = 'stations'").withColumnRenamed("key", "medio"), ["client", "period", "medio"], "left").na.fill(0, counts)
    stations = stations.select("client", "period", F.lit("stations").alias("section"), F.col("medio").alias("key"), *counts, "universe", percent, reading.alias("text"))
    plain = own.where("section in ('day', 'hour', 'axes', 'actors', 'topics')").select("client", "period", "section", "key", *counts, F.when(F.col("section") == "topics", F.col("first.quote")).alias("text"))
    cap = F.coalesce(*(F.when(F.col("key") == k, v) for k, v in QUOTES.items()), F.lit(0))
    quotes = own.where("section = 'quote'").groupBy("client", "period", F.col("first.sentiment").alias("key")).agg(F.count(F.lit(1)).alias("many"), F.min_by("first.quote", "first").alias("text"))
    quotes = quotes.select("client", "period", F.lit("quotes").alias("section"), "key", F.least("many", cap).alias("notes"), "text")
    note = lambda rows, rule, detail: rows.select("client", "period", F.lit("observations").alias("section"), rule.alias("key"), detail.cast("string").alias("text"))
    rule = F.when(F.col("text") == "critical", "critical station").when((n >= 10) & (neu >= 0.6 * n), "factual station")
    days = own.where("section = 'day'").groupBy("client", "period").agg(F.min_by("notes", "key").alias("a"), F.max_by("notes", "key").alias("b"), F.count(F.lit(1)).alias("days"))
    silent = stations.where("text = 'silent'").groupBy("client", "period").agg(F.count(F.lit(1)).alias("many"))
    parts = [
        summary, stations, plain, quotes,
        note(stations.where(rule.isNotNull()), rule, F.col("key")), note(silent, F.lit("silent stations"), F.col("many")),
        note(summary.where("pos > 0 and neg > pos"), F.lit("more criticism than praise"), F.round(neg / pos, 1)),
        note(days.where("days > 1 and a > b"), F.lit("falling volume"), F.round(100 * (F.col("a") - F.col("b")) / F.col("a"), 1)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    by_key = F.when(F.col("section").isin("day", "hour"), None).otherwise(F.col("notes"))
    order = Window.partitionBy("client", "period", "section").orderBy(by_key.desc_nulls_last(), "key", "text")
    most = F.when(F.col("section") == "axes", TOP_AXES).when(F.col("section") == "actors", TOP_ACTORS).otherwise(1 << 30)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("client", "period", "section", "rank", "key", *counts, "universe", "percent", "text")


def client_reports(notes: DataFrame, terms: DataFrame, noise: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> DataFrame:
    """The reports of all clients with a note, by local month. Notes are read once for each TERMS terms."""
    out = None
    for block in term_blocks(terms):
        part = sections(checkpointed(cells(tag_clients(notes, block), block, noise, aliases or {})))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = sections(cells(tag_clients(notes, []), [], noise, {}))
    return out


def write_reports(reports: DataFrame, path: str) -> None:
    """Parquet by client and period. What is written again replaces its own clients and periods and no others; files are
    dealt by them, so that each folder gets few."""
    (reports.repartition("client", "period").sortWithinPartitions("client", "period", "section", "rank").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("client", "period").parquet(path))
