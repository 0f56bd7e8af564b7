"""Query surface and editorial state: lists, search, queues, the command log, version history, profiles, facets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import share
from airlens.operators.words import numbered


def news_list(news: DataFrame, versions: DataFrame, recordings: DataFrame, programmes: DataFrame, stations: DataFrame) -> DataFrame:
    """Four left joins: the current version, the recording, its programme (programa_id, programa, medio) and that one's station;
    news without any of them stay. Order by the caller: newest first."""
    out = news.join(versions, "news_id", "left").join(recordings, "rec_id", "left")
    return out.join(programmes, "programa_id", "left").join(stations, "medio", "left")


def filtered(rows: DataFrame, first: str | None = None, last: str | None = None, **wanted: str | None) -> DataFrame:
    """Rows that fit all the filters given: momento within local days (both included), and for any other column its value, or
    that the list holds it."""
    if first is not None or last is not None:
        rows = rows.where(in_local_days(F.col("momento"), first or "0001-01-01", last or "9999-12-31"))
    for column, value in wanted.items():
        if value is not None:
            listed = rows.schema[column].dataType.typeName() == "array"
            rows = rows.where(F.array_contains(column, value) if listed else F.col(column) == value)
    return rows


def tabs(rows: DataFrame) -> DataFrame:
    """medio ('-' for none) with its count, and the total."""
    return rows.groupBy(F.coalesce("medio", F.lit("-")).alias("medio")).agg(F.count(F.lit(1)).alias("n")).union(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("medio"), "n"))


def in_local_days(momento: Column, first: str, last: str) -> Column:
    """Both days included, six hours behind UTC."""
    day = F.to_date(momento - F.expr("interval 6 hours"))
    return (day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date"))


def terms_of(text: str) -> list[str]:
    return [t for t in text.split(" ") if len(t) >= 2][:8]


def search(rows: DataFrame, text: str, columns: list[str], limit: int, order: list) -> DataFrame:
    """Rows with any of the words (two letters or more, the first eight) in any of the columns, `%` and `_` as in SQL; no
    words, no rows."""
    found = F.lit(False)
    for term in terms_of(text):
        for c in columns:
            found = found | F.coalesce(F.ilike(F.col(c), F.lit(f"%{term}%")), F.lit(False))
    return rows.where(found).orderBy(*order).limit(limit)


def search_expanded(rows: DataFrame, text: str, extra: list[str], columns: list[str], limit: int, order: list, key: list[str]) -> DataFrame:
    """With fewer than three hits, those of further words follow that were not found already."""
    first = search(rows, text, columns, limit, order)
    have = {t.lower() for t in terms_of(text)}
    more = " ".join(t for t in extra if t.lower() not in have)
    few = first.agg(F.count(F.lit(1)).alias("hits")).where("hits < 3")
    second = search(rows, more, columns, limit, order).join(first.select(*key), key, "left_anti").withColumn("_one", F.lit(1)).join(F.broadcast(few.select(F.lit(1).alias("_one"))), "_one", "left_semi").drop("_one")
    return first.withColumn("part", F.lit(1)).unionByName(second.withColumn("part", F.lit(2)))


def pending(rows: DataFrame, done: DataFrame, key: str, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows not done yet, in order, from an offset on."""
    return rows.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).offset(offset).limit(limit)


def version_history(versions: DataFrame, *fields: str) -> DataFrame:
    """A null field is that of the version before; `current` marks the last version of each news item."""
    order = Window.partitionBy("news_id").orderBy("numero")
    filled = {f: F.last(f, True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for f in fields}
    last = F.max("numero").over(Window.partitionBy("news_id"))
    return versions.withColumns(filled).withColumn("current", F.col("numero") == last)


def corrections(versions: DataFrame, field: str) -> DataFrame:
    """How often a version changes the field of the one before, by role."""
    before = F.lag(field).over(Window.partitionBy("news_id").orderBy("numero"))
    return versions.where(F.col(field).isNotNull()).withColumn("_b", before).groupBy("role").agg(F.count_if((F.col("_b") != F.col(field))).alias("changed"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest completed run of each recording. runs: rec_id, run_id, finished, estado."""
    return runs.where("estado = 'completed'").groupBy("rec_id").agg(F.max_by("run_id", F.struct("finished", "run_id")).alias("run_id"))


def requeue_order(rows: DataFrame, first: Column) -> DataFrame:
    """position: the prioritised ones first, each part by `t`."""
    got = numbered(rows.withColumn("_first", first), F.desc("_first"), "t", "rec_id")
    return got.withColumn("position", F.col("n") - 1).drop("_first", "n")


def client_profiles(profiles: DataFrame, tenants: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return profiles.join(tenants, "tenant_id").select("tenant_id", "name", *(F.coalesce(c, none).alias(c) for c in ("persons", "bodies", "topics")))


def profile_match(notes: DataFrame, profiles: DataFrame) -> DataFrame:
    """tenant_id, rec_id, seg, matched_on, score: the lists of a profile of which a term is in the note's text, and their share.
    Profiles (some hundreds of rows, written by hand) are one broadcast row of structs, so notes are not crossed."""
    whole = profiles.agg(F.collect_list(F.struct("tenant_id", "persons", "bodies", "topics")).alias("profiles"))
    rows = notes.withColumn("_t", F.lower(F.concat_ws(" ", "title", "summary"))).withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")
    each = rows.select("rec_id", "seg", "_t", F.explode("profiles").alias("p"))
    hit = lambda c: F.exists(F.col(f"p.{c}"), lambda x: F.contains(F.col("_t"), F.lower(x)))
    lists = ("persons", "bodies", "topics")
    matched = F.array_compact(F.array(*(F.when(hit(c), c) for c in lists)))
    filled = sum(((F.size(f"p.{c}") > 0).cast("int") for c in lists), F.lit(0))
    got = each.select("p.tenant_id", "rec_id", "seg", matched.alias("m"), filled.alias("n")).where(F.size("m") > 0)
    return got.select("tenant_id", "rec_id", "seg", F.array_join("m", "|").alias("matched_on"), share(F.size("m"), F.col("n")).alias("score"))


def facets(rows: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value, n in one pass."""
    cell = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions)))
    return rows.select(cell.alias("c")).groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))


def publish_approved(suggestions: DataFrame, approved: DataFrame) -> DataFrame:
    """Confirmed suggestions of approved news are published on its (first) day; discarded ones and other news stay as they are."""
    got = suggestions.join(approved.groupBy("news_id").agg(F.min("day").alias("day")), "news_id", "left")
    go = F.col("day").isNotNull() & (F.col("estado") == "confirmada")
    return got.select("client", "news_id", F.when(go, "publicada").otherwise(F.col("estado")).alias("estado"), F.when(go, F.col("day")).alias("published"))


def step(state: tuple, action: str, who: str) -> tuple[tuple, str | None]:
    """One command on one news item: state (estado, holder) -> new state, or a reason why not."""
    estado, holder = state
    if action == "start":
        return (("en_revision", who), None) if estado == "pendiente" else (state, "not pending")
    if action in ("draft", "approve", "reject"):
        if estado != "en_revision":
            return state, "not in review"
        if holder != who:
            return state, "held by another"
        return {"draft": ("en_revision", who), "approve": ("aprobada", None), "reject": ("rechazada", None)}[action], None
    return state, "unknown command"


def apply_commands(commands: DataFrame) -> DataFrame:
    """A log of commands (news_id, at, event_id, action, who) folded in order for each news item: event_id, estado after it,
    holder, reason where it was refused. Rows come sorted by news item, so any number of commands streams through."""
    rows = commands.repartition("news_id").sortWithinPartitions("news_id", "at", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        news, state = None, ("pendiente", None)
        for batch in batches:
            out = []
            for n, e, action, who in zip(batch["news_id"], batch["event_id"], batch["action"], batch["who"]):
                if n != news:
                    news, state = n, ("pendiente", None)
                state, reason = step(state, action, who)
                out.append((n, e, state[0], state[1], reason))
            yield pd.DataFrame(out, columns=["news_id", "event_id", "estado", "holder", "reason"])

    return rows.select("news_id", "event_id", "action", "who").mapInPandas(fold, "news_id long, event_id long, estado string, holder string, reason string")


def assign_queue(starts: DataFrame, queue: DataFrame) -> DataFrame:
    """Who reviews what: the n-th request (at, event_id, who) takes the n-th oldest pending item (news_id, created); requests
    beyond the queue are refused."""
    asks = numbered(starts.select("event_id", "at", "who"), "at", "event_id")
    items = numbered(queue, "created", "news_id")
    return asks.join(items.select("n", "news_id"), "n", "left").select("event_id", "who", "news_id", F.when(F.col("news_id").isNull(), "empty queue").alias("reason"))
