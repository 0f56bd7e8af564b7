"""Search by linked entities: a posting table says which news names which entity on which day, and the postings of all wanted
entities are intersected before any note is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.text import normalize_entity


def _as_entity(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows (tipo, key) with `entity`: that of resolved (tipo, key, entity; each key once), else the key itself."""
    return rows.join(resolved.select("tipo", "key", F.col("entity").alias("_to")), ["tipo", "key"], "left").withColumn("entity", F.coalesce("_to", "key")).drop("_to")


def entity_postings(links: DataFrame, resolved: DataFrame, news: DataFrame) -> DataFrame:
    """tipo, entity, day, news_id, each once. links: version_id, tipo, key (entity_links); resolved: resolve_mentions; news: version_id,
    news_id, day."""
    return _as_entity(links, resolved).join(news.select("version_id", "news_id", "day"), "version_id").select("tipo", "entity", "day", "news_id").distinct()


def news_naming(postings: DataFrame, wanted: DataFrame, resolved: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """news_id of news that name all wanted entities, within the days (both included). wanted: tipo, name: a few rows, of whatever spelling
    or alias resolved knows. Without any, no news."""
    own = wanted.select("tipo", normalize_entity(F.col("name"), F.col("tipo")).alias("key"))
    own = _as_entity(own, resolved).select("tipo", "entity").distinct()
    many = own.agg(F.count(F.lit(1)).alias("many"))
    rows = postings
    if first is not None:
        rows = rows.where(F.col("day") >= first)
    if last is not None:
        rows = rows.where(F.col("day") <= last)
    hits = rows.join(own, ["tipo", "entity"], "left_semi").groupBy("news_id").agg(F.count_distinct("tipo", "entity").alias("n"))
    return hits.join(F.broadcast(many), hits.n == F.col("many")).select("news_id")  # one row


def facets(notes: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n of every dimension and of the whole (dimension `all`), by grouping sets in one pass."""
    cells = notes.groupingSets([[c] for c in dimensions] + [[]], *dimensions).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # The id has a bit for each dimension, the first one's highest, which is 0 where rows are grouped by it.
    whole = (1 << len(dimensions)) - 1
    name, value = F.lit("all"), F.lit(None).cast("string")
    for k, c in enumerate(dimensions):
        here = F.col("g") == whole - (1 << (len(dimensions) - 1 - k))
        name, value = F.when(here, c).otherwise(name), F.when(here, F.col(c).cast("string")).otherwise(value)
    return cells.select(name.alias("dimension"), value.alias("value"), "n")


def faceted_search(notes: DataFrame, postings: DataFrame, wanted: DataFrame, resolved: DataFrame, dimensions: list[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Facets of the notes (news_id, dimensions) whose news name all wanted entities."""
    return facets(notes.join(news_naming(postings, wanted, resolved, first, last), "news_id", "left_semi"), dimensions)
