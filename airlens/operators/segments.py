"""Operators on proposed segments: responses, stitching across chunk borders, caching, news, packing of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import parse_custom_id

RELEVANCE = "array<struct<client_id:string,relevant:boolean,score:double,rationale:string,matched_on:array<string>>>"
SEGMENT = (
    "struct<title:string,start_word:int,end_word:int,summary:string,keywords:array<string>,news_type:string,people:array<string>,"
    f"organizations:array<string>,locations:array<string>,boundary_status:string,confidence:double,client_relevance:{RELEVANCE}>"
)
RESPONSE = f"custom_id string, status int, error string, body struct<segments:array<{SEGMENT}>>, _corrupt_record string"

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def parse_responses(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """A line is JSON: custom_id, status, error, body. Each response with its chunk's range (rec_id, chunk, lo, hi)
    and `problem`: bad json, http, error, no segments; null where it can be used."""
    read = lines.select(F.from_json("line", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "line")
    rec, chunk = parse_custom_id(F.coalesce("r.custom_id", F.regexp_extract("line", '"custom_id": *"([^"]*)"', 1)))
    problem = F.when(F.col("r._corrupt_record").isNotNull() | F.col("r.custom_id").isNull(), "bad json").when(F.col("r.status") != 200, "http").when(F.col("r.error").isNotNull(), "error").when(F.col("r.body.segments").isNull(), "no segments")
    out = read.select(rec.cast("long").alias("rec_id"), chunk.alias("chunk"), problem.alias("problem"), F.col("r.body.segments").alias("segments"))
    return out.join(ranges.select("rec_id", "chunk", "lo", "hi"), ["rec_id", "chunk"], "left")


def collect_responses(parsed: DataFrame, clients: list[str] | None = None) -> DataFrame:
    """Segments of usable responses: within the chunk's range, without NUL, ten keywords at most, known clients; lists that
    are missing are empty."""
    own = parsed.where("problem is null").select("rec_id", "chunk", "lo", "hi", F.posexplode("segments").alias("seg", "s"))
    own = own.where("lo <= s.start_word and s.start_word <= s.end_word and s.end_word <= hi")
    clean = lambda c: F.regexp_replace(c, r"\x00", "")
    listed = lambda c: F.coalesce(F.transform(c, clean), F.array().cast("array<string>"))
    relevance = F.coalesce("s.client_relevance", F.array().cast(RELEVANCE))
    if clients is not None:
        relevance = F.filter(relevance, lambda x: x["client_id"].isin(*clients))
    return own.select(
        "rec_id", "chunk", "seg", F.col("s.start_word").alias("start_word"), F.col("s.end_word").alias("end_word"),
        clean(F.col("s.title")).alias("title"), clean(F.col("s.summary")).alias("summary"), F.slice(listed("s.keywords"), 1, 10).alias("keywords"),
        F.col("s.news_type").alias("news_type"), *(listed(f"s.{c}").alias(c) for c in ("people", "organizations", "locations")),
        F.coalesce("s.boundary_status", F.lit("complete")).alias("boundary_status"), F.col("s.confidence").alias("confidence"),
        relevance.alias("client_relevance"),
    )


def _union(left: Column, right: Column) -> Column:
    """Both lists in order, each value once without regard to case and blanks around it."""
    key = lambda x: F.lower(F.trim(x))
    add = lambda found, x: F.when(F.exists(found, lambda y: key(y) == key(x)), found).otherwise(F.array_append(found, x))
    return F.aggregate(F.concat(left, right), F.array().cast("array<string>"), add)


def stitch(segments: DataFrame) -> DataFrame:
    """Merges the first segment of a chunk into the last one before it, if the chunk before has any and the segment
    says that it continues. The merged one runs from the first one's start to the second's end; title, summary,
    news_type and client_relevance are those of the longer so far (of equal ones the first), lists are ordered unions
    without regard to case (ten keywords at most), confidence is the least. Alone, a segment stays as it is.

    Whether two neighbours merge is local, so groups come from a running sum; groups are short and are folded
    in order as arrays.
    """
    order = Window.partitionBy("rec_id").orderBy("chunk", "start_word", "seg")
    before = F.lag("chunk").over(order)
    merge = (before == F.col("chunk") - 1) & F.col("boundary_status").isin("continues_before_chunk", "continues_both")
    flagged = segments.withColumn("_new", F.when(merge, 0).otherwise(1))
    grouped = flagged.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    described, lists = ("title", "summary", "news_type", "client_relevance"), ("keywords", "people", "organizations", "locations")
    place = F.struct("chunk", "start_word", "seg").alias("place")
    parts = F.struct(place, "start_word", "end_word", *described, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists), "confidence")
    # Sorted by place alone: maps and lists of structs need no order.
    rows = grouped.groupBy("rec_id", "_group").agg(F.collect_list(parts).alias("p"))
    sort = lambda x, y: F.when(x["place"] < y["place"], -1).when(x["place"] > y["place"], 1).otherwise(0)
    rows = rows.withColumn("p", F.array_sort("p", sort))

    def joined(s: Column, x: Column) -> Column:
        longer = x["end_word"] - x["start_word"] > s["end_word"] - s["start_word"]
        unions = {c: _union(s[c], x[c]) for c in lists} | {"keywords": F.slice(_union(s["keywords"], x["keywords"]), 1, 10)}
        return F.struct(
            s["place"].alias("place"), s["start_word"].alias("start_word"), x["end_word"].alias("end_word"),
            *(F.when(longer, x[c]).otherwise(s[c]).alias(c) for c in described), *(unions[c].alias(c) for c in lists),
            F.least(s["confidence"], x["confidence"]).alias("confidence"),
        )

    fold = F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1), joined)
    out = rows.select("rec_id", (F.col("_group") - 1).cast("int").alias("story"), F.size("p").alias("n_parts"), fold.alias("f"))
    return out.select("rec_id", "story", "n_parts", "f.*").drop("place")


def cacheable(parsed: DataFrame, cached: DataFrame) -> DataFrame:
    """rec_ids all of whose chunks can be used and that are not cached yet."""
    failed = parsed.where("problem is not null").select("rec_id")
    return parsed.select("rec_id").distinct().join(failed, "rec_id", "left_anti").join(cached.select("rec_id"), "rec_id", "left_anti")


def materialise_news(cache: DataFrame, texts: DataFrame, done: DataFrame) -> DataFrame:
    """A news item with its first version for each cached segment of recordings without a completed run.
    cache: rec_id, seg, title, summary; texts: rec_id, seg, texto, inicio, fin."""
    todo = cache.join(done.select("rec_id").distinct(), "rec_id", "left_anti")
    clean = lambda c: F.regexp_replace(c, r"\x00", "")
    return todo.join(texts, ["rec_id", "seg"]).select(
        F.concat_ws("-", "rec_id", "seg").alias("news_id"), "rec_id", F.lit(1).alias("numero"), F.substring(clean(F.col("title")), 1, 500).alias("titulo"), clean(F.col("summary")).alias("resumen"),
        clean(F.col("texto")).alias("transcripcion"), F.col("inicio").alias("clip_inicio"), F.col("fin").alias("clip_fin"), F.lit("pendiente").alias("estado"),
    )


def client_suggestions(news: DataFrame) -> DataFrame:
    """news_id, client_id, score of relevant clients with well-formed ids, once a client and news."""
    rows = news.select("news_id", F.explode("client_relevance").alias("c")).where("c.relevant").where(F.col("c.client_id").rlike(UUID))
    return rows.groupBy("news_id", F.col("c.client_id").alias("client_id")).agg(F.max("c.score").alias("score")).withColumn("estado", F.lit("sugerida"))


def pack_by_budget(texts: DataFrame, budget: int = 150_000) -> DataFrame:
    """Blocks of each file in order into chunks: a new one where the next block would pass the budget and the
    chunk is not empty; then the first half of the chunks goes to account 0, the rest to 1.
    texts: file, pos, length. Rows come sorted by file and stream through, so a file may have any number."""
    rows = texts.select(F.col("file").cast("long"), F.col("pos").cast("int"), F.col("length").cast("long")).repartition("file").sortWithinPartitions("file", "pos")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, size, chunk = None, 0, 0
        for batch in batches:
            chunks = []
            for name, length in zip(batch["file"], batch["length"]):
                if name != file:
                    file, size, chunk = name, 0, 0
                elif size > 0 and size + length > budget:
                    size, chunk = 0, chunk + 1
                size += length
                chunks.append(chunk)
            yield batch.assign(chunk=np.array(chunks, np.int32))

    got = rows.mapInPandas(fold, "file long, pos int, length long, chunk int")
    counts = got.groupBy("file").agg((F.max("chunk") + 1).alias("n"))
    return got.join(counts, "file").select("file", "pos", "length", "chunk", F.when(F.col("chunk") < F.ceil(F.col("n") / 2), 0).otherwise(1).alias("account"))


def extract_items(replies: DataFrame) -> DataFrame:
    """Bodies after `NOTICIA n` in the replies of a file, in chunk order, numbered anew; replies that begin by
    saying there is nothing relevant are left out. replies: file, chunk, reply."""
    useful = replies.where(~F.substring("reply", 1, 80).contains("SIN NOTICIAS RELEVANTES"))
    rows = useful.select("file", "chunk", F.posexplode(F.regexp_extract_all("reply", F.lit(r"(?s)NOTICIA \d+:?\s*(.*?)(?=NOTICIA \d+|\z)"), F.lit(1))).alias("pos", "body"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("chunk", "pos"))
    return rows.select("file", "chunk", number.alias("number"), F.trim(F.regexp_replace("body", r"\s+", " ")).alias("body"))
