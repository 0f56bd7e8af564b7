"""Operators on words and word ranges: chunks, requests, texts and times of segments, filters, islands.

A word's index is never renumbered: filtering leaves gaps, and every range refers to the original index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import custom_id
from airlens.operators.graph import checkpointed


def load_words(transcripts: DataFrame) -> DataFrame:
    """rec_id, words (array) -> a row a word."""
    return transcripts.select("rec_id", F.posexplode("words").alias("index", "word"))


def with_chunk(words: DataFrame, size: int = 600) -> DataFrame:
    """Chunks by position in the recording, not by index."""
    if size <= 0:
        raise ValueError("a chunk needs a size above 0")
    position = F.row_number().over(Window.partitionBy("rec_id").orderBy("index")) - 1
    return words.withColumn("chunk", F.floor(position / size).cast("int"))


def chunk_words(words: DataFrame, size: int = 600) -> DataFrame:
    return with_chunk(words, size).groupBy("rec_id", "chunk").agg(F.min("index").alias("lo"), F.max("index").alias("hi"), F.count(F.lit(1)).alias("n_words"))


def build_requests(words: DataFrame, size: int = 600, context: int = 50, none: str = "(ninguno)") -> DataFrame:
    """custom_id, rec_id, chunk, lo, hi, body (`index:word ...`) and context (the last words of the chunk before)."""
    own = with_chunk(words, size).groupBy("rec_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("index", "word"))).alias("w"))
    n = F.size("w")
    tail = F.array_join(F.transform(F.slice("w", F.greatest(n - (context - 1), F.lit(1)), F.lit(context)), lambda x: x["word"]), " ")
    before = F.lag("tail").over(Window.partitionBy("rec_id").orderBy("chunk"))
    out = own.withColumn("tail", tail).withColumn("context", F.coalesce(before, F.lit(none)))
    body = F.array_join(F.transform("w", lambda x: F.concat(x["index"].cast("string"), F.lit(":"), x["word"])), " ")
    return out.select(custom_id(F.col("rec_id"), F.col("chunk")).alias("custom_id"), "rec_id", "chunk", F.element_at("w", 1)["index"].alias("lo"), F.element_at("w", -1)["index"].alias("hi"), body.alias("body"), "context")


def profile_block(profiles: DataFrame, instructions: str) -> DataFrame:
    """One row, profiles: the clients (client_id, name, persons, bodies, topics; written by hand, some hundreds) as lines in
    order of client_id, empty lists left out, then the instructions."""
    line = F.concat(F.lit('- client_id: "'), "client_id", F.lit('"  ('), "name", F.lit(")"))
    labels = {"persons": "personas de interes", "bodies": "instituciones", "topics": "temas"}
    lists = (F.when(F.size(c) > 0, F.concat(F.lit(f"    {label}: "), F.array_join(c, ", "))) for c, label in labels.items())
    rows = profiles.select("client_id", F.concat_ws("\n", line, *lists).alias("lines"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("client_id", "lines"))).alias("p"))
    head = "PERFILES DE CLIENTE (para clasificar relevancia, no para segmentar):"
    return one.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("p", lambda x: x["lines"]), "\n"), F.lit(instructions)).alias("profiles"))


def with_profiles(requests: DataFrame, profiles: DataFrame, instructions: str) -> DataFrame:
    """Requests with the clients' block before their body; the block is one row, broadcast."""
    block = profile_block(profiles, instructions).withColumn("_one", F.lit(1))
    out = requests.withColumn("_one", F.lit(1)).join(F.broadcast(block), "_one")
    return out.withColumn("body", F.concat_ws("\n\n", "profiles", "body")).drop("_one", "profiles")


def load_text(transcripts: DataFrame, texts: DataFrame) -> DataFrame:
    """rec_id, texto: a recording's words joined by a space, or the plain text (rec_id, texto) where it has no words."""
    own = transcripts.select("rec_id", F.when(F.size("words") > 0, F.array_join("words", " ")).alias("_own"))
    return own.join(texts, "rec_id", "full").select("rec_id", F.coalesce("_own", "texto").alias("texto")).where("texto is not null")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `n`, from 1, in this order: rows are dealt by ranges of it and written, numbered within their range, and the
    ranges' counts (a row a partition) are summed up."""
    at = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = at.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    base = counts.select("_range", before.alias("_base"))
    return at.withColumn("n", own).join(base, "_range").withColumn("n", F.col("n") + F.col("_base")).drop("_range", "_base")


def ranked_by_id(rows: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """Adds `rank`, from 0, in the order of a numeric key, without gathering the rows in one task: counts by
    stretches of `width` keys are summed up, and rows are numbered within their stretch."""
    at = rows.withColumn("_at", F.floor(F.col(key) / width))
    counts = at.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_at", before.alias("_base"))
    own = F.row_number().over(Window.partitionBy("_at").orderBy(key)) - 1
    return at.withColumn("rank", own).join(base, "_at").withColumn("rank", F.col("rank") + F.col("_base")).drop("_at", "_base")


def split_accounts(requests: DataFrame, accounts: int) -> DataFrame:
    """Whole recordings dealt round-robin in order of rec_id, so that stitching stays local."""
    recs = ranked_by_id(requests.select("rec_id").distinct(), "rec_id")
    return requests.join(recs.select("rec_id", (F.col("rank") % accounts).cast("int").alias("account")), "rec_id")


def map_words_to_time(segments: DataFrame, words: DataFrame, pad: float = 2.0, duration: Column | None = None) -> DataFrame:
    """Clip times of segments, padded and held within the recording; `error` where an index has no word."""
    first = words.select("rec_id", F.col("index").alias("start_word"), F.col("start").alias("_from"))
    last = words.select("rec_id", F.col("index").alias("end_word"), F.col("end").alias("_to"))
    out = segments.join(first, ["rec_id", "start_word"], "left").join(last, ["rec_id", "end_word"], "left")
    until = F.col("_to") + pad
    ok = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    return out.select(
        segments["*"], F.when(ok, F.greatest(F.lit(0.0), F.col("_from") - pad)).alias("clip_inicio"),
        F.when(ok, until if duration is None else F.least(until, duration)).alias("clip_fin"), F.when(~ok, "missing word").alias("error"),
    )


def segment_text_times(segments: DataFrame, words: DataFrame) -> DataFrame:
    """rec_id, seg, texto, inicio, fin: the words whose index is in the segment's range; without any, no row."""
    # A row for each index that a segment asks for, so that words are met by an equi join and not each by all segments.
    asked = segments.where("start_word <= end_word").select("rec_id", "seg", F.explode(F.sequence("start_word", "end_word")).alias("index"))
    inside = words.join(asked, ["rec_id", "index"])
    got = inside.groupBy("rec_id", "seg").agg(F.sort_array(F.collect_list(F.struct("index", "word"))).alias("w"), F.min("start").alias("inicio"), F.max("end").alias("fin"))
    return got.select("rec_id", "seg", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("texto"), "inicio", "fin")


def filter_words(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Words in none of the recording's ranges (rec_id, lo, hi); indexes stay."""
    gone = ranges.where("lo <= hi").select("rec_id", F.explode(F.sequence("lo", "hi")).alias("index"))
    return words.join(gone, ["rec_id", "index"], "left_anti")


def islands(cells: DataFrame, *by: str) -> DataFrame:
    """Runs of consecutive indexes: by..., lo, hi, n_words. cells: by..., index, each once."""
    run = F.col("index") - F.row_number().over(Window.partitionBy(*by).orderBy("index"))
    return cells.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("index").alias("lo"), F.max("index").alias("hi"), F.count(F.lit(1)).alias("n_words")).drop("_run")
