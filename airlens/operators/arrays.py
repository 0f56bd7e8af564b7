"""Transcripts as arrays: a recording is one row with its words in order and the ranges of them that are left, and what is done
with its words is done by slices of the row. No operator here makes a row a word.

    words   array of all words; a word's place is its index, which filtering doesn't change (null: no word has this index)
    starts, ends   arrays of their times, where times are asked for
    kept    sorted, disjoint ranges (lo, hi) of the indexes that are left; null: all

A recording's ranges meet in one row of it, by a shuffle on rec_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import custom_id

RANGES = "array<struct<lo int, hi int>>"


def range_of(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def kept_ranges() -> Column:
    every = F.when(F.size("words") > 0, F.array(range_of(F.lit(0), F.size("words") - 1))).otherwise(F.array().cast(RANGES))
    return F.coalesce("kept", every)


def with_kept(transcripts: DataFrame) -> DataFrame:
    return transcripts if "kept" in transcripts.columns else transcripts.withColumn("kept", F.lit(None).cast(RANGES))


def from_words(words: DataFrame) -> DataFrame:
    """Rows of words (rec_id, index, word, start, end), each index once, to transcripts; indexes without a word aren't kept."""
    one = words.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("index", "word", "start", "end"))).alias("w"))
    # Each word fills the places from the word before on, so that a place is an index again.
    at = F.transform("w", lambda x, i: F.when(i == 0, -1).otherwise(F.col("w")[i - 1]["index"]))
    one = one.withColumn("gap", F.zip_with("w", at, lambda x, b: x["index"] - b - 1))
    spread = lambda field, kind: F.flatten(F.zip_with("w", "gap", lambda x, g: F.concat(F.array_repeat(F.lit(None).cast(kind), g), F.array(x[field]))))
    runs = F.filter(F.transform("w", lambda x, i: F.struct(x["index"].alias("at"), ((i == 0) | (F.col("gap")[i] > 0)).alias("new"))), lambda x: x["new"])
    first = F.transform(runs, lambda x: x["at"])
    last = F.transform(F.filter(F.transform("w", lambda x, i: F.struct(x["index"].alias("at"), ((i == F.size("w") - 1) | (F.coalesce(F.get("gap", i + 1), F.lit(0)) > 0)).alias("end"))), lambda x: x["end"]), lambda x: x["at"])
    return one.select("rec_id", spread("word", "string").alias("words"), spread("start", "double").alias("starts"), spread("end", "double").alias("ends"), F.zip_with(first, last, range_of).alias("kept"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """rec_id, gone: a recording's ranges (rec_id, lo, hi) in order, those that overlap or touch as one; empty ones are left out."""
    own = Window.partitionBy("rec_id").orderBy("lo", "hi")
    rows = ranges.where("lo <= hi").select("rec_id", "lo", "hi")
    reach = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.coalesce(F.col("lo") > reach + 1, F.lit(True))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("rec_id", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("rec_id").agg(F.sort_array(F.collect_list(range_of(F.col("lo"), F.col("hi")))).alias("gone"))


def overlaps(ranges: Column, lo: Column, hi: Column) -> Column:
    """The parts of ranges within lo and hi."""
    cut = F.transform(ranges, lambda r: range_of(F.greatest(r["lo"], lo), F.least(r["hi"], hi)))
    return F.filter(cut, lambda r: r["lo"] <= r["hi"])


def length(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda s, r: s + r["hi"] - r["lo"] + 1)


def without(kept: Column, gone: Column) -> Column:
    """The parts of kept outside gone; both sorted and disjoint."""
    none = F.array().cast("array<int>")
    lows = F.concat(F.array(F.lit(0)), F.coalesce(F.transform(gone, lambda r: r["hi"] + 1), none))
    highs = F.concat(F.coalesce(F.transform(gone, lambda r: r["lo"] - 1), none), F.array(F.lit((1 << 31) - 1)))
    holes = F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    return F.flatten(F.transform(holes, lambda h: overlaps(kept, h["lo"], h["hi"])))


def filter_transcripts(transcripts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Transcripts without the words of their ranges (rec_id, lo, hi); indexes stay."""
    # What is kept is said before the join: who asks for no words shuffles none.
    both = with_kept(transcripts).withColumn("kept", kept_ranges()).join(merged_ranges(ranges), "rec_id", "left")
    return both.withColumn("kept", without(F.col("kept"), F.col("gone"))).drop("gone")


def word_digests(transcripts: DataFrame) -> DataFrame:
    """rec_id, n_words, text_hash (of the words joined by a space), n_letters of recordings with words: one row's work each."""
    letters = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return transcripts.where(F.size("words") > 0).select("rec_id", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("text_hash"), letters.alias("n_letters"))


def word_counts(transcripts: DataFrame) -> DataFrame:
    """rec_id, n_words, first_word, last_word, index_sum of what is left, for recordings with a word left."""
    total = F.aggregate("kept", F.lit(0).cast("long"), lambda s, r: s + ((r["lo"].cast("long") + r["hi"]) * (r["hi"] - r["lo"] + 1) / 2).cast("long"))
    rows = with_kept(transcripts).select("rec_id", kept_ranges().alias("kept")).where(F.size("kept") > 0)
    return rows.select("rec_id", length(F.col("kept")).alias("n_words"), F.element_at("kept", 1)["lo"].alias("first_word"), F.element_at("kept", -1)["hi"].alias("last_word"), total.alias("index_sum"))


def words_in(ranges: Column) -> Column:
    """The words of ranges, in order."""
    return F.flatten(F.transform(ranges, lambda r: F.slice("words", r["lo"] + 1, r["hi"] - r["lo"] + 1)))


def segment_texts(segments: DataFrame, transcripts: DataFrame, start_at: Callable[[Column], Column] | None = None, end_at: Callable[[Column], Column] | None = None) -> DataFrame:
    """rec_id, seg, texto, inicio, fin: the words left whose index is in the segment's range; without any, no row. transcripts
    with starts and ends; where times follow from the index, start_at and end_at say how, and no times are shuffled."""
    start_at, end_at = start_at or (lambda i: F.get("starts", i)), end_at or (lambda i: F.get("ends", i))
    both = segments.where("start_word <= end_word").select("rec_id", "seg", "start_word", "end_word").join(with_kept(transcripts), "rec_id")
    own = both.select("*", overlaps(kept_ranges(), F.col("start_word"), F.col("end_word")).alias("own")).where(F.size("own") > 0)
    return own.select("rec_id", "seg", F.array_join(words_in(F.col("own")), " ").alias("texto"), start_at(F.element_at("own", 1)["lo"]).alias("inicio"), end_at(F.element_at("own", -1)["hi"]).alias("fin"))


def _chunked(transcripts: DataFrame, size: int) -> DataFrame:
    """rec_id, words, chunk, own (the indexes of its words), before (all of the recording's)."""
    if size <= 0:
        raise ValueError("a chunk needs a size above 0")
    left = F.flatten(F.transform(kept_ranges(), lambda r: F.sequence(r["lo"], r["hi"])))
    rows = with_kept(transcripts).select("rec_id", "words", left.alias("left")).where(F.size("left") > 0)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size("left") - 1) / size).cast("int"))))
    return rows.withColumn("own", F.slice("left", F.col("chunk") * size + 1, F.lit(size)))


def chunks(transcripts: DataFrame, size: int = 600) -> DataFrame:
    """rec_id, chunk, lo, hi, n_words: chunks by position among the words left."""
    rows = _chunked(transcripts, size)
    return rows.select("rec_id", "chunk", F.element_at("own", 1).alias("lo"), F.element_at("own", -1).alias("hi"), F.size("own").cast("long").alias("n_words"))


def requests(transcripts: DataFrame, size: int = 600, context: int = 50, none: str = "(ninguno)") -> DataFrame:
    """custom_id, rec_id, chunk, lo, hi, body (`index:word ...`) and context (the last words of the chunk before)."""
    rows = _chunked(transcripts, size)
    body = F.array_join(F.transform("own", lambda i: F.concat(i.cast("string"), F.lit(":"), F.get("words", i))), " ")
    first = F.greatest(F.col("chunk") * size - min(context, size), F.lit(0))
    tail = F.array_join(F.transform(F.slice("left", first + 1, F.col("chunk") * size - first), lambda i: F.get("words", i)), " ")
    return rows.select(custom_id(F.col("rec_id"), F.col("chunk")).alias("custom_id"), "rec_id", "chunk", F.element_at("own", 1).alias("lo"), F.element_at("own", -1).alias("hi"), body.alias("body"), F.when(F.col("chunk") > 0, tail).otherwise(none).alias("context"))


def below(values: Column, limit: Column, equal: bool = False) -> Column:
    """How many of the sorted values are below limit (or equal to it), by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 1)).cast("int") + 1)
    half = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
    goes = lambda s: (F.get(values, half(s)) <= limit) if equal else (F.get(values, half(s)) < limit)
    step = lambda s, _: F.when(s["a"] >= s["b"], s).when(goes(s), F.struct((half(s) + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), half(s).alias("b")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.size(values).alias("b")), step)["a"]


def policy_damage(transcripts: DataFrame, news: DataFrame, excluded: DataFrame) -> DataFrame:
    """News windows (rec_id, seg, medio, inicio, fin, categoria), shrunk by two seconds on each side: their words that lie
    wholly inside, and how many of them the excluded ranges (rec_id, lo, hi) erase. Times of words rise with their index."""
    inner = news.select("rec_id", "seg", "medio", "categoria", (F.col("inicio") + 2).alias("_a"), (F.col("fin") - 2).alias("_b")).where("_a <= _b")
    times = with_kept(transcripts).select("rec_id", "words", "starts", "ends", "kept").join(merged_ranges(excluded), "rec_id", "left")
    both = inner.join(times, "rec_id")
    both = both.select("rec_id", "seg", "medio", "categoria", "words", "kept", "gone", below(F.col("starts"), F.col("_a")).alias("lo"), (below(F.col("ends"), F.col("_b"), equal=True) - 1).alias("hi"))
    own = both.withColumn("own", overlaps(kept_ranges(), F.col("lo"), F.col("hi"))).where(F.size("own") > 0)
    gone = F.aggregate("own", F.lit(0).cast("long"), lambda s, r: s + length(overlaps(F.coalesce("gone", F.array().cast(RANGES)), r["lo"], r["hi"])))
    return own.select("rec_id", "seg", "medio", "categoria", length(F.col("own")).alias("words"), gone.alias("erased"))
