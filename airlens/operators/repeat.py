"""Repeated content by exact fingerprints of normalised word windows.

Exact hashes find text that is repeated to the letter, such as copies and licence lines; speech that is
recognised anew each time rarely repeats so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.text import unmarked


def normalised_words() -> Column:
    """The column `words`, each text normalised once with its words kept apart by line feeds."""
    plain = F.regexp_replace(F.regexp_replace(unmarked(F.array_join("words", "\n")), r"(?U)[^\p{L}\p{N}_\s]", " "), r"[^\S\n]+", " ")
    return F.split(plain, "\n")


def window_text(start: Column, size: int) -> Column:
    """What is left of the `size` normalised words from start on."""
    return F.trim(F.regexp_replace(F.array_join(F.slice("words", start + 1, F.lit(size)), " "), " +", " "))


def fingerprints(transcripts: DataFrame, size: int = 50, step: int = 25) -> DataFrame:
    """Windows of `size` words every `step`; shorter texts have none, words after the last window are in none."""
    starts = F.expr(f"if(size(words) >= {size}, sequence(0, size(words) - {size}, {step}), cast(array() as array<int>))")
    rows = transcripts.select("rec_id", "medio", normalised_words().alias("words"))
    rows = rows.select("rec_id", "medio", F.explode(F.transform(starts, lambda x: F.struct(x.alias("start_word"), window_text(x, size).alias("texto")))).alias("p"))
    return rows.select("rec_id", "medio", "p.start_word", "p.texto").where("texto <> ''").withColumn("huella", F.sha2("texto", 256))


def different_prints(transcripts: DataFrame, size: int = 50, step: int = 25) -> DataFrame:
    """rec_id, huella: each recording's different prints, found within its row, so that a stream needs no state for it."""
    starts = F.expr(f"if(size(words) >= {size}, sequence(0, size(words) - {size}, {step}), cast(array() as array<int>))")
    rows = transcripts.select("rec_id", normalised_words().alias("words"))
    texts = F.filter(F.transform(starts, lambda x: window_text(x, size)), lambda t: t != "")
    return rows.select("rec_id", F.explode(F.array_distinct(F.transform(texts, lambda t: F.sha2(t, 256)))).alias("huella"))


def repeated_index(prints: DataFrame) -> DataFrame:
    """huella, veces_visto (recordings), medios_distintos, primera and ultima (rec_id), muestra."""
    once = prints.groupBy("huella", "rec_id").agg(F.min("medio").alias("medio"), F.min(F.substring("texto", 1, 2000)).alias("texto"))
    return once.groupBy("huella").agg(F.count(F.lit(1)).alias("veces_visto"), F.count_distinct("medio").alias("medios_distintos"), F.min("rec_id").alias("primera"), F.max("rec_id").alias("ultima"), F.min_by("texto", "rec_id").alias("muestra"))


def ad_fingerprints(index: DataFrame, times: int = 5) -> DataFrame:
    """A person's override (es_publicidad) decides, else how often the print was seen."""
    return index.where(F.coalesce(F.col("es_publicidad"), F.col("veces_visto") >= times)).select("huella")


def skip_chunks(prints: DataFrame, ads: DataFrame, ratio: float = 0.75) -> DataFrame:
    """prints with a chunk: distinct known prints over all windows; chunks without a window are never skipped."""
    known = prints.join(ads.withColumn("ad", F.lit(True)), "huella", "left")
    got = known.groupBy("rec_id", "chunk").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct(F.when(F.col("ad"), F.col("huella"))).alias("known"))
    return got.withColumn("skipped", F.col("known") / F.col("windows") >= ratio)


def fingerprint_coverage(disputed: DataFrame, prints: DataFrame, latest: int = 25) -> DataFrame:
    """For disputed blocks (model, rec_id, medio, idx, start_word, end_word) the share of their windows whose print is in 2,
    3 and 5 recordings of the learning set: each station's latest recordings without those that are judged."""
    from pyspark.sql.window import Window

    judged = disputed.select("rec_id").distinct()
    recs = prints.select("rec_id", "medio").distinct().join(judged, "rec_id", "left_anti")
    recs = recs.withColumn("r", F.row_number().over(Window.partitionBy("medio").orderBy(F.desc("rec_id")))).where(F.col("r") <= latest)
    seen = prints.select("rec_id", "huella").distinct().join(recs.select("rec_id"), "rec_id", "left_semi").groupBy("huella").agg(F.count(F.lit(1)).alias("seen"))
    own = disputed.join(prints.select("rec_id", F.col("start_word").alias("w"), "huella"), "rec_id").where("w >= start_word and w + 49 <= end_word")
    got = own.join(seen, "huella", "left").groupBy("rec_id", "idx").agg(F.count(F.lit(1)).alias("windows"), *(F.count_if(F.col("seen") >= k).alias(f"in_{k}") for k in (2, 3, 5)))
    return disputed.select("rec_id", "idx").join(got, ["rec_id", "idx"], "left").na.fill(0)


def coverage_counts(covered: DataFrame) -> DataFrame:
    """seen_in, blocks, too_short, half, three_quarters: of disputed blocks how many have no window, and how many have at least 50 and 75 %
    of theirs in so many recordings. covered: fingerprint_coverage."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("seen_in"), F.col(f"in_{k}").alias("n")) for k in (2, 3, 5))))
    rows = covered.select("windows", each.alias("e")).select("windows", "e.*")
    part = lambda share: F.count_if((F.col("windows") > 0) & (F.col("n") >= share * F.col("windows")))
    return rows.groupBy("seen_in").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("windows") == 0).alias("too_short"), part(0.5).alias("half"), part(0.75).alias("three_quarters"))
