"""Block classification: repair, exclusion by one model or by consensus, disagreement, the review queue."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import control_sample
from airlens.operators.words import islands

#: Block types that are no news.
JUNK = ("publicidad", "religioso", "promo", "musica", "relleno")


class Policy(NamedTuple):
    types: tuple[str, ...]
    votes: int
    confidence: float = 0.0


POLICIES = {
    "conservadora-v1": Policy(("publicidad", "religioso", "musica"), 3),
    "minima": Policy(("publicidad", "musica"), 3),
    "un-solo-modelo": Policy(("publicidad", "religioso", "musica"), 1),
}


def junk(kind: Column) -> Column:
    return kind.isin(*JUNK)


def normalize_partition(blocks: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Blocks (model, rec_id, start_word, end_word, tipo, confidence) made to cover lo..hi of each recording once:
    clipped, cut where an earlier block covers, gaps filled with `desconocido` of confidence 0. A recording
    needs one row at least, for its lo and hi."""
    # One shuffle and one sort: what can't be used comes last, and a recording's last row knows where its blocks end.
    usable = F.coalesce((F.col("start_word") <= F.col("end_word")) & (F.col("start_word") <= F.col("_hi")) & (F.col("end_word") >= F.col("_lo")), F.lit(False))
    own = blocks.withColumns({"_lo": lo, "_hi": hi}).withColumn("_ok", usable)
    key = ["model", "rec_id"]
    order = Window.partitionBy(*key).orderBy(F.desc("_ok"), "start_word", "end_word", "tipo")
    end = F.when(F.col("_ok"), F.least("end_word", "_hi"))
    covered, all_lo, all_hi = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.max("_lo").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = own.select(*key, "tipo", "confidence", "start_word", "_lo", "_ok", end.alias("_to"), covered.alias("_covered"), all_lo.alias("_first"), all_hi.alias("_end"), F.lead(F.lit(1)).over(order).isNull().alias("_last"))
    placed = placed.withColumn("_cursor", F.greatest(F.col("_lo"), F.coalesce(F.col("_covered") + 1, F.col("_lo")))).withColumn("_from", F.greatest("start_word", "_cursor"))
    part = lambda when, a, b, *kind: F.when(when, F.struct(a.cast("int").alias("start_word"), b.cast("int").alias("end_word"), kind[0].alias("tipo"), kind[1].cast("double").alias("confidence")))
    kept, unknown = F.col("_ok") & (F.col("_from") <= F.col("_to")), (F.lit("desconocido"), F.lit(0.0))
    tail = F.coalesce(F.greatest("_covered", "_to") + 1, F.col("_first"))
    parts = F.array_compact(F.array(
        part(kept, F.col("_from"), F.col("_to"), F.col("tipo"), F.col("confidence")),
        part(kept & (F.col("_from") > F.col("_cursor")), F.col("_cursor"), F.col("_from") - 1, *unknown),
        part(F.col("_last") & (tail <= F.col("_end")), tail, F.col("_end"), *unknown),
    ))
    return placed.select(*key, F.explode(parts).alias("p")).select(*key, "p.*")


def exclude_single(blocks: DataFrame, threshold: float, types: tuple[str, ...] = ("publicidad", "musica")) -> DataFrame:
    return blocks.where(F.col("tipo").isin(*types) & (F.col("confidence") >= threshold))


def cells(blocks: DataFrame) -> DataFrame:
    """A row for each block and word."""
    return blocks.withColumn("index", F.explode(F.sequence("start_word", "end_word")))


def stretches(blocks: DataFrame, *others: DataFrame) -> DataFrame:
    """Blocks cut where a block of any of the frames begins or ends: `at`, the first word, and `n`, the words. Two blocks
    that share words share whole stretches, so a join on rec_id and `at` weighs overlaps without a row a word."""
    ends = F.explode(F.array("start_word", F.col("end_word") + 1))
    points = blocks.select("rec_id", ends.alias("point"))
    for other in others:
        points = points.union(other.select("rec_id", ends.alias("point")))
    cuts = points.groupBy("rec_id").agg(F.array_sort(F.collect_set("point")).alias("_cuts"))
    own = blocks.where("start_word <= end_word").join(cuts, "rec_id")
    inside = F.filter("_cuts", lambda x: (x >= F.col("start_word")) & (x <= F.col("end_word")))
    after = F.concat(F.slice(inside, 2, F.size("_cuts")), F.array(F.col("end_word") + 1))
    cut = F.explode(F.zip_with(inside, after, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))))
    return own.withColumn("_cut", cut).drop("_cuts").select("*", "_cut.at", "_cut.n").drop("_cut")


def exclude_consensus(blocks: DataFrame, policy: Policy) -> DataFrame:
    """rec_id, lo, hi, n_words: runs of words that enough models call one of the policy's types. Votes are summed
    over the ends of blocks (+1 and -1), so long blocks cost two rows, not one a word."""
    voting = blocks.where(F.col("tipo").isin(*policy.types) & (F.col("confidence") >= policy.confidence))
    steps = voting.select("rec_id", F.explode(F.array(F.struct(F.col("start_word").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end_word") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    sums = steps.groupBy("rec_id", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    order = Window.partitionBy("rec_id").orderBy("at")
    levels = sums.withColumn("votes", F.sum("step").over(order)).withColumn("upto", F.lead("at").over(order) - 1)
    runs = levels.where(F.col("votes") >= policy.votes)
    fresh = F.when(F.lag("upto").over(order) == F.col("at") - 1, 0).otherwise(1)
    grouped = runs.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy("rec_id", "_g").agg(F.min("at").alias("lo"), F.max("upto").alias("hi"))
    return out.select("rec_id", F.col("lo").cast("int"), F.col("hi").cast("int"), (F.col("hi") - F.col("lo") + 1).cast("long").alias("n_words"))


def consensus_by_words(blocks: DataFrame, policy: Policy) -> DataFrame:
    """The same by counting every word, for short blocks and as a check."""
    voting = blocks.where(F.col("tipo").isin(*policy.types) & (F.col("confidence") >= policy.confidence))
    got = cells(voting).groupBy("rec_id", "index").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= policy.votes)
    return islands(got.select("rec_id", "index"), "rec_id")


def disagreement(blocks: DataFrame, other: DataFrame) -> DataFrame:
    """Adds flip, agree (shares of the words that the other model covers) and priority 1 to 5."""
    theirs = stretches(other, blocks).select("rec_id", "at", F.col("tipo").alias("_tipo"))
    both = stretches(blocks, other).join(theirs, ["rec_id", "at"])
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    got = both.groupBy("rec_id", "idx").agg(part(junk(F.col("tipo")) != junk(F.col("_tipo"))).alias("flip"), part(F.col("tipo") == F.col("_tipo")).alias("agree"))
    out = blocks.join(got, ["rec_id", "idx"], "left")
    priority = F.when(F.col("flip").isNull(), 5).when(F.col("flip") >= 0.5, 1).when(F.col("flip") > 0, 2).when(F.col("agree") < 1, 4).when(control_sample(F.col("rec_id"), F.col("idx")), 3).otherwise(5)
    return out.withColumns({"prioridad": priority, "flip": F.round(F.coalesce("flip", F.lit(0.0)), 6), "agree": F.round(F.coalesce("agree", F.lit(0.0)), 6)})


def consensus_stratum(blocks: DataFrame, ranges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Blocks of these types wholly inside a consensus range."""
    b, r = blocks.where(F.col("tipo").isin(*types)).alias("b"), ranges.alias("r")
    return b.join(r, (F.col("b.rec_id") == F.col("r.rec_id")) & (F.col("b.start_word") >= F.col("r.lo")) & (F.col("b.end_word") <= F.col("r.hi")), "left_semi")


def priority_report(ranked: DataFrame) -> DataFrame:
    """Per priority: n, percent, mean disagreement, minutes of review at 20 s a block."""
    got = ranked.groupBy("prioridad").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 - F.col("agree")), 6).alias("mean_disagreement"))
    total = F.sum("n").over(Window.partitionBy())
    return got.withColumn("percent", F.round(100 * F.col("n") / total, 6)).withColumn("minutes", F.round(F.col("n") * 20 / 60, 6))


def next_batch(ranked: DataFrame, verdicts: DataFrame, leases: DataFrame, validator: str, now: int, limit: int) -> DataFrame:
    """The next blocks of a model for a validator: not judged by them, free, leased by them or with a lease over 45 minutes
    old. ranked, verdicts and leases (holder, since in minutes) tell model, rec_id and idx."""
    key = ["model", "rec_id", "idx"]
    mine = verdicts.where(F.col("validador") == validator).select(*key)
    open_ = ranked.join(mine, key, "left_anti").join(leases.select(*key, "holder", "since"), key, "left")
    free = F.col("holder").isNull() | (F.col("holder") == validator) | (F.col("since") < now - 45)
    return open_.where(free).orderBy("prioridad", "agree", "rec_id", "idx").limit(min(max(limit, 1), 200)).select("rec_id", "idx", "prioridad")


def latest_verdicts(verdicts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The last verdict of each validator on each known block; a correction to the model's own type is an ok."""
    known = verdicts.join(blocks.select("rec_id", "idx", "model", "tipo"), ["rec_id", "idx", "model"])
    last = F.row_number().over(Window.partitionBy("rec_id", "idx", "model", "validador").orderBy(F.desc("ts"), "tipo_real"))
    ok = F.col("ok") | (F.col("tipo_real") == F.col("tipo"))
    return known.withColumn("_r", last).where("_r = 1").select("rec_id", "idx", "model", "validador", ok.alias("ok"), F.when(~ok, F.col("tipo_real")).alias("tipo_real"))


def urgent_recordings(ranked: DataFrame, top: int = 8) -> DataFrame:
    """The recordings with the largest share of blocks of priority 1 and 2; of equal ones the first by rec_id."""
    got = ranked.groupBy("rec_id").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg((F.col("prioridad") <= 2).cast("int")), 6).alias("urgent"))
    return got.orderBy(F.desc("urgent"), "rec_id").limit(top)


def models(blocks: DataFrame) -> DataFrame:
    return blocks.select("model").distinct()


def progress(blocks: DataFrame, verdicts: DataFrame, model: str) -> DataFrame:
    """who (all, judged or a validator), n, of one model's blocks."""
    blocks, verdicts = (x.where(F.col("model") == model) for x in (blocks, verdicts))
    total = blocks.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("who"), "n")
    judged = verdicts.agg(F.count_distinct("rec_id", "idx").alias("n")).select(F.lit("judged").alias("who"), "n")
    each = verdicts.groupBy(F.col("validador").alias("who")).agg(F.count(F.lit(1)).alias("n"))
    return total.union(judged).union(each)


def select_eval_set(recordings: DataFrame, n: int, slots: tuple[int, ...] = (6, 9, 12, 15, 18, 21)) -> DataFrame:
    """n recordings: the i-th pick is of station i mod M at local hour slots[i mod 6], nearest on the 24-hour circle, newest
    first, none twice. recordings: rec_id, medio, hora_local, t. Stations are independent, so each is a group;
    it needs its newest recordings of each hour only: at most n / M + 1 an hour."""
    stations = recordings.select("medio").distinct()
    names = stations.withColumn("m", F.row_number().over(Window.orderBy("medio")) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    newest = F.row_number().over(Window.partitionBy("medio", "hora_local").orderBy(F.desc("t"), "rec_id"))
    rows = recordings.withColumn("r", newest).where(F.col("r") <= n).join(names, "medio")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        left = group.sort_values(["t", "rec_id"], ascending=[False, True]).reset_index(drop=True)
        out = []
        for i in range(int(group["m"].iloc[0]), n, int(group["total"].iloc[0])):
            if left.empty:
                break
            apart = (left["hora_local"] - slots[i % len(slots)]).abs()
            k = pd.concat([apart, 24 - apart], axis=1).min(axis=1).idxmin()
            out.append((i, int(left["rec_id"][k])))
            left = left.drop(index=k)
        return pd.DataFrame(out, columns=["pick", "rec_id"]).astype("int64")

    return rows.groupBy("medio").applyInPandas(pick, "pick long, rec_id long")
