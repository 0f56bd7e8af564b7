"""URL filter: rules first, then the ratio of two character language models, in DataFrame operations alone.

The rules' own verdicts label URLs as accepted or rejected. For either class a variable-order Markov model is
counted over characters (contexts of up to three; digits count as one symbol, what is outside a small alphabet
as another), each order smoothed by the one below: p(c|ctx) = (n(ctx c) + LAMBDA p(c|shorter)) / (n(ctx) +
LAMBDA). A URL's score is the mean, over its characters, of the difference of log-likelihoods; it is accepted
from a threshold on that best separates labelled URLs that the models were not counted on.

The alphabet has 38 symbols, so the models have at most 38**4 + 38**3 + 38**2 + 38 rows (2.2 million, in
practice tens of thousands), whatever the input: each order is broadcast to the step that needs it. A null URL or one
without `://` has an empty host and path and no rule; a null or empty URL scores 0. A URL's score depends on the URL
alone, so rows that repeat, or lack a page_id, are judged as any other with that URL. Very long URLs are scored whole.
Of equally good thresholds the one nearest to 0 is taken. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import split_join, written

#: host, path, verdict
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
ORDER = 4
LAMBDA = 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict (null where no rule fits); of several rules the longest holds."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for at, under, kind in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(under)
        rule, verdict = F.when(fits, F.lit(at + under)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumns({"rule": rule, "verdict": verdict})


def _symbols(url: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(plain, "[^a-z0./:?=&#_-]", "~")


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each character: it and the three before it."""
    text = rows.select(*keep, F.concat(F.lit("^" * (ORDER - 1)), _symbols(F.col("url"))).alias("u"))
    at = text.select(*keep, "u", F.explode(F.sequence(F.lit(1), F.length("u") - (ORDER - 1))).alias("i")).where(F.length("u") >= ORDER)
    return at.select(*keep, F.substr("u", F.col("i"), F.lit(ORDER)).alias("g"))


def models(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labelled: url, accepted (boolean). Log ratios by n-gram (gram, lr), and what a context adds where it is known
    and the character after it is not (context, more)."""
    counts = _grams(labelled, "accepted").groupBy("g").agg(F.count_if("accepted").cast("double").alias("a"), F.count_if(~F.col("accepted")).cast("double").alias("r"))
    counts = written(counts, "grams")
    lower = None  # gram, pa, pr of the order below
    frames, contexts = [], []
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.right("g", F.lit(k)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        ctx = own.groupBy(F.left("gram", F.lit(k - 1)).alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        own = own.withColumn("context", F.left("gram", F.lit(k - 1))).join(ctx, "context")
        if lower is None:
            size = 38
            own = own.withColumns({"pa": (F.col("a") + LAMBDA / size) / (F.col("ca") + LAMBDA), "pr": (F.col("r") + LAMBDA / size) / (F.col("cr") + LAMBDA)})
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
            own = own.withColumn("suffix", F.right("gram", F.lit(k - 1))).join(below, "suffix")
            own = own.withColumns({"pa": (F.col("a") + LAMBDA * F.col("la")) / (F.col("ca") + LAMBDA), "pr": (F.col("r") + LAMBDA * F.col("lr")) / (F.col("cr") + LAMBDA)})
        lower = written(own.select("gram", "pa", "pr"), f"order-{k}")
        frames.append(lower.select("gram", (F.ln("pa") - F.ln("pr")).alias("lr")))
        contexts.append(ctx.select("context", (F.ln(F.col("cr") + LAMBDA) - F.ln(F.col("ca") + LAMBDA)).alias("more")))
    ratios, more = frames[0], contexts[0]
    for x, y in zip(frames[1:], contexts[1:]):
        ratios, more = ratios.union(x), more.union(y)
    return written(ratios, "ratios"), written(more, "contexts")


def scored(urls: DataFrame, ratios: DataFrame, more: DataFrame) -> DataFrame:
    """url, score (rounded, so that the order of summing doesn't show), once for each different URL with characters."""
    rows = _grams(urls.select("url").distinct(), "url")
    value: Column = F.lit(0.0)
    for k in range(1, ORDER + 1):
        own, context = ratios.where(F.length("gram") == k), more.where(F.length("context") == k - 1)
        rows = rows.withColumn(f"g{k}", F.right("g", F.lit(k))).withColumn(f"c{k}", F.left(F.right("g", F.lit(k)), F.lit(k - 1)))
        rows = rows.join(F.broadcast(own.select(F.col("gram").alias(f"g{k}"), F.col("lr").alias(f"lr{k}"))), f"g{k}", "left")
        rows = rows.join(F.broadcast(context.select(F.col("context").alias(f"c{k}"), F.col("more").alias(f"m{k}"))), f"c{k}", "left")
        value = F.coalesce(F.col(f"lr{k}"), value + F.coalesce(f"m{k}", F.lit(0.0)))
    return rows.select("url", value.alias("v")).groupBy("url").agg(F.round(F.avg("v"), 9).alias("score"))


def calibrated(labelled: DataFrame) -> float:
    """labelled: score, accepted. The score from which on accepting best separates the two classes (the sum of both
    classes' rates of right verdicts is largest; of equal ones the nearest to 0). 0 without rows of both classes."""
    step = labelled.select(F.round(F.col("score") * 50).alias("at"), "accepted")
    bins = step.groupBy("at").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))  # some hundred rows
    below = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (1 - F.try_divide(F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(whole))) + F.try_divide(F.coalesce(F.sum("r").over(below), F.lit(0)), F.sum("r").over(whole))
    best = bins.withColumn("rate", rate).where("rate is not null").orderBy(F.desc("rate"), F.abs("at"), "at").first()
    return (best["at"] - 0.5) / 50 if best else 0.0


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score."""
    rows = ruled(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")), rules)
    known = rows.where("verdict is not null").select("page_id", "url", (F.col("verdict") == "allow").alias("accepted"))
    aside = F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0  # calibrated on a quarter, counted on the rest
    ratios, more = models(known.where(~aside))
    scores = written(scored(rows, ratios, more), "scores")
    total = pages.count()
    threshold = calibrated(split_join(known.where(aside), scores, ["url"], "page_id", total).select("score", "accepted"))
    out = split_join(rows, scores, ["url"], "page_id", total, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")
