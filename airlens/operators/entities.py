"""Entity resolution: exact keys, acronyms, near spellings, links and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.functions.text import acronym, normalize_entity
from airlens.operators.graph import checkpointed
from airlens.operators.spellings import FAR, LARGE, near_ids

RATIO, LEAST_LENGTH = 0.92, 10
#: Characters of the n-grams that near spellings are found by.
GRAM = 3
#: Tasks of a core, where work is more than its bytes tell.
TASKS = 4


def _by_halves(keys: DataFrame, edits: Callable[[Column], Column]) -> DataFrame:
    """tipo, x, y, seen_x, seen_y, n, m: pairs of keys (tipo, key, seen, n; x is the shorter one) of up to LARGE edits, and others that share
    as much. keys are read several times, in the same order."""
    limits = tuple(r[1] for r in sorted(keys.sparkSession.range(FAR + 1).select("id", edits(F.col("id"))).collect()))
    known = keys.withColumn("id", F.monotonically_increasing_id())
    ids = near_ids(known.select("id", F.xxhash64("tipo").alias("salt"), "key"), limits)
    side = lambda k: known.select(F.col("id").alias(k), F.col("tipo").alias(f"tipo_{k}"), F.struct("n", "key", "seen").alias(f"of_{k}"))
    met = ids.join(side("x"), "x").join(side("y"), "y").where("tipo_x = tipo_y").select(F.col("tipo_x").alias("tipo"), F.least("of_x", "of_y").alias("x"), F.greatest("of_x", "of_y").alias("y"))
    return met.select("tipo", F.col("x.key").alias("x"), F.col("y.key").alias("y"), F.col("x.seen").alias("seen_x"), F.col("y.seen").alias("seen_y"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))


def _by_grams(keys: DataFrame, most: Column) -> DataFrame:
    """The same for keys of which `most` (edits against the longest partner) is any number."""
    starts = F.sequence(F.lit(1), F.col("n") - (GRAM - 1))
    grams = F.transform(starts, lambda i: F.struct(F.substr("key", i, F.lit(GRAM)).alias("gram"), i.alias("at")))
    # An n-gram's second place in a key is another n-gram than its first.
    grams = F.transform(grams, lambda x: F.struct(x["gram"].alias("gram"), F.size(F.filter(grams, lambda y: (y["gram"] == x["gram"]) & (y["at"] <= x["at"]))).alias("nth"), x["at"].alias("at")))
    rows = keys.select("tipo", "key", "seen", "n", F.explode(grams).alias("g")).select("tipo", "key", "seen", "n", "g.*")
    often = rows.groupBy("tipo", "gram", "nth").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("tipo", "key").orderBy("often", "gram", "nth"))
    rare = checkpointed(rows.join(often, ["tipo", "gram", "nth"]).withColumn("rank", rank).where(F.col("rank") <= GRAM * most + 1).select("tipo", "gram", "nth", "key", "seen", "n", "at"))
    # The shorter one asks for each length that its partner may have.
    asked = rare.select("tipo", "gram", "nth", F.col("key").alias("x"), F.col("seen").alias("seen_x"), "n", F.explode(F.sequence(F.col("n"), F.col("n") + most)).alias("m"))
    near = asked.join(rare.select("tipo", "gram", "nth", F.col("key").alias("y"), F.col("seen").alias("seen_y"), F.col("n").alias("m")), ["tipo", "gram", "nth", "m"])
    return near.select("tipo", "x", "y", "seen_x", "seen_y", "n", "m").distinct()


def fuzzy_link(keys: DataFrame, ratio: float = RATIO) -> DataFrame:
    """a, b, tipo, ratio of key pairs (a before b by `seen`) of one type, both of ten characters or more, whose
    Ratcliff-Obershelp ratio reaches the bound. keys: tipo, key, seen.

    At that ratio at most d = 8 % of both lengths together are inserted or deleted. Up to d = LARGE (74 letters together) pairs meet at
    hashes of what they must share (`spellings`): the whole keys but for a letter or more, or parts of them where more is edited. So only keys
    meet that are nearly equal, and not all keys with a frequent word. For longer keys, which are few, an
    edit spoils GRAM of a key's character n-grams at most: of the rarest GRAM * d + 1 n-grams of either key one is among those of the
    other (a prefix filter). Lengths and a bounded edit distance are checked natively before the
    ratio itself.
    """
    slack = 1 - ratio
    longest = (1 + slack) / (1 - slack)  # how much longer a partner can be
    n = F.length("key")
    edits = lambda both: F.floor(slack * both + 1e-9).cast("int")
    most = edits(F.col("n") + F.floor(F.col("n") * longest))
    tasks = TASKS * keys.sparkSession.sparkContext.defaultParallelism
    long = checkpointed(keys.where(n >= LEAST_LENGTH).select("tipo", "key", "seen", n.alias("n")).repartition(tasks, "key"))
    beyond = lambda both: (edits(both) > LARGE) | (both > FAR)
    near = _by_halves(long, edits)
    near = near.unionByName(_by_grams(long.where(beyond(F.col("n") + F.floor(F.col("n") * longest))), most).where(beyond(F.col("n") + F.col("m"))))
    limit = edits(F.col("n") + F.col("m"))
    near = near.where(((F.col("n") < F.col("m")) | (F.col("x") < F.col("y"))) & (F.col("m") - F.col("n") <= limit))
    near = near.where(F.levenshtein("x", "y") <= limit).select("tipo", "x", "y", "seen_x", "seen_y")
    first = (F.col("seen_x") < F.col("seen_y")) | ((F.col("seen_x") == F.col("seen_y")) & (F.col("x") < F.col("y")))
    pairs = near.select("tipo", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [SequenceMatcher(None, y, x).ratio() for x, y in zip(batch["a"], batch["b"])]
            batch = batch.assign(ratio=got)[["tipo", "a", "b", "ratio"]]
            yield batch[batch["ratio"] >= ratio]

    return pairs.repartition(tasks, "a").mapInPandas(exact, "tipo string, a string, b string, ratio double")


def keyed(mentions: DataFrame, key: Callable[[Column, Column], Column] = normalize_entity) -> DataFrame:
    """mentions (tipo, name, seen) with their key; names that normalise to nothing are left out."""
    return mentions.withColumn("key", key(F.col("name"), F.col("tipo"))).where("key <> ''")


def counted_keys(mentions: DataFrame) -> DataFrame:
    """tipo, key, seen (first), mentions of mentions (tipo, name, seen). Names are counted before they are normalised, each once."""
    names = mentions.groupBy("tipo", "name").agg(F.min("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    return keyed(names).groupBy("tipo", "key").agg(F.min("seen").alias("seen"), F.sum("n").alias("mentions"))


def resolve_mentions(mentions: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """tipo, key, entity (its key), how, mentions of mentions (tipo, name, seen). A catalog (tipo, key, aliases) has been
    seen before all of them; of its entries the first by key owns an alias that several claim, and a key is no alias.

    In order of first appearance a key is an entity or alias already known (`catalog`), the acronym of an entity made
    before it (`alias`), or spelled nearly as a key before it (`fuzzy`: the best ratio, then the earliest), whose entity it
    then has too, or it becomes an entity (`exact`). Entities alone claim acronyms, the first that has one, unless that
    is a key seen before. (Acronyms of ten letters or more are not compared by spelling.)
    """
    keys = counted_keys(mentions)
    if catalog is None:
        catalog = keys.sparkSession.createDataFrame([], "tipo string, key string, aliases array<string>")
    stored = catalog.select("tipo", "key", F.col("key").alias("entity"), F.lit(0).alias("order"))
    stored = stored.union(catalog.select("tipo", F.explode("aliases").alias("alias"), "key", F.lit(1)))
    stored = stored.groupBy("tipo", "key").agg(F.min(F.struct("order", "entity")).alias("x")).select("tipo", "key", F.col("x.entity").alias("entity"))
    both = keys.join(stored, ["tipo", "key"], "full").select("tipo", "key", F.when(F.col("entity").isNull(), F.col("seen")).alias("seen"), "entity", "mentions")
    # What is stored comes before all that is seen.
    both = checkpointed(both.withColumn("at", F.coalesce(F.col("seen"), F.lit(-(1 << 62)))))

    order = both.select("tipo", F.col("key").alias("a"), "at")
    best = F.row_number().over(Window.partitionBy("tipo", "b").orderBy(F.desc("ratio"), "at", "a"))
    near = fuzzy_link(both.select("tipo", "key", F.col("at").alias("seen"))).join(order, ["tipo", "a"]).withColumn("r", best).where("r = 1")
    near = near.select("tipo", F.col("b").alias("key"), F.col("a").alias("near"))
    found = both.join(near, ["tipo", "key"], "left")
    made = found.where("entity is null and near is null").withColumn("alias", acronym(F.col("key"))).where("alias is not null")
    owners = made.groupBy("tipo", "alias").agg(F.min(F.struct("at", "key")).alias("x")).select("tipo", F.col("alias").alias("key"), F.col("x.key").alias("owner"), F.col("x.at").alias("owned"))
    found = found.join(owners, ["tipo", "key"], "left")
    short = F.col("owner").isNotNull() & (F.col("owned") <= F.col("at"))
    how = F.when(F.col("entity").isNotNull(), "catalog").when(short, "alias").when(F.col("near").isNotNull(), "fuzzy").otherwise("exact")
    next_key = F.coalesce("entity", F.when(short, F.col("owner")), "near", "key")
    links = checkpointed(found.select("tipo", "key", next_key.alias("entity"), how.alias("how"), "mentions"))
    # An alias of an alias has the entity of that: chains halve in each round. What is its own entity stays.
    own, chained = links.where("key = entity"), links.where("key <> entity")
    while True:
        ahead = chained.select("tipo", F.col("key").alias("entity"), F.col("entity").alias("further"))
        moved = chained.join(ahead, ["tipo", "entity"], "left")
        new = checkpointed(moved.select("tipo", "key", F.coalesce("further", "entity").alias("entity"), "how", "mentions", F.col("further").isNotNull().alias("moved")))
        chained = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return own.unionByName(chained).where("mentions is not null")


def entity_links(versions: DataFrame, linked: DataFrame, key: Callable[[Column, Column], Column] = normalize_entity) -> DataFrame:
    """version_id, tipo, key of versions not linked yet, each once. versions: version_id, people, organizations, locations.
    key: of a name and its kind; as a rule without titles."""
    todo = versions.join(linked.select("version_id").distinct(), "version_id", "left_anti")
    kinds = (("people", "persona"), ("organizations", "institucion"), ("locations", "lugar"))
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("tipo"), x.alias("name"))
    each = F.explode(F.concat(*(F.transform(F.coalesce(c, F.array().cast("array<string>")), named(kind)) for c, kind in kinds)))
    rows = todo.select("version_id", each.alias("e")).select("version_id", "e.tipo", key(F.col("e.name"), F.col("e.tipo")).alias("key"))
    return rows.where("key <> ''").dropDuplicates(["version_id", "tipo", "key"])


def top_terms(entities: DataFrame, top: int = 60) -> DataFrame:
    """One row, terms: the most frequent keys, joined by a comma."""
    best = entities.groupBy("key").agg(F.sum("mentions").alias("n")).orderBy(F.desc("n"), "key").limit(top)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "key")))
    return best.agg(F.array_join(F.transform(ordered, lambda x: x["key"]), ", ").alias("terms"))
