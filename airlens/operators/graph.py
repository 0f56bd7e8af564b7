"""Connected components and first-index greedy clusters as DataFrame iterations over checkpointed edges."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where that is unset and all run on one machine,
    as in tests, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="airlens-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its smallest id). Each round takes the least label among the neighbours and then that label's own
    label, so chains halve. nodes: id; edges: a, b."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "component", F.least("component", F.coalesce("least", "component")).alias("least"))
        jump = labels.select(F.col("id").alias("least"), F.col("component").alias("further"))
        new = checkpointed(step.join(jump, "least").select("id", F.col("component").alias("old"), F.least("least", "further").alias("component")))
        if new.where("old <> component").limit(1).count() == 0:
            return new.select("id", "component")
        labels = new.select("id", "component")


def leader_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, leader: taken in order of id, a node opens a cluster if no earlier leader is its neighbour, else it joins the
    first such leader. A node is decided once its earlier neighbours are: a few rounds in practice."""
    down = checkpointed(edges.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).where("early < late").distinct())
    state = checkpointed(nodes.select("id", F.lit(None).cast("long").alias("leader")))
    while state.where("leader is null").limit(1).count():
        around = down.join(state.select(F.col("id").alias("early"), F.col("leader").alias("l")), "early")
        # An earlier neighbour is a leader, a follower (l <> early) or not decided yet.
        seen = around.groupBy(F.col("late").alias("id")).agg(F.min(F.when(F.col("l") == F.col("early"), F.col("early"))).alias("first"), F.min(F.when(F.col("l").isNull(), F.col("early"))).alias("open"))
        joined = state.join(seen, "id", "left")
        decided = F.when(F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("open") > F.col("first"))), F.col("first")).when(F.col("first").isNull() & F.col("open").isNull(), F.col("id"))
        state = checkpointed(joined.select("id", F.coalesce("leader", decided).alias("leader")))
    return state
