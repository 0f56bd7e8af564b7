"""The corpus pipeline: documents through toxicity, language, near-duplicate and packing stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared folder
and reads it again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm import crowds, langid, neardup, packing, toxicity
from airlens.llm.common import discard, recorded, table, written
from airlens.llm.queries import WORDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores from its threshold on go; null and empty texts stay. Rows that repeat are
    judged each."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those that share too few n-grams, too far out of place, with every learned
    language. Rows that repeat are judged each."""
    return langid.known(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Of rows with one id and one text one stays (the
    first by its columns as JSON); rows of one id with different texts are one document and stay or go together. Rows
    without an id stay."""
    found = written(neardup.near_duplicates(docs), "groups")
    gone = written(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    several = written(found.where("doc_id is not null and kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeats")
    gone, several = (F.broadcast(x) if x.count() <= crowds.BROADCAST_IDS else x for x in (gone, several))
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = out.join(several, "doc_id", "left_semi").select(docs.columns)
    order = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
    rank = next(x for x in (f"_rank{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns)
    once = again.withColumn(rank, order).where(F.col(rank) == 1).drop(rank)
    return out.join(several, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, in pieces with their places in sequences of 2,048 tokens. Rows that repeat are packed each."""
    return packing.pack(docs, WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Tokenizers and fitted models can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. A stage's scratch tables, and the one before's result, go once its own is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
