"""Counts kept as a table of buckets, of which a micro-batch rewrites only those it touches.

    <path>/v=<number>/bucket=<b>/...   the buckets that batch <number> wrote
    <path>/manifests/<number>          bucket, version: where each bucket's latest rows are after that batch

A batch reads the manifest before its own, merges its changes with the buckets they fall in, and writes these and a new manifest. A batch that is run again
writes the same folders again, so a failure in between costs nothing but the work. A reader takes the latest manifest that is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Complete manifests, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in system.listStatus(path) if done(s.getPath()))


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """bucket -> version of the latest manifest (of those with a number below `before`): a row a bucket."""
    numbers = [n for n in _numbers(spark, f"{path}/manifests") if before is None or n < before]
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifests/{numbers[-1]}").collect()} if numbers else {}


def _rows(spark: SparkSession, path: str, held: dict[int, int], schema: str) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/v={v}/bucket={b}" for b, v in sorted(held.items())))


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _rows(spark, path, manifest(spark, path), schema)


def merge(changes: DataFrame, number: int, path: str, key: str, buckets: int = BUCKETS) -> list[int]:
    """Takes the changed rows (each key once) of batch `number` into the table; the buckets it wrote."""
    spark = changes.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema)
    dealt = changes.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    held = manifest(spark, path, number)
    touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())
    old = _rows(spark, path, {b: v for b, v in held.items() if b in touched}, schema).join(changes.select(key), key, "left_anti")
    whole = dealt.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
    new = held | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(new.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{number}")
    return touched
