"""What the operators share: tables, the shared scratch folder, bounded slices of a batch, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts can be long, so batches are small, and `slices` bounds what is worked on at once.
BATCH_ROWS = 512
#: Bytes of text worked on at once by the numpy operators.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and all run on one machine
    (tests), a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="airlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Inside it, the scratch paths that this thread's operators make, in order: the caller can discard() them once it has read or
    written the results. Other threads, and blocks inside it, have lists of their own."""
    own: list[str] = []
    token = _made.set(own)
    try:
        yield own
    finally:
        _made.reset(token)


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _made.get()) is not None:
        own.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables and folders that nothing reads any more."""
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """How many tasks read `size` bytes, at about `each` bytes a task; as many as run at once at least. A given number of
    partitions is not merged again by how small the rows are that name the files."""
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts in `column` hold at most `limit` bytes together; a longer text comes alone."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def trimmed(run: Callable) -> Callable:
    """A function of Arrow batches that gives the memory it used back to the system when its task ends: workers live on,
    and what each stage had freed but kept would add up."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def parts_of(left: DataFrame, keys: list[str], rows: int) -> Column:
    """How many parts each key's rows are dealt over: 1, and more for keys of over rows/512 rows (64 at least). The driver
    gets those keys' hashes, 512 at most, whatever the input; keys with one of these hashes by chance are dealt too."""
    limit = max(64, rows // 512)
    often = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    by_size: dict[int, list[int]] = {}
    for key, many in often.select(F.xxhash64(*keys), F.col("_rows")).collect():
        by_size.setdefault(1 << (-(-many // limit) - 1).bit_length(), []).append(key)
    parts = F.lit(1)
    for size, hashes in by_size.items():
        parts = F.when(F.xxhash64(*keys).isin(hashes), size).otherwise(parts)
    return parts


def split_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, rows: int, how: str = "inner") -> DataFrame:
    """Join where a few keys may hold much of `left`: rows of such a key are dealt over several parts by the
    hash of column `by`, and the matching rows of `right` are repeated once a part. `rows` counts `left`; the keys have
    equal types on both sides."""
    parts = parts_of(left, keys, rows)
    one = left.withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    other = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return one.join(other, [*keys, "_part"], how).drop("_part")


def in_training(doc_id: str = "doc_id"):
    """Rows that classifiers may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2
