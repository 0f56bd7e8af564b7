"""Token ids in files of fixed-width bit fields.

A file holds a range of documents in ascending doc_id order. Layout, little-endian:
    header     8 bytes magic, uint32 bits, uint32 ids a block, uint64 documents, uint64 ids
    directory  documents x (int64 doc_id, uint64 first id)
    blocks     blocks x uint64: where each block begins, from the file's start
    payload    blocks of ids, each id in `bits` bits, most significant bit first, a block padded to bytes
`bits` is the least that hold the vocabulary. The block offsets lead to any id by one range read, and a block
is unpacked by numpy at once; where `bits` is a whole number of bytes (16 for 50,257 ids) the same bytes are read as
big-endian numbers, which is tested equal.

Null texts are empty (the closing 0 alone). Texts are encoded whole, whatever their length; rows that repeat are
written each. Rows without a doc_id have no place in the order and are left out. Extra columns are ignored. An empty
table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import scratch, small_batches, tasks, written
from airlens.llm.tokens import encoder

MAGIC = b"ALBITS01"
BLOCK = 4096
_HEADER = struct.Struct("<8sIIQQ")
#: A file is closed when it holds so many ids (32 MB of 16-bit ids).
FILE_IDS = 1 << 24


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flags
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


def file_bytes(doc_ids: list[int], ids: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    every = np.frombuffer(b"".join(ids), "<u4")
    directory = np.zeros(len(doc_ids), [("doc_id", "<i8"), ("first", "<u8")])
    directory["doc_id"] = doc_ids
    directory["first"] = np.cumsum([0, *(len(x) // 4 for x in ids)])[:-1]
    blocks = [pack_bits(every[k : k + block], bits) for k in range(0, len(every), block)]
    start = _HEADER.size + directory.nbytes + 8 * len(blocks)
    offsets = (start + np.cumsum([0, *map(len, blocks)])[:-1]).astype("<u8")
    return b"".join([_HEADER.pack(MAGIC, bits, block, len(doc_ids), len(every)), directory.tobytes(), offsets.tobytes(), *blocks])


class Reader:
    """One file, read by ranges: header and directories first, then only the blocks asked for."""

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.block, documents, self.ids = _HEADER.unpack(self._at(0, _HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        directory = np.frombuffer(self._at(_HEADER.size, 16 * documents), [("doc_id", "<i8"), ("first", "<u8")])
        self.doc_ids = directory["doc_id"]
        self.first = np.append(directory["first"], self.ids).astype(np.int64)
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(self._at(_HEADER.size + 16 * documents, 8 * blocks), "<u8").astype(np.int64)
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def block_ids(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            count = min(self.block, self.ids - k * self.block)
            self.kept = (k, unpack_bits(self._at(int(self.offsets[k]), -(-count * self.bits // 8)), self.bits, count))
        return self.kept[1]

    def range(self, start: int, stop: int) -> np.ndarray:
        parts = []
        while start < stop:
            k, within = divmod(start, self.block)
            parts.append(self.block_ids(k)[within : within + stop - start])
            start += len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.first[k]), int(self.first[k + 1]))


_MANIFEST = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("first_doc", "last_doc", "documents", "ids"))])


def _write(path: str, folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        bits = bits_for(own.size)
        system, base = fs.FileSystem.from_uri(folder)
        doc_ids: list[int] = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.ids"  # a retried task writes other files; only the manifest's count
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes([x or 0 for x in doc_ids], ids, bits))
            return pa.RecordBatch.from_pylist([{"file": name, "first_doc": doc_ids[0], "last_doc": doc_ids[-1], "documents": len(doc_ids), "ids": held}], _MANIFEST)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc_ids and doc_id is None and doc_ids[0] is not None:  # a file holds rows with an id, or rows without
                    yield close()
                    doc_ids, ids, held = [], [], 0
                doc_ids.append(doc_id)
                ids.append(own.encode(text or "") + b"\0\0\0\0")
                held += len(ids[-1]) // 4
                if held >= limit:
                    yield close()
                    doc_ids, ids, held = [], [], 0
        if doc_ids:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str, folder: str | None = None, limit: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Writes the ids of all texts (null: empty), each with a closing 0, in ascending doc_id order (rows of one
    doc_id by text; rows without one come after the last, in files of their own); the folder and its manifest: file, first_doc, last_doc, documents, ids, and `start`, the
    ids in all files before. The manifest is a written table with a row a file."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "packed-ids")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base)
    ranged = docs.select(F.col("doc_id").cast("long"), "text")
    order = F.col("doc_id").asc_nulls_last()
    # Rows without an id may be many: they are spread by their texts.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    ranged = ranged.repartitionByRange(order, spread).sortWithinPartitions(order, "text")
    files = written(ranged.mapInArrow(_write(path, folder, limit), "file string, first_doc long, last_doc long, documents long, ids long"), "manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy(F.col("first_doc").asc_nulls_last(), "last_doc", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return folder, files.withColumn("start", before)  # a row a file: 30,000 files of 32 MB hold a terabyte


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    reader = Reader(source)
                    n = np.diff(reader.first)
                    crc = [zlib.crc32(reader.document(k).tobytes()) for k in range(len(n))]
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids) if row["first_doc"] is not None else pa.nulls(len(n), pa.int64()), pa.array(reader.first[:-1] + row["start"]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_ids(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files."""
    spark = manifest.sparkSession
    size = manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids")).first()
    files = manifest.select("file", "start", "first_doc").repartition(max(1, min(size["files"], tasks(spark, 2 * size["ids"]))))
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
