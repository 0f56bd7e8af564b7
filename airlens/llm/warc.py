"""WARC archives of pages, with a two-level capture index.

Writing: every page is a WARC/1.1 record, a gzip member of its own. Of pages with equal payloads the one with
the largest page_id is a `response`; the others are `revisit` records that refer to it and carry no body.

Index: each record's capture line holds its key, file, offset and length. Keys are the URL with its host
reversed (`com,example,www)/path`), then the page_id. Lines are sorted by ranges of keys into index files of
zlib blocks of BLOCK_LINES lines; each file ends with its sparse block directory (every block's first key,
offset and length) and a footer that says where the directory begins.

Reading: a lookup takes the index file whose range holds the key, binary-searches the directory, reads that
one block by range, binary-searches its lines and reads the record by range.

A null html is an empty payload and a null url an empty one; rows of one page_id are records of their own
(those of the largest id of their payload are responses all). An empty table gives no archives and an empty
result. Rows without a page_id are archived under numbers at most UNNUMBERED and come back without one; they aren't referred to, but refer to a
page of their payload that has an id. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import scratch, small_batches, split_join, tasks, written

BLOCK_LINES = 256
#: Bytes of capture lines of an index file, and of archives that a task reads back, about.
INDEX_BYTES, READ_BYTES = 32 << 20, 32 << 20
_FOOTER = "<QQ8s"  # where the directory begins, its length, magic
_MAGIC = b"ALCDX001"
#: Numbers from here down stand for pages without an id.
UNNUMBERED = -(1 << 62)
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def index_key(url: Column) -> Column:
    """`com,example,www)/path?query`: scheme and port dropped, host lower-cased and reversed by its dots."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\t\\n\\r ]", "%20")
    rest = F.when(F.locate("://", plain) > 0, F.substr(plain, F.locate("://", plain) + 3)).otherwise(plain)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    name = F.regexp_replace(F.lower(host), ":[0-9]*$", "")
    return F.concat(F.array_join(F.reverse(F.split(name, "\\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + 1))


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. Record ids are made from the page_id, so a reader can follow a revisit."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Date: {DATE}"]
    whole = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC headers, the HTTP headers and the payload of a gzip member."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None  # a retried task writes another file
        try:
            for batch in batches:
                offsets, lengths = [], []
                for r in batch.select(["page_id", "url", "html", "refers_to"]).to_pylist():
                    payload = (r["html"] or "").encode()
                    member = record(r["page_id"], (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A"), payload, base32_sha1(payload), r["refers_to"])
                    out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), pa.array([name] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return run


def record_number() -> Column:
    """The page_id; of a page without one a number at most UNNUMBERED, from its url and html, so that it is archived and found as
    well. A payload that only such pages have is a response in each."""
    own = F.lit(UNNUMBERED) - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 61))
    return F.coalesce(F.col("page_id").cast("long"), own)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives to folder; key, page_id, file, offset, length of every record, a written table."""
    spark = pages.sparkSession
    small_batches(spark)
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base)
    rows = pages.select(record_number().alias("page_id"), "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    copies = written(rows.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    # Most payloads are unique; a payload that many pages share is dealt over several tasks.
    found = split_join(rows, copies.select("digest", "newest", F.col("n").alias("copies")), ["digest"], "page_id", rows.count(), "left")
    refers = F.when((F.col("newest") != F.col("page_id")) & (F.col("newest") > UNNUMBERED), F.col("newest"))
    ready = found.select("page_id", "url", "html", index_key(F.col("url")).alias("key"), refers.alias("refers_to"))
    return written(ready.mapInArrow(_write(folder), "key string, page_id long, file string, offset long, length long"), "captures")


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and page_id."""
        system, base = fs.FileSystem.from_uri(folder)
        name, at, out = f"{uuid.uuid4().hex}.cdx", 0, None
        directory: list[list] = []
        lines: list[dict] = []

        def block() -> int:
            data = zlib.compress("\n".join(json.dumps([x["key"], x["page_id"], x["file"], x["offset"], x["length"]]) for x in lines).encode())
            directory.append([lines[0]["key"], lines[0]["page_id"], at, len(data)])
            out.write(data)
            return at + len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    at = block()
                    lines = []
        if out is not None:
            if lines:
                at = block()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + struct.pack(_FOOTER, at, len(data), _MAGIC))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "key": directory[0][0], "page_id": directory[0][1]}])

    return run


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, int, str]]:
    """Writes the index files; the first key, page_id and name of each, in order: a row a file."""
    size = captures.agg(F.coalesce(F.sum(F.length("key") + 64), F.lit(0)).alias("lines")).first()["lines"]
    ranged = captures.repartitionByRange(tasks(captures.sparkSession, size, INDEX_BYTES), "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    files = written(ranged.mapInArrow(_index(folder), "file string, key string, page_id long"), "index-files")
    return sorted((r["key"], r["page_id"], r["file"]) for r in files.collect())


class Index:
    """Lookups in the index files; keeps the last directory and the last block."""

    def __init__(self, system, base: str, files: list[tuple[str, int, str]]):
        self.system, self.base, self.files = system, base, files
        self.first = [(k, i) for k, i, _ in files]
        self.at: tuple = (None, None, [])
        self.block: tuple = (None, [])

    def directory(self, name: str) -> tuple:
        if self.at[0] != name:
            if self.at[1] is not None:
                self.at[1].close()
            source = self.system.open_input_file(f"{self.base}/{name}")
            source.seek(source.size() - struct.calcsize(_FOOTER))
            start, length, magic = struct.unpack(_FOOTER, source.read(struct.calcsize(_FOOTER)))
            if magic != _MAGIC:
                raise ValueError("not a capture index")
            source.seek(start)
            self.at = (name, source, json.loads(zlib.decompress(source.read(length))))
        return self.at

    def captures(self, key: str, page_id: int) -> list[list]:
        """The capture lines of this key and page_id."""
        k = bisect_right(self.first, (key, page_id)) - 1
        if k < 0:
            return []
        name, source, directory = self.directory(self.files[k][2])
        b = bisect_right(_Keys(directory), (key, page_id)) - 1
        found = []
        while b >= 0:
            if self.block[0] != (name, b):
                source.seek(directory[b][2])
                self.block = ((name, b), [json.loads(x) for x in zlib.decompress(source.read(directory[b][3])).split(b"\n")])
            lines = self.block[1]
            to = bisect_right(_Keys(lines), (key, page_id))
            while to and (lines[to - 1][0], lines[to - 1][1]) == (key, page_id):
                to -= 1
                found.append(lines[to])
            if to:  # else the run of equal keys may begin in the block before
                break
            b -= 1
        return found[::-1]


class _Keys:
    """Keys of rows that begin with key and page_id, for bisect."""

    def __init__(self, rows: list):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple:
        return self.rows[k][0], self.rows[k][1]


def _look_up(folder: str, files: list[tuple[str, int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        index = Index(system, base, files)
        open_name, archive = None, None
        for batch in batches:
            rows = []
            for want in batch.to_pylist():
                for _, page_id, name, offset, length in index.captures(want["key"], want["page_id"]):
                    if name != open_name:
                        if archive is not None:
                            archive.close()
                        open_name, archive = name, system.open_input_file(f"{base}/{name}")
                    archive.seek(offset)
                    warc, http, payload = parse(archive.read(length))
                    kind = warc["WARC-Type"]
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"record of page {page_id} is damaged")
                    refers = warc.get("WARC-Refers-To")
                    rows.append({"page_id": page_id if page_id > UNNUMBERED else None, "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(refers[10:-1]) if refers else None})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return run


def look_up(wanted: DataFrame, folder: str, files: list[tuple[str, int, str]], size: int = 0) -> DataFrame:
    """wanted: page_id, url, html (of pages without an id). Sorted by ranges of keys, so that a task reads few index blocks and each once; as many tasks
    as the records' `size` in bytes asks for."""
    keys = wanted.select(index_key(F.col("url")).alias("key"), record_number().alias("page_id")).distinct()
    ranged = keys.repartitionByRange(tasks(wanted.sparkSession, size, READ_BYTES), "key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.mapInArrow(_look_up(folder, files), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages, indexes the records and reads each back through the index."""
    folder = scratch(pages.sparkSession, "archives")
    captures = write_archives(pages, folder)
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()["size"]
    return look_up(pages, folder, write_index(captures, folder), size)
