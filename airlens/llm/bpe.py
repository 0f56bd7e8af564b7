"""Encoding and decoding with a byte-level BPE vocabulary, chunks that documents share encoded once a worker.

A text is cut into chunks where a rolling hash of 16 bytes says so, so that equal passages are cut alike
wherever they stand; each distinct chunk is encoded once and remembered (within a bound in bytes, for the worker's
life; nothing is shuffled, so a chunk that runs through the corpus costs no hot key). Text that gives no cut is cut
after LONGEST_CHUNK bytes. A cut can fall inside a word: where two chunks meet, the stretch around the cut is encoded anew, and widened by one stretch at a time
until its ids equal those of its parts, which is when the ids on both sides hold.

Null texts are empty: no ids. Texts are encoded whole, whatever their length. Extra columns are ignored; rows that
repeat, or lack an id, give rows each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import small_batches
from airlens.llm.shingles import _INVERSE, U, mix, powers
from airlens.llm.tokens import Encoder, Unsafe, encoder

WINDOW = 16
#: A cut where this many low bits of the rolling hash are 0: chunks of 1,024 bytes on average.
CUT_BITS = 10
#: Bytes of chunks and their ids remembered in each of two generations, and of the longest chunk.
REMEMBERED_BYTES, LONGEST_CHUNK = 24 << 20, 16 << 10

_CUT = re.compile(r"(?<!\s) ")


def cuts(raw: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Where chunks end: after every window whose hash has `bits` low zeros, between characters only."""
    n = len(raw)
    if n <= WINDOW:
        return np.array([n] if n else [], np.int64)
    sums = np.zeros(n + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(n), out=sums[1:])
    rolling = (sums[WINDOW:] - sums[:-WINDOW]) * powers(n - WINDOW + 1, _INVERSE)
    ends = np.flatnonzero((mix(rolling) & U((1 << bits) - 1)) == 0) + WINDOW
    ends = ends[ends < n]
    ends = np.append(ends[(raw[ends] & 0xC0) != 0x80], n)
    far = np.diff(ends, prepend=0) > LONGEST_CHUNK
    if far.any():
        more = [np.arange(a + LONGEST_CHUNK, b, LONGEST_CHUNK) for a, b in zip(np.append(0, ends[:-1])[far], ends[far])]
        more = np.concatenate(more)
        for _ in range(3):  # back to the beginning of a character
            more = more - ((raw[more] & 0xC0) == 0x80)
        ends = np.union1d(ends, more)
    return ends


class ChunkedEncoder:
    def __init__(self, own: Encoder, bits: int = CUT_BITS):
        self.own, self.bits = own, bits
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.bytes = self.encoded = self.reused = self.repaired = 0

    def chunk(self, data: bytes) -> tuple[list[str], bytes, list[str]]:
        """The chunk's first two stretches, the ids of those between, its last two. A short one has only the first list."""
        got = self.new.get(data)
        if got is None:
            got = self.old.get(data)
            if got is None:
                self.encoded += 1
                got = self.fresh_chunk(data.decode())
            else:
                self.reused += 1
            if self.bytes >= REMEMBERED_BYTES:
                self.old, self.new, self.bytes = self.new, {}, 0
            self.new[data] = got
            self.bytes += len(data) + len(got[1])
        else:
            self.reused += 1
        return got

    def fresh_chunk(self, text: str) -> tuple[list[str], bytes, list[str]]:
        words = text.split(" ")
        ends = [*words[:2], *words[-2:]]
        try:
            if len(words) < 5 or not all(ends) or any(x[-1].isspace() for x in ends):
                raise Unsafe
            return [words[0], " " + words[1]], b"".join(map(self.own.memory.__getitem__, words[2:-2])), [" " + words[-2], " " + words[-1]]
        except Unsafe:
            first, *rest = _CUT.split(text)
            parts = [first, *(" " + x for x in rest)]
            if len(parts) < 5:
                return parts, b"", []
            return parts[:2], b"".join([self.stretch(x) for x in parts[2:-2]]), parts[-2:]

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch that begins with a space."""
        if text[-1:].isspace():
            return self.own.fresh(text)
        return self.own.memory[text[1:]]

    def encode(self, text: str) -> bytes:
        self.own.renew()
        raw = text.encode()
        out: list[bytes] = []
        open_parts: list[str] = []  # stretches whose ids are not yet certain: what stands before the next cut
        at = 0
        for end in cuts(np.frombuffer(raw, np.uint8), self.bits).tolist():
            head, middle, tail = self.chunk(raw[at:end])
            at = end
            open_parts = self.repair(open_parts, head) if open_parts else list(head)
            if tail:
                out.append(b"".join(map(self.ids, open_parts)) + middle)
                open_parts = list(tail)
        out.append(b"".join(map(self.ids, open_parts)))
        return b"".join(out)

    def ids(self, stretch: str) -> bytes:
        return self.stretch(stretch) if stretch[:1] == " " else self.own.fresh(stretch)

    def repair(self, left: list[str], right: list[str]) -> list[str]:
        """The stretches of left and right, joined: from the last of the left on, encodes the stretch across the
        cut again and takes in the next one until the ids of both together equal the ids of each."""
        self.repaired += 1
        across, rest = left[-1] + right[0], right[1:]
        while rest and self.own.fresh(across + rest[0]) != self.own.fresh(across) + self.ids(rest[0]):
            across, rest = across + rest[0], rest[1:]
        before = left[:-1]
        while before and self.own.fresh(before[-1] + across) != self.ids(before[-1]) + self.own.fresh(across):
            across = before.pop() + across
        return [*before, across, *rest]


@lru_cache(maxsize=4)
def chunked_encoder(path: str) -> ChunkedEncoder:
    """The worker's own; what it remembers lasts from task to task."""
    return ChunkedEncoder(encoder(path))


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunked = encoder(path), chunked_encoder(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column("text").to_pylist():
                ids = chunked.encode(text or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 (of what the ids decode to)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = chunked_encoder(path)
        for batch in batches:
            ids = [np.frombuffer(chunked.encode(x or ""), "<u4").astype(np.int32) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, an array of integers."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [None if x is None else own.decode(np.asarray(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text; null ids give a null text."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
