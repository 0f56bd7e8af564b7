"""Repeated passages, removed byte by byte: a sparse suffix array over the UTF-8 bytes of all documents.

A byte goes when a string of LENGTH = 200 bytes that covers it also starts anywhere else, in any document.

1. Suffixes. Of the WINDOW = 144 first places of every 200-byte string the one with the least mixed eight-byte gram is
   the string's token start (the first, if several). The choice depends on the string alone, so equal strings have theirs at the same
   distance, and every string is owned by one suffix, which starts at its token start. About one place in 72 starts one.
2. Order. Suffixes are range-partitioned by their leading tokens (the first eight bytes; then fingerprints of what all strings of a
   suffix share, `core`, and of all that they cover, `whole`) with splitters from a bounded sample. Suffixes that equal several splitters
   are dealt over all buckets between them. Buckets sort by multikey quicksort and compare neighbours; what stands at a bucket's ends is
   compared with the ends of the buckets beside it.
3. A suffix whose neighbour has the same whole has all its strings repeated. One whose neighbours have another core has none
   repeated. Others go deeper: the same is done with their strings in blocks of BLOCK, and with single strings of the blocks that
   stay undecided. One suffix of each repeated whole goes along as a witness.
4. What was found repeated is merged to runs in its document.

Each round is a written table, so a lost executor costs the tasks it ran. The driver gets the sample (SAMPLE rows at most) and two keys
a bucket. Fingerprints have 64 bits and count together with eight bytes of text.

Null and empty texts, and those of fewer than 200 bytes, lose nothing. A row that repeats has all its strings elsewhere. Rows
are told apart by doc_id (without one, by a hash of the text) and the text's checksum; such rows with equal texts have equal results by
definition. Long texts are read in parts that overlap, whole. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import slices, small_batches, trimmed, written
from airlens.llm.shingles import U, buffers, mix, powers

LENGTH, WINDOW, GRAM = 200, 144, 8
LEAD = LENGTH - WINDOW + 1
#: Neighbouring strings that are judged together in the second round; divides WINDOW.
BLOCK = 12
#: Bytes of a long text that are worked on at once; places must fit 24 bits.
STEP = 1 << 21
#: Rows of a bucket, about, and of the sample that splitters come from, at most.
BUCKET_ROWS, SAMPLE = 400_000, 1 << 17
#: Ids of at most this many documents are broadcast to pick out texts; beyond, they are joined.
BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix((np.arange(256, dtype=U) + U(1)) * U(0xD1B54A32D192ED03))
_PLACE = U((1 << 24) - 1)
_KEYS = ("head", "core", "whole")
_ROWS = pa.schema([*((k, pa.int64()) for k in _KEYS), ("id", pa.int64()), ("tag", pa.int64()), ("code", pa.int64())])
_ROWS_DDL = "head long, core long, whole long, id long, tag long, code long"
_JUDGED = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("code", pa.int64()), ("repeated", pa.bool_()), ("deeper", pa.bool_()), ("ends", pa.int32()), ("edge", pa.binary())])
_JUDGED_DDL = "bucket int, id long, tag long, code long, repeated boolean, deeper boolean, ends int, edge binary"


class Text:
    """Bytes of one or more texts, with the eight bytes at any place and a fingerprint of any stretch."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        padded = np.zeros(n + GRAM, np.uint8)
        padded[:n] = raw
        self.heads = np.ndarray(n, ">u8", padded.data, strides=(1,)).astype(U)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[raw] * powers(n, _BASE), out=self.sums[1:])
        self.back = powers(n + 1, _INVERSE)

    def prints(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + np.asarray(salt).astype(U) * U(_BASE))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """At i, the least of x[i : i + width]; two running minima over blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, ~U(0))
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def token_starts(text: Text, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix its place and the first and last start of a string that it owns; texts lie between offsets."""
    none = np.zeros(0, np.int64)
    inside = [np.arange(a, b - LENGTH + 1) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= LENGTH]
    if not inside:
        return none, none, none
    start = np.concatenate(inside)
    x = text.heads ^ (text.heads >> U(31))
    x *= U(0xFF51AFD7ED558CCD)
    x &= ~_PLACE
    x |= np.arange(len(x), dtype=U)
    place = (sliding_minimum(x, WINDOW)[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return place[first], start[first], start[np.append(first[1:], len(start)) - 1]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, offsets, rows and the place in its text where the bytes begin: several texts, or a part of a long one. Parts
    overlap by all but one byte of a string, so each string lies in one."""
    at = 0
    for part in slices(batch, "text"):
        raw, offsets = buffers(part.column("text"))
        rows = np.arange(at, at + part.num_rows)
        at += part.num_rows
        for base in range(0, max(1, len(raw)), STEP) if part.num_rows == 1 else [0]:
            own = raw[base : base + STEP + LENGTH - 1] if part.num_rows == 1 else raw
            yield own, np.minimum(offsets, len(own)), rows, base


def _out(text: Text, at: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, shift: np.ndarray, core: np.ndarray, whole: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """code: a row's strings, as first start in the document, count less one, and the token start's distance."""
    ids, tags = (batch.column(c).to_numpy()[row] for c in ("id", "tag"))
    code = ((lo + shift) << 16) | ((hi - lo) << 8) | (place - lo)
    columns = [text.heads[at].view(np.int64), core.view(np.int64), whole.view(np.int64), ids, tags, code]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ROWS)


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First round: id, tag and text to a row a suffix."""
    for batch in batches:
        for raw, offsets, rows, base in _parts(batch):
            if len(raw) < LENGTH:
                continue
            text = Text(raw)
            place, lo, hi = token_starts(text, offsets)
            if len(place):
                own = np.searchsorted(offsets, lo, "right") - 1
                whole = text.prints(lo, hi + LENGTH, ((place - lo) << 8) | (hi - lo))
                yield _out(text, place, rows[own], lo, hi, place, base - offsets[own], text.prints(place, place + LEAD), whole, batch)


def _coded(batch: pa.RecordBatch) -> Iterator[tuple[Text, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """The codes of each text that has some, decoded, with the part of the text they lie in."""
    for i in range(batch.num_rows):
        raw = buffers(batch.column("text").slice(i, 1))[0]
        codes = np.sort(np.asarray(batch.column("codes")[i].values))
        lo, more, back = codes >> 16, (codes >> 8) & 255, codes & 255
        for base in range(0, len(raw), STEP):
            # Stretches reach BLOCK bytes beyond the strings at either end.
            a, b = np.searchsorted(lo, [base, base + STEP])
            if a < b:
                begin = max(0, base - BLOCK)
                own = raw[begin : base + STEP + 256 + LENGTH + BLOCK]
                yield Text(own), lo[a:b] - begin, lo[a:b] + more[a:b] - begin, lo[a:b] + back[a:b] - begin, np.full(b - a, i), np.full(b - a, begin), len(own)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second round: the strings of undecided suffixes in blocks of BLOCK equal distances from the token start."""
    for batch in batches:
        for text, lo, hi, place, row, shift, n in _coded(batch):
            low, high = (place - hi) // BLOCK, (place - lo) // BLOCK
            which = np.repeat(np.arange(len(lo)), high - low + 1)
            near = (low[which] + np.arange(len(which)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)) * BLOCK
            far = near + BLOCK - 1
            at = place[which]
            core = text.prints(at - near, at - far + LENGTH, near)
            fits = (at - far >= 0) & (at - near + LENGTH <= n)
            start, end = np.maximum(at - far, 0), np.minimum(at - near + LENGTH, n)
            # Cut off by the text's ends, a block isn't taken whole; its strings are judged singly.
            ids, tags = (batch.column(c).to_numpy()[row[which]].view(U) for c in ("id", "tag"))
            alone = mix(mix(mix(ids) + tags) + (at + shift[which]).astype(U))
            whole = np.where(fits, text.prints(start, end, near), alone)
            first, last = np.maximum(lo[which], at - far), np.minimum(hi[which], at - near)
            yield _out(text, at - near, row[which], first, last, at, shift[which], core, whole, batch)


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third round: the strings of undecided blocks one by one."""
    for batch in batches:
        for text, lo, hi, place, row, shift, _ in _coded(batch):
            many = hi - lo + 1
            which = np.repeat(np.arange(len(lo)), many)
            start = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            both = text.prints(start, start + LENGTH, place[which] - start)
            yield _out(text, start, row[which], start, start, place[which], shift[which], both, both, batch)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several key columns: by the first one, then, inside runs that are equal so far, by the next."""
    order = np.argsort(keys[0], kind="stable")
    run = np.zeros(len(order), np.int64)
    for k, key in enumerate(keys[1:]):
        before = keys[k][order]
        new = np.ones(len(order), bool)
        new[1:] = (before[1:] != before[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new)
        tied = np.flatnonzero(~new)
        if not len(tied):
            break
        tied = np.union1d(tied, tied - 1)
        order[tied] = order[tied][np.lexsort((key[order[tied]], run[tied]))]
    return order


def places(keys: list[np.ndarray], splitters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first and last bucket it may go to: more than one where it equals splitters."""
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(splitters[0]), np.int64)
    for key, split in zip(keys, splitters):
        among = np.flatnonzero(low < high)
        pair = low[among] * (len(split) + 1) + high[among]
        for each in np.unique(pair):
            rows = among[pair == each]
            a, b = divmod(int(each), len(split) + 1)
            low[rows] = a + np.searchsorted(split[a:b], key[rows], "left")
            high[rows] = a + np.searchsorted(split[a:b], key[rows], "right")
    return low, high


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket: sorted, each suffix compared with its neighbours. ends: 1, 2 (4, 8) where its core, its whole is that of the
    bucket's first (last) row, which the bucket beside it may go on with. One more row has the bucket's two end keys."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    keys = [rows.column(c).to_numpy().view(U) for c in _KEYS]
    order = multikey_order(keys)
    keys = [k[order] for k in keys]
    n = len(order)
    core, whole = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # equal to the row before
    core[1:-1] = (keys[0][1:] == keys[0][:-1]) & (keys[1][1:] == keys[1][:-1])
    whole[1:-1] = core[1:-1] & (keys[2][1:] == keys[2][:-1])
    repeated = whole[:-1] | whole[1:]
    leads = ~whole[:-1]  # the first of its class stands for it
    group = np.cumsum(~core[:-1]) - 1
    classes = np.bincount(group, leads).astype(np.int64)
    deeper = leads & (classes[group] > 1)
    ends = np.zeros(n, np.int32)
    ends |= np.where(leads & (group == 0), 1, 0).astype(np.int32) | np.where(leads & (group == group[-1]), 4, 0).astype(np.int32)
    kind = np.cumsum(leads)
    ends |= np.where(kind == 1, 2, 0).astype(np.int32) | np.where(kind == kind[-1], 8, 0).astype(np.int32)
    bucket = int(rows.column("bucket").to_numpy().min())
    kept = np.flatnonzero(repeated | deeper | (ends > 0))
    columns = [pa.array(np.full(len(kept), bucket, np.int32)), *(pa.array(rows.column(c).to_numpy()[order][kept]) for c in ("id", "tag", "code")), pa.array(repeated[kept]), pa.array(deeper[kept]), pa.array(ends[kept]), pa.nulls(len(kept), pa.binary())]
    for batch in pa.Table.from_arrays(columns, schema=_JUDGED).to_batches(max_chunksize=65_536):
        yield batch
    edge = np.array([[k[0] for k in keys], [k[-1] for k in keys]], U).tobytes()
    yield pa.RecordBatch.from_pydict({"bucket": [bucket], "id": [None], "tag": [None], "code": [None], "repeated": [None], "deeper": [None], "ends": [None], "edge": [edge]}, schema=_JUDGED)


def _router(splitters: list[np.ndarray], make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(batches):
            low, high = places([batch.column(c).to_numpy().view(U) for c in _KEYS], splitters)
            spread = mix(batch.column("id").to_numpy().view(U) ^ (batch.column("code").to_numpy().view(U) * U(_BASE)))
            bucket = low + (spread % (high - low + 1).astype(U)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *batch.columns], names=["bucket", *_ROWS.names])

    return run


def judged(source: Callable[[float], DataFrame], make: Callable, rows: int, name: str) -> DataFrame:
    """id, tag, code, repeated, deeper of the suffixes that are either. source(share): about that share of the rows that `make`
    turns into suffixes; rows: how many suffixes to expect, which sets the number of buckets."""
    spark = source(1.0).sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    share = min(1.0, min(count * 200, SAMPLE // 2) / max(1, rows))
    taken = source(share).mapInArrow(make, _ROWS_DDL).select(*_KEYS).limit(SAMPLE).toArrow()
    keys = [taken.column(c).to_numpy().view(U) for c in _KEYS]
    order = multikey_order(keys)
    cuts = order[np.arange(1, count) * len(order) // count] if len(order) else order
    splitters = [k[cuts] for k in keys]
    dealt = source(1.0).mapInArrow(trimmed(_router(splitters, make)), f"bucket int, {_ROWS_DDL}").repartitionById(len(cuts) + 1, "bucket")
    found = written(dealt.mapInArrow(trimmed(_judge), _JUDGED_DDL), name)
    edges = sorted((b, np.frombuffer(e, U).reshape(2, 3)) for b, e in found.where("edge is not null").select("bucket", "edge").collect())
    beside = {b: [False] * 4 for b, _ in edges}
    for (a, x), (b, y) in zip(edges, edges[1:]):
        core, whole = bool((x[1, :2] == y[0, :2]).all()), bool((x[1] == y[0]).all())
        beside[a][2:], beside[b][:2] = [core, whole], [core, whole]
    flags = spark.createDataFrame([(b, *f) for b, f in beside.items() if any(f)], "bucket int, core_before boolean, whole_before boolean, core_after boolean, whole_after boolean")
    out = found.where("edge is null").join(F.broadcast(flags), "bucket", "left")  # a row a bucket at most
    on = lambda bit, flag: (F.col("ends").bitwiseAND(bit) > 0) & F.coalesce(flag, F.lit(False))
    repeated = F.col("repeated") | on(2, F.col("whole_before")) | on(8, F.col("whole_after"))
    deeper = F.col("deeper") | on(1, F.col("core_before")) | on(4, F.col("core_after"))
    return out.select("id", "tag", "code", repeated.alias("repeated"), deeper.alias("deeper")).where("repeated or deeper")


def _picked(docs: DataFrame, lists: DataFrame, how: str, few: bool) -> DataFrame:
    ids = lists.select("id", "tag")
    return docs.join(F.broadcast(ids) if few else ids, ["id", "tag"], how)


def _with_codes(docs: DataFrame, lists: DataFrame, few: bool) -> DataFrame:
    """Texts with their codes. Only texts that have some are shuffled, where the ids of those are few enough to be broadcast."""
    return _picked(docs, lists, "left_semi", few).join(lists.hint("shuffle_hash"), ["id", "tag"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            raw = buffers(batch.column("text").slice(i, 1))[0]
            code = np.sort(np.asarray(batch.column("codes")[i].values))
            start, end = code >> 16, (code >> 16) + ((code >> 8) & 255) + LENGTH
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            start, end = start[new], reach[np.append(new[1:], len(reach)) - 1]
            digest = hashlib.sha256()
            for a, b in zip(np.append(0, end), np.append(start, len(raw))):
                digest.update(raw[a:b])
            out.append((batch.column("doc_id")[i].as_py(), len(raw), int((end - start).sum()), len(start), digest.hexdigest()))
        yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), map(list, zip(*out)))) if out else {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}, schema=_RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, tag, codes: of each text that has repeated strings, where they start (first start, count less one, distance). docs: id,
    tag, text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]

    def share_of(table: DataFrame, share: float) -> DataFrame:
        return table if share >= 1 else table.where(F.pmod(F.xxhash64("id", "tag", F.lit(7)), F.lit(1 << 40)) < int(share * (1 << 40)))

    found = judged(lambda s: share_of(docs, s), suffixes, size * 2 // (WINDOW + 1), "suffixes")
    every = found.where("repeated").select("id", "tag", "code")
    for make, name, each in ((blocks, "blocks", WINDOW // BLOCK // 2), (strings, "strings", BLOCK)):
        open_ = found.where("deeper")
        rows = open_.count() * each
        lists = written(open_.groupBy("id", "tag").agg(F.collect_list("code").alias("codes")), f"open-{name}")
        few = lists.count() <= BROADCAST_IDS
        found = judged(lambda s, lists=lists, few=few: _with_codes(share_of(docs, s), lists, few), make, rows, name)
        every = every.unionByName(found.where("repeated").select("id", "tag", "code"))
    return written(every.groupBy("id", "tag").agg(F.collect_list("code").alias("codes")), "spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per row."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("id"), F.crc32(F.encode("text", "UTF-8")).alias("tag"), "text")
    spans = repeated_spans(docs)
    few = spans.count() <= BROADCAST_IDS
    changed = _with_codes(docs, spans, few).select("doc_id", "text", "codes")
    same = _picked(docs, spans, "left_anti", few).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    return same.unionByName(changed.mapInArrow(trimmed(_removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
