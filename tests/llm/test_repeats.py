"""Repeated passages against brute force over all strings of 200 bytes."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from airlens.llm import repeats
from airlens.llm.queries import QUERIES, SQL
from tests.llm.cases import SCHEMA, documents, empty, rows


def brute(texts):
    """[(n_bytes, n_removed, n_spans, kept_sha256)] for texts in order."""
    raws = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for raw in raws:
        for p in range(len(raw) - 199):
            seen[raw[p : p + 200]] += 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed, alphabet, many=60):
    """Texts with copied stretches of 150 to 500 bytes, copies with edits, and runs of one letter."""
    r = random.Random(seed)
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 50, 199, 200, 201, 400, 900, 1500]))) for _ in range(many)]
    for _ in range(many):
        a, b = r.randrange(many), r.randrange(many)
        n = r.choice([150, 198, 199, 200, 201, 202, 250, 344, 500])
        at = r.randrange(max(1, len(texts[a]) - n))
        to = r.randrange(len(texts[b]) + 1)
        texts[b] = texts[b][:to] + texts[a][at : at + n] + texts[b][to:]
    base = texts[7] + "".join(r.choice(alphabet) for _ in range(600))
    for _ in range(many // 2):  # near copies: a crowd with one edit each, anywhere
        to = r.randrange(len(base))
        texts.append(base[:to] + r.choice(alphabet) + base[to + 1 :])
    return [*texts, base, base, "x" * 700, "ab" * 300, "x" * 201, None]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdefgh "), (3, "aé日 "), (4, "a")])
def test_brute_force(spark, seed, alphabet):
    texts = made_texts(seed, alphabet)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert result(repeats.without_repeats(df)) == sorted(((i, *x) for i, x in enumerate(brute(texts))), key=str)


def test_many_buckets_and_hot_classes(spark):
    """One passage in most documents, over more buckets than its keys: bucket ends split it and its near copies."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    passage = word(450)
    texts = [word(r.randrange(5)) + passage[r.randrange(3) :] + word(r.randrange(80)) for _ in range(150)] + [passage] * 80 + [word(600) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert result(repeats.without_repeats(df)) == sorted(((i, *x) for i, x in enumerate(brute(texts))), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_odd_rows(spark):
    """Nulls, empty, long and repeated texts, rows without an id, clashing columns."""
    given = [*rows(), (None, rows()[13][1], None, None, 1, "", "", 0), (None, None, None, None, 1, "", "", 0)]
    got = result(repeats.without_repeats(spark.createDataFrame(given, SCHEMA)))
    assert got == sorted(((g[0], *x) for g, x in zip(given, brute([g[1] for g in given]))), key=str)
    assert result(repeats.without_repeats(empty(spark))) == []
    assert repeats.without_repeats(documents(spark)).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_long_text_in_parts(spark, monkeypatch):
    """Parts of a long text overlap; repeats across parts and documents are found."""
    r = np.random.default_rng(3)
    raw = r.integers(97, 123, 3 * repeats.STEP // 2, dtype=np.uint8)
    at = repeats.STEP - 77
    raw[1000:1600] = raw[at : at + 600]
    long = raw.tobytes().decode()
    tail = long[-300:]
    got = result(repeats.without_repeats(spark.createDataFrame([(1, long), (2, "other " + tail)], "doc_id long, text string")))
    gone = np.ones(len(raw), bool)
    for a, b in ((1000, 1600), (at, at + 600), (len(raw) - 300, len(raw))):
        gone[a:b] = False
    assert got == [(1, len(raw), 1500, 3, hashlib.sha256(raw[gone].tobytes()).hexdigest()), (2, 306, 300, 1, hashlib.sha256(b"other ").hexdigest())]


def test_given_table_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(SQL["op11_repeated_passages"]).fetchall(), key=str)
    assert result(QUERIES["op11_repeated_passages"](spark, sf)) == want and sum(r[2] for r in want) > 1000


def test_multikey_order_is_lexicographic():
    r = np.random.default_rng(1)
    keys = [r.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    assert (repeats.multikey_order(keys) == np.lexsort(keys[::-1])).all()


def test_places_keep_order():
    r = np.random.default_rng(2)
    keys = [r.integers(0, 3, 400).astype(np.uint64) for _ in range(3)]
    order = repeats.multikey_order(keys)
    cuts = order[::37]
    low, high = repeats.places(keys, [k[cuts] for k in keys])
    own = list(zip(*(k.tolist() for k in keys)))
    split = [own[i] for i in cuts]
    assert all(lo == sum(s < k for s in split) and hi == sum(s <= k for s in split) for k, lo, hi in zip(own, low, high))


def test_equal_strings_have_their_token_at_one_distance():
    r = np.random.default_rng(5)
    shared = r.integers(97, 100, 200, dtype=np.uint8)
    found = set()
    for _ in range(20):
        before = r.integers(97, 100, int(r.integers(0, 300)), dtype=np.uint8)
        raw = np.concatenate([before, shared, r.integers(97, 100, 300, dtype=np.uint8)])
        place, lo, hi = repeats.token_starts(repeats.Text(raw), np.array([0, len(raw)]))
        i = np.searchsorted(lo, len(before), "right") - 1
        assert lo[i] <= len(before) <= hi[i]
        found.add(int(place[i] - len(before)))
    assert len(found) == 1


def test_batches_of_no_rows():
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("text", pa.string())])
    assert list(repeats.suffixes(iter([pa.RecordBatch.from_pylist([], schema)]))) == []
