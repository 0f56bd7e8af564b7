"""Ranked search against the plain definition over every document, and against the SQL on the given tables."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from airlens.llm import ranked
from airlens.llm.queries import QUERIES, SQL
from tests.llm.cases import TEXTS, documents, empty, rows

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute(docs, items):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    number, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, count in counted:
            m = 75 + (25 * sum(count.values()) * number) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * count[t]) // (1000 * count[t] + 12 * m)) for t in terms(text) if t in count)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(found)[:20], 1)]
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, many):
    """Texts over few words, so that masks, scores and documents repeat; items of one to ninety terms."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(100)] + ["the", "The", "é", "日本", "a-b", "x_y"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.choice([0, 1, 2, 5, 30, 80])))) for i in range(many)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 8, 40, 90])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, monkeypatch):
    docs, items = made(seed, 400)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert result(ranked.search(d, i)) == brute(docs, items)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 60)  # several blocks of items
    assert result(ranked.search(d, i)) == brute(docs, items)


def test_odd_rows(spark):
    items = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, "!!"), (5, "日本 word ÉTÉ é 123"), (6, "nowhere"), (None, "palabra x word word")]
    i = spark.createDataFrame([(*x, "clash", 3) for x in items], "item_id long, text string, doc_id string, score int")
    given = [(r[0], r[1]) for r in rows()] + [(None, "one two")]
    d = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(None, "one two")], "doc_id long, text string"))
    assert result(ranked.search(d, i)) == brute(given, list(dict.fromkeys(items)))
    assert result(ranked.search(empty(spark), i)) == [] == result(ranked.search(documents(spark), i.limit(0)))


def test_given_tables(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.execute(SQL["op13_ranked_search"])
    assert [c[0] for c in want.description] == ["item_id", "rank", "doc_id", "score"]
    got = result(QUERIES["op13_ranked_search"](spark, sf))
    assert got == sorted(want.fetchall(), key=str) and len(got) > 100


def test_masks_group_documents():
    r = np.random.default_rng(1)
    for many in (1, 8, 63, 64, 65, 130):
        present = r.random((many, 200)) < 0.02
        order, begins, bits = ranked.masks_of(present)
        assert sorted(order) == np.flatnonzero(present.any(axis=0)).tolist()
        groups = np.split(order, begins[1:])
        assert len({present[:, g[0]].tobytes() for g in groups}) == len(groups)
        assert all((present[:, g] == bits[k][:, None]).all() for k, g in enumerate(groups))


def test_most_documents_are_left_unscored():
    """Masks below the twentieth best score are never evaluated, and nothing is lost by it."""
    docs, items = made(3, 3000)
    block = ranked.Block([(i, ranked.term_hashes(ranked.pa.array([t]))[0]) for i, t in items])
    size = len(block.vocabulary)
    r = np.random.default_rng(2)
    present = r.random((size, 3000)) < 0.05
    value = np.where(present, r.integers(1, 1000, (size, 1)) * r.integers(900, 1000, (size, 3000)), 0)
    best = [ranked.Best() for _ in block.ids]
    ids = np.array(range(3000), object)
    done = ranked.search_slice(value, present, ids, block, best)
    for terms_, times, found in zip(block.terms, block.times, best):
        score = times @ value[terms_]
        order = sorted(np.flatnonzero(score > 0), key=lambda d: (-score[d], d))[:20]
        assert found.ids.tolist() == order and found.scores.tolist() == score[order].tolist()
    assert done < 0.5 * 25 * 3000


def test_texts_of_the_cases():
    for _, text in TEXTS:
        assert len(ranked.term_hashes(ranked.pa.array([text], ranked.pa.string()))[0]) == len(terms(text))
