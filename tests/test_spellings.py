"""Near spellings by letters left out, against all pairs and their longest common subsequence."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens.operators import entities as en, spellings as sp

LIMITS = tuple(int(np.floor((1 - 0.92) * both + 1e-9)) for both in range(sp.FAR + 1))


def edits(a, b):
    """Letters to leave out of both until they are equal."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else min(row[j], row[j - 1]) + 1
    return row[-1]


def changed(r, text, many):
    for _ in range(many):
        at = r.randrange(len(text))
        text = text[:at] + text[at + 1 :] if r.random() < 0.5 else text[:at] + r.choice("abcñ世") + text[at:]
    return text


def test_hashes_are_those_of_what_is_left():
    texts = ["abcab", "aabca", "bcabc"]
    letters = sp.mixed(np.array([[ord(c) for c in t] for t in texts], np.uint64))
    for out in range(4):
        whole = {}
        for text, row in zip(texts, sp.left_out(letters, out)):
            for cut, got in zip(combinations(range(5), out), row.tolist()):
                whole.setdefault("".join(c for i, c in enumerate(text) if i not in cut), set()).add(got)
        assert all(len(x) == 1 for x in whole.values()) and len({min(x) for x in whole.values()}) == len(whole)


@pytest.mark.parametrize("lengths", [(10, 14), (12, 26), (18, 28), (22, 38)])
def test_all_pairs_of_few_edits_meet(spark, lengths):
    r = random.Random(lengths[0])
    base = ["".join(r.choice("abc ñ世") for _ in range(r.randint(*lengths))) for _ in range(50)]
    keys = sorted({k for b in base for k in (b, *(changed(r, b, r.randint(1, 5)) for _ in range(6))) if len(k) >= 10})
    frame = spark.createDataFrame([(i, 7, k) for i, k in enumerate(keys)], "id long, salt long, key string").repartition(3).cache()
    got = [(p.x, p.y) for p in sp.near_ids(frame, LIMITS).collect()]
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(keys), 2) if abs(len(a) - len(b)) <= 5 and edits(a, b) <= sp.limited(LIMITS, len(a) + len(b))}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 60
    gaps = {(edits(keys[i], keys[j]), abs(len(keys[i]) - len(keys[j]))) for i, j in want}
    assert lengths[0] != 22 or {(4, 0), (4, 2), (4, 4), (5, 1), (5, 3)} <= gaps
    assert lengths[0] != 18 or {(2, 0), (3, 1), (2, 2), (3, 3)} <= gaps


def test_other_salts_dont_meet_and_few_are_left(spark):
    none = spark.createDataFrame([], "id long, salt long, key string")
    assert sp.near_ids(none, LIMITS).collect() == []
    two = spark.createDataFrame([(1, 1, "abcdefghijklmn"), (2, 2, "abcdefghijklmo")], none.schema)
    assert sp.near_ids(two, LIMITS).collect() == []


def test_long_keys_with_frequent_words_dont_meet(spark):
    """They met by nearly all pairs when they shared three letters of a frequent word."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    keys = list({f"the {word(9)} and {word(9)} that" for _ in range(300)})
    near = keys[0][:13] + keys[0][14:20] + "xy" + keys[0][21:]
    frame = spark.createDataFrame([("p", k, i, len(k)) for i, k in enumerate([*keys, near])], "tipo string, key string, seen long, n int")
    got = {(x.x, x.y) for x in en._by_halves(frame, lambda both: F.floor(0.08 * both + 1e-9).cast("int")).collect()}
    assert tuple(sorted((keys[0], near), key=lambda k: (len(k), k))) in got and len(got) < 30


def test_names_are_counted_once_before_they_are_normalised(spark):
    rows = [("persona", "Ana", 5), ("persona", "Ana", 3), ("persona", "ANA!", 9), ("persona", "ana", 1), ("institucion", "Ana", 2), ("persona", "?", 4)]
    got = {(r.tipo, r.key): (r.seen, r.mentions) for r in en.counted_keys(spark.createDataFrame(rows, "tipo string, name string, seen long")).collect()}
    assert got == {("persona", "ana"): (1, 4), ("institucion", "ana"): (2, 1)}


def test_chains_of_names_are_followed_without_the_others(spark, monkeypatch):
    """A round writes only keys that aren't their own entity; a chain of near spellings ends at its first."""
    sizes, written = [], en.checkpointed
    monkeypatch.setattr(en, "checkpointed", lambda df: sizes.append(("moved" in df.columns, (out := written(df)).count())) or out)
    rows = [("persona", "abcdefghijklmnopqrst" + "xyzw"[:i], i) for i in range(5)] + [("persona", f"{chr(97 + i) * 3} solo", 10 + i) for i in range(20)]
    got = {r.key: (r.entity, r.how) for r in en.resolve_mentions(spark.createDataFrame(rows, "tipo string, name string, seen long")).collect()}
    chain = sorted(k for k in got if k.startswith("abcd"))
    assert all(got[k] == (chain[0], "exact" if k == chain[0] else "fuzzy") for k in chain) and len(got) == 25
    rounds = [n for moved, n in sizes if moved]
    assert rounds and set(rounds) == {4}
