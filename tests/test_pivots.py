"""Pairs by pivots against all pairs, and how many are compared."""

import numpy as np
import pytest

from airlens.operators import pivots as pv

SCHEMA = "item_id long, minute long, embedding array<double>"


def made(seed, many, size=12, groups=15, noise=0.25):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, size))
    return [(i, int(r.integers(0, 60) * 97), [float(x) for x in centres[r.integers(groups)] + noise * r.normal(size=size)]) for i in range(many)]


def brute(rows, threshold, window):
    out = set()
    for k, (a, ma, va) in enumerate(rows):
        for b, mb, vb in rows[k + 1 :]:
            x, y = np.array(va), np.array(vb)
            if len(x) == len(y) and abs(ma - mb) <= window and np.linalg.norm(x) and np.linalg.norm(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("threshold", [0.35, 0.6, 0.83, 0.95])
def test_equal_to_all_pairs(spark, threshold):
    rows = [*made(1, 150), (900, 0, [0.0] * 12), (901, 0, [1.0, 0.0]), (902, 50, [1.0, 0.1]), (903, 9000, [1.0, 0.0]), (904, 10, []), (905, 0, made(1, 1)[0][2])]
    rows += [(910 + k, 97 * k, rows[0][2]) for k in range(4)]  # copies
    got = [(r.a, r.b) for r in pv.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold, 1000).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold, 1000)


def test_far_fewer_pairs_are_compared(spark):
    rows = made(2, 800, size=48, groups=60, noise=0.2)
    df = spark.createDataFrame(rows, SCHEMA)
    window = 10_000  # all in one window or two
    compared, found = pv.candidates(df, 0.83, window).count(), pv.similar_pairs(df, 0.83, window).count()
    assert found == len(brute(rows, 0.83, window)) and compared < 0.2 * 800 * 799 / 2


def test_empty(spark):
    assert pv.similar_pairs(spark.createDataFrame([], SCHEMA), 0.8, 100).collect() == []
    assert pv.similar_pairs(spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, None)], SCHEMA), 0.8, 100).collect() == []
