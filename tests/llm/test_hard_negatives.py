"""Cover trees and mined negatives against plain sorting of all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugloom.llm import hard_negatives as hn
from bugloom.llm.cover_tree import Search, bounds, build

SCHEMA = "vec_id bigint, label int, embedding array<float>, vector string, own int"


def plain(rows):
    """All negatives by sorting all scores; rows of (vec_id, label, list of floats)."""
    best = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        own = (label, [math.floor(256 * float(np.float32(v))) for v in x])
        best[i] = min(best.get(i, own), own)
    table = {i: ((label + 1) % 10 if i % 7 == 0 else label, x) for i, (label, x) in best.items()}
    out = []
    for a in (i for i in table if i % 100 == 0):
        label, x = table[a]
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i) for i, (_, y) in table.items() if i != a)
        positives = [(i, -s) for s, i in scores if table[i][0] == label][:5]
        for p, score in positives:
            fit = [(i, -s) for s, i in scores
                   if table[i][0] != label and 30 * score <= -100 * s <= 90 * score][:10]
            out += [(a, p, k, i, score, s) for k, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = hn.mined(hn.relabelled(hn.candidates(df)), F.col("vec_id") % 100 == 0, **kw)
    return sorted(tuple(r) for r in found.collect())


def some_rows(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, dim))
    return [
        (k, int(rng.integers(10)), [float(v) for v in middles[k % 4] + spread * rng.normal(size=dim)])
        for k in range(n)
    ]


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_bounds_hold_and_cover(spread):
    rows = some_rows(700, 8, 1, spread)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    tree = build(x, np.arange(700), np.zeros(700, int))
    assert sorted(tree.ids) == list(range(700))
    anchors = x[:20]
    low, high = bounds(tree, anchors, (anchors**2).sum(1))
    for node in range(len(tree.radii)):
        scores = tree.vectors[tree.first[node]:tree.last[node]] @ anchors.T
        assert (scores >= low[node]).all() and (scores <= high[node]).all()
        if tree.parents[node] >= 0:
            assert tree.levels[node] == tree.levels[tree.parents[node]] + 1


def test_close_rows_are_not_all_verified():
    rows = some_rows(4000, 8, 2, 0.05)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    tree = build(x, np.arange(4000), np.zeros(4000, int))
    of = np.arange(10)
    search = Search([tree], x[:10], np.arange(10), np.zeros(10, int), of, np.full(10, -np.inf),
                    np.full(10, np.inf), 5, True).run()
    assert search.verified < 10 * 4000 / 4
    query, ids, scores = search.results()
    for q in range(10):
        want = sorted(((-int(x[q] @ x[k]), k) for k in range(4000) if k != q))[:5]
        assert sorted((-s, i) for i, s in zip(ids[query == q], scores[query == q])) == want


@pytest.mark.parametrize("tree_rows,block", [(2048, 16384), (16, 2), (1, 1)])
def test_like_plain(spark, tree_rows, block):
    n = 260 if tree_rows == 1 else 620
    rows = some_rows(n, 6, 3)
    rows += [(1000 + k, k % 10, rows[0][2]) for k in range(60)]  # copies of an anchor
    rows += [(2000 + k, k % 3, [0.0] * 6) for k in range(40)] + [(2100, 1, [1.0, 2.0])]
    assert mined(spark, rows, tree_rows=tree_rows, block_anchors=block) == plain(rows)


def test_rows_that_take_no_part(spark):
    rows = some_rows(230, 4, 4)
    rows += [(300, None, [1.0] * 4), (400, 1, None), (500, 1, [1.0, None, 0.0, 0.0]), (None, 1, [1.0] * 4),
             (600, 2, [float("nan")] + [0.0] * 3), (700, 2, [float("inf")] * 4), (800, 3, [])]
    rows += rows[:30] + [(100, 9, [5.0, 5.0, 5.0, 5.0])]
    assert mined(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0, 0.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (101, 1, [-1.0]), (102, 2, [0.5])]) == []
