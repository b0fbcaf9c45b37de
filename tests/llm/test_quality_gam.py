"""Lookup tables: recovered shapes, interactions, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from bugloom.llm import quality_gam as gam


def test_additive_and_pairwise_shapes():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (6000, 4))
    z = 3 * (np.abs(x[:, 0]) > 0.5) - 1.5 + 4 * np.sign(x[:, 1] * x[:, 2])
    y = (rng.uniform(size=len(z)) < 1 / (1 + np.exp(-z))).astype(float)
    model = gam.fit(x[:4000], y[:4000])
    assert {1, 2} in [set(p) for p in model.pairs]
    p = model.score(x[4000:])
    assert np.mean((p > 0.5) == (z[4000:] > 0)) > 0.93
    alone = gam.Model(model.constant, model.edges, model.tables).score(x[4000:])
    assert np.mean((alone > 0.5) == (z[4000:] > 0)) < 0.8


def test_scores_are_sums_of_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    model = gam.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float))
    for row, p in zip(x[:20], model.score(x[:20])):
        z = model.constant
        for e, t, v in zip(model.edges, model.tables, row):
            z += t[sum(b <= v for b in e)]
        for (i, j), t in zip(model.pairs, model.pair_tables):
            z += t[sum(b <= row[i] for b in model.pair_edges[i]), sum(b <= row[j] for b in model.pair_edges[j])]
        assert p == pytest.approx(1 / (1 + np.exp(-z)))


def test_trees_take_the_best_splits():
    g, h, n = np.array([1.0, 1, -5, -5, 2, 2]), np.ones(6), np.full(6, 50)
    steps = gam.shallow_tree(g, h, n, splits=2)
    assert steps[0] == steps[1] and steps[2] == steps[3] < 0 and steps[4] == steps[5] > steps[0] > 0
    cells = np.zeros((4, 4))
    cells[:2, :1], cells[2:, 1:] = 5, 5
    cells[:2, 1:], cells[2:, :1] = -5, -5
    assert np.sign(gam.cross_tree(cells, np.ones((4, 4)))[1]).tolist() == np.sign(cells).tolist()


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "É" * 100_000, "| " * 50_000])
def test_features_of_odd_texts(text):
    assert np.isfinite(gam.describe(text)).all() and len(gam.describe(text)) == len(gam.NAMES)


def test_one_kind_of_label_and_none():
    x = np.ones((5, 3))
    assert (gam.fit(x, np.ones(5)).score(x) > 0.5).all()
    with np.errstate(all="raise"):
        assert gam.fit(x, np.zeros(5)).score(x).max() < 0.5


def test_table(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(500)]
    rows = []
    for k in range(700):
        own = rng.choices(words, k=rng.randint(20, 90))
        if k % 4 == 0:
            own = own[:4] * 10 if k % 8 else [w.upper() + "!!" for w in own]
        rows.append((k, " ".join(own) + ".", int(k % 4 != 0)))
    docs = spark.createDataFrame([(*r[:2], "s") for r in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in gam.scored(docs.repartition(3), labels).collect()}
    held = [(got[k], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 80 and all(r["held_out"] for r, _ in held)
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.95


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in gam.scored(docs, labels).collect()] == [0.5, 0.5]
    assert gam.scored(docs.limit(0), labels).count() == 0
