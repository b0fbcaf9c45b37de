"""Targets and repetitions against a plain calculation."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bugloom.llm import mixing

SCHEMA = "doc_id bigint, source string, size bigint"


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        if not free:
            return {s: 3.0 * sizes[s] for s in order}
        level = (total - sum(3 * sizes[s] for s in clamped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return {s: min(level * weight[s], 3.0 * sizes[s]) for s in order}
        clamped |= over


def plain(rows):
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    targets, out = plain_targets(sizes), []
    for s in sizes:
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        need, upto = targets[s] - whole * sizes[s], 0
        own = sorted(
            (r for r in rows if r[1] == s),
            key=lambda r: (
                hashlib.md5(f"mix-1{'' if r[0] is None else r[0]}".encode()).hexdigest(),
                r[0] is not None, r[0] or 0, r[2],
            ),
        )
        for r in own:
            upto += r[2]
            out.append((r, whole + (2 * upto - r[2] <= 2 * need)))
    return targets, out


@pytest.mark.parametrize("leaf_rows", [1, 5, 4096])
def test_like_plain(spark, leaf_rows):
    rows = [(k, f"s{(k * k) % 7 % 5}", (k * 37) % 101) for k in range(600)]
    rows += [(1000 + k, None, 5) for k in range(3)] + [(2000, "tiny", 1), (2001, "none", 0)]
    rows += [(None, "s1", 9), (None, "s1", 9), (7, "ä", 50), (8, "Z", 70)]
    targets, want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.repetitions(df, leaf_rows=leaf_rows).collect()
    assert sorted(((r["doc_id"] or -1, r["source"] or "", r["size"], r["times"]) for r in got if r["size"])) == sorted(
        ((r[0] or -1, r[1] or "", r[2], n) for r, n in want if r[2])
    )
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["times"] <= 3


def test_taken_is_near_the_target(spark):
    rows = [(k, "big" if k % 3 else f"s{k % 9}", 1 + k % 40) for k in range(3000)]
    taken = mixing.repetitions(spark.createDataFrame(rows, SCHEMA)).groupBy("source", "target").agg(
        F.sum(F.col("times") * F.col("size")).alias("taken")
    )
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in taken.collect())


def test_empty_and_wordless(spark):
    assert mixing.repetitions(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.repetitions(spark.createDataFrame([(1, "a", 0), (2, None, 0)], SCHEMA)).collect()
    assert [(r["target"], r["times"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_mixed_keeps_columns_and_repeats(spark):
    rows = [(k, "a b c" if k else None, "x" if k < 9 else "y", k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, times int")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert 39 * 3 - 9 <= 3 * got.count() <= 39 * 3 + 9


def test_words_of_odd_texts(spark):
    texts = [None, "", " ", "\n a\tb ", "a b c", "x\x0by\x0cz\x1cq"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = [r[0] for r in df.orderBy("k").select(mixing.word_count(F.col("text"))).collect()]
    assert got == [0, 0, 0, 2, 2, 3]
