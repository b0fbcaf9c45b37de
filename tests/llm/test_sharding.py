"""Exact sizes, whole rows, and the law of the draw."""

import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugloom.llm import sharding as sh


@pytest.mark.parametrize("good,bad,drawn", [(5, 7, 4), (3, 40, 20), (0, 5, 2), (6, 0, 3), (9, 9, 18)])
def test_draws_follow_the_law(good, bad, drawn):
    rng, n = np.random.default_rng(1), 20_000
    seen = Counter(sh.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    for k in range(drawn + 1):
        want = comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) if drawn >= k else 0
        assert abs(seen[k] / n - want) < 0.015
    assert all(max(0, drawn - bad) <= k <= min(good, drawn) for k in seen)


def test_large_populations():
    rng = np.random.default_rng(2)
    got = [sh.hypergeometric(rng, 10**11, 7 * 10**11, 10**9) for _ in range(200)]
    spread = (1e9 / 8 * 7 / 8) ** 0.5
    assert abs(np.mean(got) - 1.25e8) < 5 * spread / 200**0.5
    assert 0.7 * spread < np.std(got) < 1.3 * spread


def test_matrix_sums():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 1000, 17, 65_536, 3]
    capacities = sh.shard_sizes(sum(sizes), 7)
    got = np.array(sh.matrix(rng, capacities, sizes))
    assert got.sum(1).tolist() == sizes and got.sum(0).tolist() == capacities
    assert (got >= 0).all() and max(capacities) - min(capacities) <= 1


def frame(spark, n, parts=3):
    rows = [(k if k % 50 else None, None if k % 7 == 0 else "same" if k % 3 else f"t{k}", k, "x")
            for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, slot int, _place string").repartition(parts)


@pytest.mark.parametrize("n,shards", [(0, 8), (1, 8), (7, 8), (1000, 8), (1003, 5), (200, 1)])
def test_exact_sizes_and_whole_rows(spark, n, shards):
    df = frame(spark, n)
    got = sh.sharded(df, shards).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(
        (r["doc_id"], r["text"]) for r in df.collect())
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)}
    assert [len(slots[s]) for s in range(shards)] == sh.shard_sizes(n, shards)
    assert all(v == list(range(len(v))) for v in slots.values())


def test_rows_spread_evenly_and_by_seed(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).coalesce(4)
    one, two = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sh.sharded(df, 8, s).collect()} for s in (1, 2))
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sh.sharded(df, 8, 1).collect()}
    assert one == again and one != two
    # Early rows go to all shards and slots alike.
    early = Counter(s for d, (s, _) in one.items() if d < 2000)
    assert all(190 < early[s] < 310 for s in range(8))
    assert 450 < np.mean([slot for d, (_, slot) in one.items() if d < 2000]) < 550
    # Neighbours don't stay together.
    pairs = sum(one[d][0] == one[d + 1][0] for d in range(7999))
    assert 850 < pairs < 1150


def test_written_shards(spark, tmp_path):
    df = frame(spark, 300)
    got = sh.write_shards(df, str(tmp_path / "shards"), 4)
    assert got.count() == 300
    assert [r[1] for r in got.groupBy("shard").count().orderBy("shard").collect()] == [75] * 4


def test_digests(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"])
           for r in sh.digest_columns(sh.sharded(df)).collect()}
    assert got == {
        1: (1, 0, "rows", None), 2: (1, 0, "rows", None),
        3: (3, zlib.crc32("é".encode()), "rows", None),
    }
