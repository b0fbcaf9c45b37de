"""The index of codes against exact search, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugloom.operators import codes, search


def kb_of(spark, n=900, dim=24, seed=1, without=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(30, dim))
    rows = []
    for k in range(n):
        v = middles[k % 30] + 0.4 * rng.normal(size=dim)
        rows.append((f"c{k}", f"d{k // 2}", [float(x) for x in v / np.linalg.norm(v)]))
    rows += [(f"none{k}", "none", None) for k in range(without)]
    return spark.createDataFrame(rows, "chunk_id string, defect_id string, embedding array<float>")


def queries_of(kb, exclude=None):
    own = [F.col(exclude).alias("exclude_id")] if exclude else []
    return kb.filter("embedding is not null").select(F.col("chunk_id").alias("query_id"), "embedding", *own)


def rows(hits):
    return sorted(tuple(r) for r in hits.select("query_id", "rank", "chunk_id", "score").collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    kb = kb_of(spark, without=3)
    book = codes.learn(kb, cells=16)
    path = str(tmp_path_factory.mktemp("codes") / "kb")
    codes.with_codes(kb, book).write.parquet(path)
    return spark.read.parquet(path), book


def test_codes_stand_for_vectors(indexed):
    kb, book = indexed
    stored = kb.filter("code is not null").toArrow()
    vectors = np.array(stored.column("embedding").to_pylist())
    error = ((book.vectors(stored.column("code")) - vectors) ** 2).sum(1)
    assert error.mean() < 0.1 and kb.filter("code is null").count() == 3


@pytest.mark.parametrize("exclude", [None, "chunk_id"])
def test_recall_of_chunks(indexed, exclude):
    kb, book = indexed
    exact = rows(search.top_chunks(queries_of(kb, exclude), kb))
    found = rows(search.top_chunks(queries_of(kb, exclude), kb, book=book))
    met = {(q, c) for q, _, c, _ in exact} & {(q, c) for q, _, c, _ in found}
    assert len(found) == len(exact) and len(met) >= 0.97 * len(exact)
    best = dict(((q, c), s) for q, _, c, s in exact)
    assert all(abs(best[q, c] - s) < 2e-4 for q, _, c, s in found if (q, c) in best)


def test_defects_and_filters(indexed):
    kb, book = indexed
    asked = queries_of(kb, "defect_id").limit(60)
    exact, found = (
        {(r["query_id"], r["defect_id"]) for r in search.top_defects(asked, kb, 3, book=b).collect()}
        for b in (None, book)
    )
    assert len(exact & found) >= 0.95 * len(exact)
    only = search.top_chunks(queries_of(kb).limit(5), kb, where={"defect_id": "d7"}, book=book)
    assert {r["chunk_id"] for r in only.collect()} == {"c14", "c15"}


def test_chunks_without_codes_are_found(indexed):
    kb, book = indexed
    mixed = kb.withColumn("code", F.when(F.xxhash64("chunk_id") % 2 == 0, F.col("code")))
    asked = queries_of(kb).limit(50)
    exact, found = (set(rows(search.top_chunks(asked, x, book=b))) for x, b in ((kb, None), (mixed, book)))
    assert len(exact & found) >= 0.95 * len(exact)


def test_stored_book_and_bytes(spark, indexed, tmp_path):
    kb, book = indexed
    codes.write_book(spark, book, str(tmp_path / "book"))
    again = codes.read_book(spark, str(tmp_path / "book"))
    rng = np.random.default_rng(2).normal(size=(50, book.dim))
    assert (again.encode(rng) == book.encode(rng)).all()
    assert codes.bytes_share(codes.Codebook(np.zeros((1, 384)), [np.zeros((1, 4))] * 96), 10**6, 100) < 0.07


def test_empty_equal_and_few(spark):
    assert codes.learn(kb_of(spark, 0)) is None
    one = spark.createDataFrame(
        [(f"c{k}", "d", [1.0, 0.0, 0.0]) for k in range(9)], "chunk_id string, defect_id string, embedding array<float>"
    )
    book = codes.learn(one)
    got = rows(search.top_chunks(queries_of(one).limit(1), codes.with_codes(one, book), 3, book=book))
    assert [(r, c, s) for _, r, c, s in got] == [(1, "c0", 1.0), (2, "c1", 1.0), (3, "c2", 1.0)]


def test_grid_like_broadcast(spark):
    kb = kb_of(spark, 300)
    for exclude in (None, "chunk_id"):
        asked = queries_of(kb, exclude)
        assert rows(search.top_chunks(asked, kb)) == rows(search.top_chunks(asked, kb, block_bytes=4096))


def test_query_size_when_the_first_vector_is_null(spark):
    """The bytes of a query are those of the longest vector, wherever it stands."""
    kb = kb_of(spark, 40)
    asked = spark.createDataFrame([("none", None)], "query_id string, embedding array<float>").unionByName(
        queries_of(kb)
    )
    got = search.top_chunks(asked, kb, block_bytes=500)
    assert rows(got) == rows(search.top_chunks(queries_of(kb), kb))
