"""Appends by the filter of stored keys: null keys, half-stored defects, old tables."""

import pytest
from pyspark.sql import functions as F

from bugloom.operators import codes
from bugloom.schema import to_records
from bugloom.session import staged
from bugloom.sources import knowledge_base as kb
from bugloom.sources.key_filter import filter_path, possibly_stored, with_bits
from bugloom.streaming.jobs import once_per_id


def records(spark, rows):
    return to_records(spark.createDataFrame(
        [(d, s, f"Title {d}", t) for d, s, t in rows],
        "defect_id string, source string, title string, description string",
    ))


ROWS = [("a", "x", "one"), (None, "x", "two"), ("a", None, "three"), (None, None, "four"), ("b", "", "five")]


def stored(spark, path):
    return sorted(
        ((r["source"], r["defect_id"], r["chunk_index"]) for r in kb.read_kb(spark, path).collect()), key=str
    )


def test_null_keys_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "kb")
    for _ in range(2):
        kb.append_records(records(spark, ROWS), path)
        assert stored(spark, path) == sorted(
            [("x", "a", 0), ("x", None, 0), (None, "a", 0), (None, None, 0), (None, "b", 0)], key=str)
    assert kb.read_kb(spark, path).filter("chunk_id is null or code is not null").count() == 0


def test_missing_chunks_are_completed(spark, tmp_path):
    path = str(tmp_path / "kb")
    long = " ".join(f"word{k}" for k in range(600))
    batch = records(spark, [("a", "x", long), ("b", "x", long), (None, "x", long)])
    kb.append_records(batch, path)
    whole = stored(spark, path)
    some = kb.read_kb(spark, path).filter("defect_id = 'b' or chunk_index = 1 or chunk_index = 3")
    half = str(tmp_path / "half")
    with staged(some, "half") as rows:
        kb._write(rows, half, "append")
        assert kb.path_kind(spark, filter_path(half)) is None  # a table without a filter
        kb.append_records(batch, half)
    assert stored(spark, half) == whole
    kb.append_records(batch, half)
    assert stored(spark, half) == whole


def test_filter_denies_no_stored_key_and_few_others_pass(spark, tmp_path):
    path = str(tmp_path / "kb")
    keys = spark.range(3000).select(F.lit("x").alias("source"), F.concat(F.lit("d"), "id").alias("defect_id"))
    kb.add_keys(keys.filter("cast(substring(defect_id, 2, 9) as int) % 2 = 0"), path)
    found = {r["defect_id"] for r in possibly_stored(keys, path).collect()}
    assert {f"d{k}" for k in range(0, 3000, 2)} <= found and len(found) < 1520
    bits = with_bits(keys).select(F.bit_count("bits").alias("n"), "word").collect()
    assert all(1 <= r["n"] <= 4 and 0 <= r["word"] < 1 << 22 for r in bits)


def test_no_ids_are_read_when_the_filter_says_no(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb.append_records(records(spark, ROWS), path)
    fresh = spark.createDataFrame([("y", "new")], "source string, defect_id string")
    found = kb.stored_keys(fresh, path)
    assert found.count() == 0
    assert "PartitionFilters: [false" in found._jdf.queryExecution().toString() or (
        "LocalTableScan <empty>" in found._jdf.queryExecution().toString())


def test_codes_are_stored(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb.append_records(records(spark, ROWS[:2]), path)
    book = codes.learn(kb.read_kb(spark, path))
    kb.append_records(records(spark, ROWS), path, book=book)
    assert kb.read_kb(spark, path).filter("code is not null").count() == 3


def test_reset_clears_the_filter(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb.append_records(records(spark, ROWS), path)
    kb.reset_kb(spark, path)
    kb.append_records(records(spark, ROWS[:1]), path)
    assert stored(spark, path) == [("x", "a", 0)]


@pytest.mark.parametrize("within", [None, "1 hour"])
def test_ids_once_across_micro_batches(spark, tmp_path, within):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "submission_id string, at timestamp"
    for _ in range(2):
        spark.sql("select 'a' submission_id, timestamp'2024-01-01' at union all select 'b', timestamp'2024-01-01'"
                  ).coalesce(1).write.mode("append").parquet(path)
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        once_per_id(rows, "submission_id", "at", within).writeStream.format("parquet").option(
            "checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r["submission_id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
