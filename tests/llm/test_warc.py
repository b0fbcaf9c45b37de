"""Round trips of archives, and damage to them."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from bugloom.llm import warc
from bugloom.llm.common import new_folder

SCHEMA = "page_id bigint, url string, html string"


def round_trip(spark, rows, schema=SCHEMA, **sizes):
    folder = new_folder(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, schema), folder, **sizes)
    return warc.read_warc(spark, folder)


def test_segments_chunks_and_revisits(spark):
    long = "ä€😀 " * 5000
    rows = [
        (1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3\r\nX: y", long),
        (4, None, None), (5, "http://a/5", ""), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n"),
        (7, "u", long + "!"), (None, "u", "no id"), (-8, "u", "minus"), (9, "u", long),
    ]
    got = round_trip(spark, rows, segment_bytes=700, chunk_bytes=64).collect()
    assert len(got) == len(rows) and all(r["complete"] for r in got)
    by_id = {r["page_id"]: r for r in got}
    largest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        largest[body] = i if i is not None else largest.get(body)
    for i, _, html in rows:
        body = (html or "").encode()
        want = max((j for j, _, h in rows if (h or "").encode() == body and j is not None), default=None)
        r = by_id[i]
        assert r["digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["payload_length"] == len(body)
        if i == want or want is None:
            assert r["type"] == "response" and bytes(r["payload"]) == body
        else:
            assert r["type"] == "revisit" and r["refers_to"] == want and r["payload"] is None


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", "x" * 3000, "a", 1)] * 3 + [(0, "u", "x" * 3000, "b", 2)]
    got = round_trip(
        spark, rows, SCHEMA + ", digest string, segment int", segment_bytes=500, chunk_bytes=100
    ).collect()
    assert sorted(r["type"] for r in got) == ["response"] * 3 + ["revisit"]
    assert all(bytes(r["payload"]) == b"x" * 3000 for r in got if r["payload"] is not None)


def test_empty_table(spark):
    assert round_trip(spark, []).count() == 0


def test_missing_segments_show(spark):
    records = warc.read_records(spark, _folder(spark))
    lost = warc.reassembled(records.filter("coalesce(segment, 0) <> 2")).filter("type = 'response'")
    assert [r["block"] for r in lost.collect()] == [None]
    short = records.withColumn(
        "block", F.when(F.col("segment") == 3, F.lit(b"?")).otherwise(F.col("block"))
    )
    assert [r["block"] for r in warc.reassembled(short).collect()] == [None]


def _folder(spark):
    folder = new_folder(spark, "warc-test")
    warc.write_warc(
        spark.createDataFrame([(1, "u", "abc" * 1000)], SCHEMA), folder, segment_bytes=600
    )
    return folder


@pytest.mark.parametrize("broken", [b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabc\r\n", b"3\r\nabcd\r\n0\r\n\r\n"])
def test_broken_framing(broken):
    assert warc.dechunked(broken) is None


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_framing_round_trip(size):
    body = bytes(range(256)) * 9
    assert warc.dechunked(warc.chunked(body, size)) == body
    assert warc.dechunked(warc.chunked(b"", size)) == b""
