"""Records written, read back, indexed and read in a seeded order."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from bugloom.llm import token_records as tr
from bugloom.llm.common import new_folder
from bugloom.llm.tokens import Encoder

ROWS = [
    (5, "five words are in here"), (-3, None), (2, ""), (None, "no id"), (9, "a\nb\n\n c  d"),
    (7, "long text " * 5000), (5, "five words are in here"), (2**40, "big id <|endoftext|>"),
]


def written(spark, rows, schema="doc_id bigint, text string"):
    folder, index = new_folder(spark, "records-test"), new_folder(spark, "records-index-test")
    tr.write_records(spark.createDataFrame(rows, schema), folder)
    return folder, tr.write_index(spark, folder, index)


def test_round_trip(spark):
    folder, index = written(spark, ROWS)
    got = sorted(tr.with_starts(index).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -3, 2, 5, 5, 7, 9, 2**40]
    encoder, start = Encoder(), 0
    texts = {i: t for i, t in ROWS}
    for r in got:
        ids = encoder.direct([texts[r["doc_id"]] or ""])[0] + struct.pack("<I", 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_shuffled_reads_are_seeded_and_whole(spark):
    folder, index = written(spark, ROWS)
    first, again, other = (
        [(r["doc_id"], zlib.crc32(bytes(r["ids"])))
         for r in tr.read_shuffled(spark, folder, index, s).orderBy("place").collect()]
        for s in (1, 1, 2)
    )
    assert first == again != other
    want = [(r["doc_id"], r["ids_crc32"]) for r in index.collect()]
    assert sorted(map(str, first)) == sorted(map(str, other)) == sorted(map(str, want))


def test_empty_and_clashing_columns(spark):
    folder, index = written(spark, [])
    assert tr.with_starts(index).count() == 0
    schema = "doc_id bigint, text string, record string, path int, ids string"
    folder, index = written(spark, [(1, "x", "r", 3, "i")], schema)
    assert index.count() == 1


@pytest.mark.parametrize("flip", [0, 9, 14, 40])
def test_damage_is_found(flip):
    data = tr.frame(tr.payload(4, struct.pack("<9I", *range(9)))) + b"\n"
    assert tr.read_frame(data, 0) == (data[12:-5], len(data))
    broken = bytearray(data)
    broken[flip] ^= 1
    with pytest.raises(ValueError):
        tr.read_frame(bytes(broken), 0)


def test_wide_ids():
    ids = struct.pack("<3I", 1, 70_000, 2**32 - 1)
    assert tr.parsed(tr.payload(None, ids)) == (None, ids)
    assert tr.parsed(tr.payload(-1, ids[:4])) == (-1, ids[:4])
    assert tr.masked(b"") == 0xA282EAD8
