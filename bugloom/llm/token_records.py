"""Token ids as length-delimited binary records in files, with an offset index beside them.

A record is: the payload's length (unsigned 64 bits), the masked checksum of those eight bytes,
the payload, the masked checksum of the payload, and one line feed, which the sink that commits
the files puts after each record. All numbers are little-endian; a checksum is the CRC-32 of
zlib, rotated right by 15 bits plus 0xA282EAD8, so that files of checksums can be checked, too.
A payload is: flags (1 byte: bit 0 if there is a document id, bit 1 if ids take 32 bits), the
document id (64 bits), the ids (16 bits each, or 32 where one needs them).

Files lie in ascending order of document ids: by part, split and position. The index holds a
row per record: file, part, split, position, offset, length, doc_id, n_tokens, ids_crc32.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bugloom.llm.common import id_key, in_runs, shuffle_partitions
from bugloom.llm.tokens import encoder

END_ID = 0
FILE_RECORDS = 4096
HEAD, HEAD_BYTES = "<QI", 12
PAYLOAD, PAYLOAD_BYTES = "<Bq", 9
_MASK = 0xA282EAD8  # fixed value of the masked checksum


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def payload(doc_id: int | None, ids: bytes) -> bytes:
    """A serialized sequence of little-endian 32-bit ids."""
    numbers = np.frombuffer(ids, "<u4")
    wide = bool(numbers.size) and int(numbers.max()) > 0xFFFF
    flags = (doc_id is not None) | wide << 1
    body = ids if wide else numbers.astype("<u2").tobytes()
    return struct.pack(PAYLOAD, flags, doc_id or 0) + body


def parsed(data: bytes | memoryview) -> tuple[int | None, bytes]:
    flags, doc_id = struct.unpack_from(PAYLOAD, data)
    body = data[PAYLOAD_BYTES:]
    ids = bytes(body) if flags & 2 else np.frombuffer(body, "<u2").astype("<u4").tobytes()
    return doc_id if flags & 1 else None, ids


def frame(data: bytes) -> bytes:
    """A record without its line feed."""
    size = struct.pack("<Q", len(data))
    return b"".join([
        size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data))
    ])


def read_frame(content, at: int) -> tuple[bytes | memoryview, int]:
    """The payload of the record at an offset, a slice, and the next record's offset."""
    size, check = struct.unpack_from(HEAD, content, at)
    if masked(content[at:at + 8]) != check:
        raise ValueError(f"broken length at byte {at}")
    start = at + HEAD_BYTES
    data = content[start:start + size]
    end = start + size
    if len(data) != size or struct.unpack_from("<I", content, end)[0] != masked(data):
        raise ValueError(f"broken record at byte {at}")
    if content[end + 4:end + 5] != b"\n":
        raise ValueError(f"record at byte {at} does not end where its length says")
    return data, end + 5


def write_records(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str | None = None):
    """Encode doc_id, text and write records in ascending doc_id; a null id comes first.

    A null text has only its end id. Other columns are not stored; repeated rows are records of
    their own. The rows are shuffled once, by ranges of ids, before they are encoded.
    """
    end = struct.pack("<I", end_id)

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in in_runs(batch):
                ids, texts = (part.column(c).to_pylist() for c in ("doc_id", "text"))
                records = [frame(payload(i, x + end)) for i, x in zip(ids, encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(
        shuffle_partitions(docs.sparkSession), id_key()
    ).sortWithinPartitions(id_key())
    (
        ordered.mapInArrow(run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    )


RECORD = "file string, position bigint, offset bigint, length bigint, doc_id bigint"
_RECORD_TYPES = [pa.string(), *[pa.int64()] * 4]


def _read(spark: SparkSession, path: str, fields: str, kinds: list, of) -> DataFrame:
    """A row per record, both checksums verified: its place, and ``of`` its 32-bit ids."""
    schema, types = f"{RECORD}, {fields}", [*_RECORD_TYPES, *kinds]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                file, view, at, rows = file.as_py(), memoryview(content.as_buffer()), 0, []
                position, size = 0, 0
                while at < len(view):
                    data, after = read_frame(view, at)
                    doc_id, ids = parsed(data)
                    rows.append((file, position, at, after - at, doc_id, *of(ids)))
                    position, at, size = position + 1, after, size + len(ids)
                    if size > 4_000_000 or at == len(view):
                        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        rows, size = [], 0

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files in a folder with its place and its ids, 32 bits each."""
    return _read(spark, path, "ids binary", [pa.binary()], lambda ids: (ids,))


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read all records back and write their index; returns it."""
    found = _read(
        spark, path, "n_tokens bigint, ids_crc32 bigint", [pa.int64()] * 2,
        lambda ids: (len(ids) // 4, zlib.crc32(ids)),
    )
    part, split = (
        F.regexp_extract("file", r"part-(\d+)-[^/]*-c(\d+)\.[^/]*$", k).cast("int") for k in (1, 2)
    )
    rows = found.withColumns({"part": part, "split": split})
    rows.write.parquet(index_path)
    return spark.read.schema(rows.schema).parquet(index_path)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with the number of ids before each record, over all files.

    Running sums stay inside a file, of bounded size; the files' totals, a row each, are summed
    once more.
    """
    in_file = Window.partitionBy("part", "split").orderBy("position")
    files = index.groupBy("part", "split").agg(F.sum("n_tokens").alias("_tokens"))
    before = F.sum("_tokens").over(Window.orderBy("part", "split")) - F.col("_tokens")
    bases = files.select("part", "split", before.alias("_base"))
    own = F.sum("n_tokens").over(in_file) - F.col("n_tokens")
    return index.withColumn("_own", own).join(bases, ["part", "split"]).withColumn(
        "start", F.col("_base") + F.col("_own")
    ).drop("_own", "_base")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """place, doc_id, ids: records cut out at the index's offsets, in a seeded order.

    Files are dealt to tasks; each file is opened once and its records are read where the index
    says. ``place`` is the record's random number: sort by it, or take it in ranges.
    """
    place = F.xxhash64(F.lit(seed), "part", "split", "position").alias("place")
    wanted = index.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct(place, "offset"))).alias("records")
    )

    def run(batches):
        for batch in batches:
            for content, records in zip(batch.column("content"), batch.column("records")):
                view, rows = memoryview(content.as_buffer()), []
                for r in records.as_py():
                    doc_id, ids = parsed(read_frame(view, r["offset"])[0])
                    rows.append((r["place"], doc_id, ids))
                kinds = (pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    joined = files.select(F.col("path").alias("file"), "content").join(wanted, "file")
    return joined.select("content", "records").mapInArrow(
        run, "place bigint, doc_id bigint, ids binary"
    )
