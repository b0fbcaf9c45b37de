"""WARC archives: chunked, segmented records written and put together again.

Writing: a payload that occurs several times is stored once, as the response of its largest
page_id; the others revisit it. Blocks above ``segment_bytes`` are cut into a first record and
continuations. Files hold at most ``FILE_RECORDS`` records, hence a bounded number of bytes.

Reading: records are cut out by their lengths; segments meet by their origin's identifier, are
put in order of their numbers and checked against the total length; then the chunked framing of
the HTTP body is taken off. A record with missing segments or broken framing has
``complete = false`` and no payload.
"""

import gzip
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
FILE_RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    b"Transfer-Encoding: chunked\r\n\r\n"
)

RECORD_SCHEMA = (
    "record_id string, type string, url string, refers_to string, digest string, "
    "payload_length bigint, origin_id string, segment int, total_length bigint, block binary"
)
_NAMES = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_TYPES = [_KINDS[c.split()[1]] for c in RECORD_SCHEMA.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four letters for every five hexadecimal digits."""
    digest = F.sha1(payload)
    letters = [
        F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(
        F.concat(*letters),
        "0123456789ABCDEFGHIJKLMNOPQRSTUV",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    )


def with_origins(pages: DataFrame) -> DataFrame:
    """Payload, digest and record type of each page: page_id, url, payload, digest, refers_to.

    Only digests and ids meet in the aggregation, which starts before the shuffle; a payload
    that makes up a large part of all rows is a skewed join key that adaptive execution splits.
    Rows that repeat the largest page_id are all responses. A null html is an empty payload.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", base32_sha1(F.col("payload"))
    )
    origins = own.groupBy("digest").agg(F.max("page_id").alias("origin_page"))
    is_origin = F.col("page_id").eqNullSafe(F.col("origin_page"))
    return own.join(origins, "digest").select(
        "page_id", "url", "payload", "digest",
        F.when(is_origin, "response").otherwise("revisit").alias("type"),
        F.when(~is_origin, F.col("origin_page")).alias("refers_to"),
    )


def chunked(payload: bytes, size: int) -> bytes:
    out = []
    for k in range(0, len(payload), size):
        part = payload[k:k + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out) if body[at:at + 2] == b"\r\n" else None
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def record(head: list[tuple[str, object]], block: bytes) -> bytes:
    fields = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    return VERSION + fields.encode() + b"\r\n" + block


def page_records(page, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response in segments, or a revisit."""
    key = "" if page["page_id"] is None else page["page_id"]
    own, payload = f"urn:page:{key}:{uuid.uuid4().hex}", page["payload"]
    url = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", page["url"] or "")
    head = [
        ("WARC-Type", page["type"]), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{page['digest']}"),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page["type"] == "revisit":
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{page['refers_to']}>")]
        yield record(head + more, HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record(head, block)
        return
    parts = [block[k:k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    yield record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        more = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own}:{number}>"),
            ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{own}>"),
            ("WARC-Segment-Number", number),
        ]
        if number == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield record(more, part)


def write_warc(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> None:
    """Write pages (page_id, url, html) as archives; other columns are not stored.

    The text sink writes each record's bytes as they are and the record end after them, and
    commits whole files, so a lost executor leaves no part of one.
    """

    def frame(batches):
        for batch in batches:
            out = [
                r for page in batch.to_pylist()
                for r in page_records(page, segment_bytes, chunk_bytes)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = with_origins(pages).mapInArrow(frame, "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS)
        .text(path, compression="gzip")
    )


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one archive, compressed or not, by their lengths."""
    if content.startswith(b"\x1f\x8b"):
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = end + 4, int(fields["content-length"])
        if content[start + length:start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} does not end where its length says")
        yield {"fields": fields, "block": content[start:start + length]}
        at = start + length + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below a folder, segments apart."""

    def number(fields: dict, name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for r in parse_records(content.as_py()):
                    f = r["fields"]
                    own = f.get("warc-record-id", "").strip("<>")
                    rows.append((
                        own, f.get("warc-type"), f.get("warc-target-uri"),
                        f.get("warc-refers-to", "").strip("<>") or None,
                        f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        number(f, "x-payload-length"),
                        f.get("warc-segment-origin-id", "").strip("<>") or own,
                        number(f, "warc-segment-number"),
                        number(f, "warc-segment-total-length"),
                        r["block"],
                    ))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(parse, RECORD_SCHEMA)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per record with its whole block; null where segments are missing.

    Only segments are shuffled: records in one piece pass by. A group is one record's segments.
    """
    names = ["record_id", "type", "url", "refers_to", "digest", "payload_length"]
    single = records.filter(F.col("segment").isNull()).select(*names, "block")
    parts = records.filter(F.col("segment").isNotNull())
    first = F.col("segment") == 1
    found = parts.groupBy("origin_id").agg(
        *[F.max(F.when(first, F.col(n))).alias(n) for n in names if n != "record_id"],
        F.sort_array(
            F.collect_list(F.struct("segment", F.col("block").cast("string").alias("bytes")))
        ).alias("parts"),
        F.max("segment").alias("last"),
        F.max("total_length").alias("total"),
    )
    block = F.array_join(F.col("parts.bytes"), "").cast("binary")
    joined = found.withColumn("joined", block)
    whole = (
        (F.size("parts") == F.col("last"))
        & (F.element_at("parts.segment", 1) == 1)
        & (F.octet_length("joined") == F.col("total"))
    )
    return single.unionByName(
        joined.select(
            F.col("origin_id").alias("record_id"), *names[1:],
            F.when(whole, F.col("joined")).alias("block"),
        )
    )


@F.pandas_udf(BinaryType())
def _http_body(blocks: pd.Series) -> pd.Series:
    def body(block):
        if block is None:
            return None
        head, found, rest = bytes(block).partition(b"\r\n\r\n")
        if not found:
            return None
        return dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest

    return blocks.map(body)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses with their payloads, and revisits.

    Returns record_id, page_id, url, type, refers_to (a page_id), digest, payload_length,
    payload, complete.
    """
    whole = reassembled(read_records(spark, path))
    is_response = F.col("type") == "response"
    page = F.regexp_extract("record_id", "^urn:page:(-?[0-9]*)", 1)
    named = whole.select(
        "record_id",
        page.try_cast("bigint").alias("page_id"),
        "url", "type",
        F.regexp_extract("refers_to", "^urn:page:(-?[0-9]+)", 1).try_cast("bigint").alias("refers_to"),
        "digest", "payload_length",
        F.when(is_response, _http_body("block")).alias("payload"),
    )
    return named.withColumn("complete", ~is_response | F.col("payload").isNotNull())
