"""Pack documents into windows of a fixed number of tokens, with next to no padding.

A document's whole windows stand alone; what is left over has one of ``window - 1`` lengths. All
that packing needs to know is how many pieces there are of each length, so it is planned on that
histogram: a window starts with the longest length left, and a subset-sum over the bits of one
integer finds the multiset of other lengths that comes closest to its capacity (minimum bin
slack). Stored steps are walked back for the counts, and the window is repeated as often as the
counts allow, which uses up a length each time; the plan is bounded by the window, not the data.
A length for which no multiset fills a window goes to the rest, which is laid end to end and cut
where windows end. Pieces are matched to the plan by their rank among those of their length.
"""

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom.llm.common import in_runs, ranked, shuffle_partitions, written
from bugloom.llm.tokens import encoder

WINDOW = 2048
END_ID = 1


@dataclass(frozen=True)
class Place:
    """Pieces of a length with ranks in [first, after): ``per`` in a window, side by side."""

    length: int
    first: int
    after: int
    per: int
    sequence: int
    offset: int
    rest: bool  # laid end to end from ``offset`` tokens into the rest


def fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The multiset of the counted lengths with the greatest sum up to ``capacity``.

    ``reach`` has bit s set if some multiset sums to s. Each step adds a power of two (or what
    is left) of one length, as far as its count and the capacity go.
    """
    reach, limit = 1, (1 << (capacity + 1)) - 1
    steps = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            n = min(take, left)
            steps.append((reach, length, n))
            reach |= reach << (length * n) & limit
            left, take = left - n, take * 2
        if reach >> capacity & 1:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= length * n
    return best, used


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[Place], int, int]:
    """Places of all pieces, the first sequence of the rest, and the number of sequences."""
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    places: list[Place] = []
    rest: list[tuple[int, int]] = []
    sequence = 0
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        best, chosen = fill({k: n for k, n in others.items() if n}, window - longest)
        if best < window - longest:
            # With fewer pieces later on, this length fills no window either.
            rest.append((longest, left.pop(longest)))
            continue
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            places.append(
                Place(length, used[length], used[length] + n * times, n, sequence, offset, False)
            )
            offset += n * length
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    first_rest, at = sequence, 0
    for length, n in rest:
        places.append(Place(length, used[length], used[length] + n, 1, first_rest, at, True))
        at += length * n
    return places, first_rest, first_rest + -(-at // window)


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
)
_PIECE_TYPES = [pa.int64()] * 5 + [pa.binary()]


def _short(ids: bytes) -> bytes:
    """32-bit ids in 16 bits each, if they all fit."""
    numbers = np.frombuffer(ids, "<u4")
    return numbers.astype("<u2").tobytes() if numbers.max() <= 0xFFFF else ids


def _long(ids: bytes, n: int) -> bytes:
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def cut_documents(
    docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None
) -> DataFrame:
    """Whole windows of each document and what is left over, with ids for the latter.

    A null text has only its end id.
    """
    end = struct.pack("<I", end_id)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def pieces(doc_id, ids: bytes):
        total = len(ids) // 4
        for start in range(0, total, window):
            part = ids[4 * start:4 * (start + window)]
            n = len(part) // 4
            yield doc_id, start, n, zlib.crc32(part), total, _short(part) if n < window else None

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for some in in_runs(batch):
                ids, texts = (some.column(c).to_pylist() for c in ("doc_id", "text"))
                rows = [p for i, x in zip(ids, encode(texts)) for p in pieces(i, x + end)]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_PIECE_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(run, PIECES)


def packed(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text) with sequence_id and offset.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every id lies in
    exactly one piece; a sequence's pieces follow each other without gaps; all sequences but the
    last are full. Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    cut = cut_documents(docs, window, end_id).withColumn("uid", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    left = cut.filter(F.col("length") < window)
    # At most window - 1 rows come back.
    counts = {r["length"]: r["count"] for r in left.groupBy("length").count().collect()}
    places, first_rest, sequences = plan(counts, window)
    table = spark.createDataFrame(
        [(p.length, p.first, p.after, p.per, p.sequence, p.offset, p.rest) for p in places],
        "length bigint, first bigint, after bigint, per bigint, sequence bigint, "
        "at bigint, rest boolean",
    )
    slim = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "uid"]
    placed = ranked(left.select(*slim), "length", "uid", parts).alias("p").join(
        # At most window - 1 plan steps of fewer than sqrt(2 * window) lengths each.
        F.broadcast(table.alias("t")),
        (F.col("p.length") == F.col("t.length"))
        & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")),
    )
    turn = F.col("rank") - F.col("first")
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full_rows = cut.filter(F.col("length") == window).select(*slim, F.lit(0).alias("one"))
    full = ranked(full_rows, "one", "uid", parts).select(
        *slim[:-1], (F.col("rank") + sequences).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    filled = placed.filter(~F.col("rest")).select(
        "p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens",
        (F.col("sequence") + F.floor(turn / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + turn % F.col("per") * F.col("p.length")).alias("offset"),
    )
    lengths = [p.length for p in places if p.rest]
    if not lengths:
        return filled.select(*result).unionByName(full.select(*result))
    at = F.col("at") + turn * F.col("p.length")
    rest = placed.filter(F.col("rest")).select("p.uid", at.alias("_at"))
    ids = left.filter(F.col("length").isin(lengths)).select(*slim, "ids")
    laid = ids.join(rest, "uid").withColumns({
        "offset": F.col("_at") % window,
        "sequence_id": F.lit(first_rest) + F.floor(F.col("_at") / window).cast("bigint"),
    })
    return (
        filled.select(*result).unionByName(full.select(*result))
        .unionByName(_cut_at_windows(laid, window).select(*result))
    )


def _cut_at_windows(laid: DataFrame, window: int) -> DataFrame:
    """Pieces that reach over a window's end become two."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} bigint" for n in names)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                whole = _long(r["ids"], r["length"])
                here = min(r["length"], window - r["offset"])
                rows.append((
                    r["doc_id"], r["start"], here, zlib.crc32(whole[:4 * here]), r["doc_tokens"],
                    r["sequence_id"], r["offset"],
                ))
                if here < r["length"]:
                    rows.append((
                        r["doc_id"], r["start"] + here, r["length"] - here,
                        zlib.crc32(whole[4 * here:]), r["doc_tokens"], r["sequence_id"] + 1, 0,
                    ))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    return laid.select(*columns).mapInArrow(run, schema)
