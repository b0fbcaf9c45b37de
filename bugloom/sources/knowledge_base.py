"""The knowledge base: a Parquet table of embedded chunks, partitioned by source.

Beside it lies a filter of the stored keys (``key_filter``), so that an append compares only what
may be stored, and reads ids of only those sources that may hold it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugloom import vocabulary as V
from bugloom.operators.chunk import chunk_defects
from bugloom.operators.codes import Codebook, with_codes
from bugloom.operators.embed import Embedder, embed_text
from bugloom.schema import CHUNK_COLUMNS
from bugloom.session import staged
from bugloom.sources.key_filter import KEY, add_keys, possibly_stored, same_key
from bugloom.sources.load import path_kind

COLUMNS = (*CHUNK_COLUMNS, "embedding", "code")
_TYPES = {
    "has_stack_trace": T.BooleanType(),
    "chunk_index": T.IntegerType(),
    "n_chunks": T.IntegerType(),
    "embedding": T.ArrayType(T.FloatType()),
    "code": T.BinaryType(),
}
SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in COLUMNS])


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """All chunks; an absent table is empty. Unread columns are never scanned."""
    if path_kind(spark, path) is None:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


def count_chunks(spark: SparkSession, path: str) -> int:
    return read_kb(spark, path).count()


_UID, _VERSION = "_uid", "_version"


def _numbered(rows: DataFrame, *versioned: str) -> DataFrame:
    """Rows with a number and a hash of their version, so that a choice reads no texts again.

    No source and an empty one are the same, as folders tell them alike.
    """
    own = rows.withColumn("source", F.nullif("source", F.lit("")))
    return own.withColumns(
        {_UID: F.monotonically_increasing_id(), _VERSION: F.xxhash64(*versioned)}
    )


def stored_keys(keys: DataFrame, path: str) -> DataFrame:
    """``source, defect_id, missing``: which of the keys are stored, and whether chunks lack.

    Ids are read of the sources that the filter does not rule out, and compared exactly.
    """
    spark = keys.sparkSession
    stored = read_kb(spark, path)
    possible = possibly_stored(keys, path)
    if possible is None:
        possible = keys
    else:
        # The sources are the table's folders: few by its layout.
        named = [r["source"] for r in possible.select("source").distinct().collect()]
        known = F.col("source").isin([n for n in named if n is not None])
        stored = stored.filter(known | F.col("source").isNull() if None in named else known)
    chunks = stored.select(*KEY, "chunk_index", "n_chunks").alias("s").join(
        possible.distinct().alias("p"), same_key("s", "p"), "left_semi"
    )
    return chunks.groupBy(*KEY).agg(
        (F.count_distinct("chunk_index") < F.max("n_chunks")).alias("missing")
    )


def _chosen(batch: DataFrame, *inside: str) -> DataFrame:
    """Key and number of the rows that stand for the batch's defects, from narrow columns alone.

    Of a defect's versions the one with the least hash is taken, and of repeated rows the first.
    """
    rows = batch.select(*KEY, *inside, _UID, _VERSION)
    if not inside:
        first = rows.groupBy(*KEY).agg(F.min(F.struct(_VERSION, _UID)).alias("_first"))
        return first.select(*KEY, F.col(f"_first.{_UID}").alias(_UID))
    least = rows.groupBy(*KEY).agg(F.min(_VERSION).alias(_VERSION))
    own = rows.alias("r").join(least.alias("l"), same_key("r", "l", _VERSION)).select("r.*")
    return own.groupBy(*KEY, *inside).agg(F.min(_UID).alias(_UID))


def _insert(batch: DataFrame, path: str, inside: tuple, to_chunks, embedder, book):
    """Write the chunks of absent defects, and those that a stored defect lacks."""
    with staged(_chosen(batch, *inside), "chosen") as chosen:
        keys = chosen.select(*KEY).distinct()
        with staged(stored_keys(keys, path), "stored-keys") as known:
            whole = known.filter("not missing")
            taken = chosen.alias("c").join(whole.alias("w"), same_key("c", "w"), "left_anti")
            skipped = batch.select(_UID).join(taken.select(F.col(f"c.{_UID}")), _UID, "left_anti")
            chunks = to_chunks(batch.join(skipped, _UID, "left_anti").drop(_UID, _VERSION))
            lacking = known.filter("missing")
            if not lacking.isEmpty():
                there = read_kb(batch.sparkSession, path).select(*KEY, "chunk_index").alias("s").join(
                    lacking.alias("k"), same_key("s", "k"), "left_semi"
                )
                chunks = chunks.alias("n").join(
                    there.alias("t"), same_key("n", "t", "chunk_index"), "left_anti"
                )
            embedded = embed_text(chunks, "text", "embedding", embedder)
            if path_kind(batch.sparkSession, path) is not None and possibly_stored(keys, path) is None:
                # A table from before there was a filter.
                add_keys(read_kb(batch.sparkSession, path).select(*KEY), path)
            add_keys(keys.alias("c").join(known.alias("w"), same_key("c", "w"), "left_anti"), path)
            _write(with_codes(embedded, book) if book else embedded, path, "append")


def _write(chunks: DataFrame, path: str, mode: str) -> None:
    """Few files per source, and no task with a whole large source."""
    if "code" not in chunks.columns:
        chunks = chunks.withColumn("code", F.lit(None).cast("binary"))
    rows = chunks.select(*COLUMNS).hint("rebalance", "source")
    rows.write.mode(mode).partitionBy("source").parquet(path)


def append_records(
    records: DataFrame,
    path: str,
    embedder: Embedder | None = None,
    size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
    book: Codebook | None = None,
) -> None:
    """Chunk, embed and insert the records whose defect is absent, one version of each.

    A null source or id is a value like others: one version of it is stored. Repeating the call
    adds nothing, and completes a defect of which a failed call left some chunks only. With
    ``book``, chunks carry their codes.
    """
    with staged(_numbered(records, *records.columns), "records") as batch:
        _insert(batch, path, (), lambda new: chunk_defects(new, size, overlap), embedder, book)


def append_chunks(
    chunks: DataFrame, path: str, embedder: Embedder | None = None, book: Codebook | None = None
) -> None:
    """Embed and insert the chunks of absent defects. Repeating the call adds nothing.

    A defect's chunks come whole: those of one version, which agree on all but the text, its
    number and its id. ``append_records`` chooses among versions that differ by text alone.
    """
    apart = {"chunk_id", "chunk_index", "text"}
    version = [c for c in chunks.columns if c not in apart]
    with staged(_numbered(chunks, *version), "chunks") as batch:
        _insert(batch, path, ("chunk_id",), lambda new: new, embedder, book)


def reset_kb(spark: SparkSession, path: str) -> None:
    """Make the table and its filter empty."""
    empty = spark.createDataFrame([], SCHEMA)
    _write(empty, path, "overwrite")
    add_keys(empty, path, "overwrite")
