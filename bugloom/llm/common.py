"""Helpers the operators share: words, hashes, id ranges, staged tables."""

import ctypes
import math
import uuid
import zlib
from collections.abc import Callable, Hashable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bugloom.functions.regex import bind
from bugloom.session import shared_folder, spread

# White space between words, everywhere in this package.
WORD_BREAK = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back.

    Later steps neither recompute them nor depend on the executors that made them. The folder
    stays, as the returned rows are read from it later on.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Sorted distinct hashes of all runs of ``size`` words of a lower-cased text.

    A text with fewer words is one shingle; one without words has none.
    """
    own = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        def run(i: Column) -> Column:
            return F.xxhash64(*[F.get(h, i + k) for k in range(size)])

        n = F.size(h)
        return (
            F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), run))
            .when(n > 0, F.array(F.xxhash64(h)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return F.sort_array(F.array_distinct(bind(own, runs)))


def id_key(name: str = "doc_id") -> Column:
    """An id to sort by: a null id comes before all others."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(-(2**63)))


def id_bounds(
    df: DataFrame, parts: int, name: str = "doc_id"
) -> tuple[list[int], int | None]:
    """At most ``parts - 1`` ascending ids that split the rows evenly, and the highest id.

    One pass over the ids; what comes back is bounded by ``parts``.
    """
    shares = [(k + 1) / parts for k in range(parts - 1)]
    cuts = F.percentile_approx(id_key(name), shares, 20 * parts) if shares else F.array()
    found = df.select(cuts.alias("cuts"), F.max(id_key(name)).alias("top")).first()
    return sorted(set(found["cuts"] or [])), found["top"]


def id_range(bounds: list[int], key: Column) -> Column:
    """The number of ascending bounds below a key, by a coarse and then a fine search."""
    step = max(1, math.isqrt(len(bounds)))
    array = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    coarse = bounds[step - 1 :: step]
    if not coarse:
        return F.lit(0)
    blocks = F.size(F.filter(F.lit(coarse).cast("array<bigint>"), lambda b: b < key))
    return bind(
        blocks * step,
        lambda n: n + F.size(F.filter(F.slice(array, n + 1, step), lambda b: b < key)),
    )


def ranked(rows: DataFrame, key: str, order: str, parts: int) -> DataFrame:
    """Rows with ``rank`` from 0 among those of their key.

    A key's rows are dealt to ``parts`` groups, ranked in each, and the groups' counts, at most
    ``parts`` per key, are summed up; so a key that holds most rows is not one task's work.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    bases = counts.select(key, "_part", before.alias("_base"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1
    return (
        dealt.withColumn("_inside", inside).join(bases, [key, "_part"])
        .withColumn("rank", F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")
    )


def crc32_remainder(key: Column, modulus: int) -> Column:
    """crc32 of an id's text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def sized_broadcast(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A written table of short rows, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= most_rows else df


def crc32_remainder_py(key, modulus: int) -> int:
    return zlib.crc32(b"" if key is None else str(int(key)).encode()) % modulus


def in_runs(batch, text: str = "text", most_bytes: int = 1_000_000):
    """Slices of a record batch with a bounded size of their texts (or one row), in order."""
    first, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        n = n or 0
        if k > first and size + n > most_bytes:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if batch.num_rows > first:
        yield batch.slice(first)
    release_memory()


_MEMORY: dict[Hashable, object] = {}


def release_memory() -> None:
    """Give freed memory back to the system, where Arrow and the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def worker_memory(owner: Hashable | None = None, make: Callable[[], object] | None = None):
    """What tasks of one operator keep in a Python worker between them; one owner at a time.

    A task of another operator drops it, so that memories don't add up over the stages of a job.
    Tasks that keep nothing call it without an owner.
    """
    if owner is None or owner not in _MEMORY:
        if _MEMORY:
            _MEMORY.clear()
            release_memory()
        if owner is not None:
            _MEMORY[owner] = make()
    return _MEMORY.get(owner)
