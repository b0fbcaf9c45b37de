"""A Bloom filter of stored keys as a table, beside the table that it speaks for.

A key ``(source, defect_id)`` sets four bits of one 64-bit word, of ``WORDS`` per source. Every
append adds rows ``(source, word, bits)``; rows of one word are merged when they are read. The
filter never denies a stored key, as an append writes it before its chunks; what it affirms by
mistake costs an exact comparison and nothing else.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bugloom.sources.load import path_kind

KEY = ("source", "defect_id")
# Some 27 million keys per source at ten bits each; above, more keys are compared exactly.
WORDS = 1 << 22
BITS = 4
SCHEMA = "source string, word bigint, bits bigint"


def filter_path(path: str) -> str:
    return path.rstrip("/") + ".keys"


def same_key(left: str, right: str, *more: str) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    condition = F.lit(True)
    for c in (*KEY, *more):
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def with_bits(keys: DataFrame) -> DataFrame:
    places = F.xxhash64("defect_id", "source", F.lit("bits"))
    bits = F.lit(0).cast("bigint")
    for k in range(BITS):
        one = F.expr(f"shiftleft(1L, cast((shiftrightunsigned(_places, {6 * k})) & 63 AS int))")
        bits = bits.bitwiseOR(one)
    return keys.withColumn("_places", places).withColumns({
        "word": F.pmod(F.xxhash64("source", "defect_id"), F.lit(WORDS)), "bits": bits,
    }).drop("_places")


def add_keys(keys: DataFrame, path: str, mode: str = "append") -> None:
    words = with_bits(keys.select(*KEY)).groupBy("source", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    words.write.mode(mode).parquet(filter_path(path))


def possibly_stored(keys: DataFrame, path: str) -> DataFrame | None:
    """The keys that the filter does not deny; None if there is no filter."""
    spark: SparkSession = keys.sparkSession
    if path_kind(spark, filter_path(path)) is None:
        return None
    stored = spark.read.schema(SCHEMA).parquet(filter_path(path))
    asked = with_bits(keys.select(*KEY))
    place = F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a.word") == F.col("s.word"))
    met = asked.alias("a").join(stored.alias("s"), place).groupBy(
        "a.source", "a.defect_id", F.col("a.bits").alias("own")
    ).agg(F.expr("bit_or(s.bits)").alias("found"))
    return met.filter(F.col("found").bitwiseAND(F.col("own")) == F.col("own")).select(*KEY)
